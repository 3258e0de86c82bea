"""A corpus made ready for training: five stages over the table `documents`.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; the
result is written as Parquet and read again for the next.  All but the last return the
columns of `docs`; rows are judged one by one, so null or repeated ids and extra columns
pass through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epilode.llm import decontamination, language, packing, pii, simhash
from epilode.llm.common import fresh_name, own_columns
from epilode.session import cut_lineage

#: Posterior probability below which a document's language counts as not identified.
MIN_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; texts that are null or hold no letter go.

    Without labelled documents no language is learned, and nothing can be rejected but
    texts without letters.
    """
    model = language.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    into = fresh_name(docs, "language")
    judged = language.predict(docs, model, into)
    if model.languages:
        keep = (F.col(f"{into}.lang_pred") != language.UNDETERMINED) & (F.col(f"{into}.score") >= MIN_SCORE)
    else:
        keep = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return judged.where(keep).select(*own_columns(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: that of the smallest id."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null texts hold none."""
    into = fresh_name(docs, "contamination")
    marked = decontamination.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into)
    return marked.where(F.size(f"{into}.hits") == 0).select(*own_columns(docs))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data in their texts give way to the kind in brackets, and `n_chars` follows."""
    into = fresh_name(docs, "pii")
    found = pii.find(docs, into)
    changed = F.size(f"{into}.spans") > 0
    text = F.when(changed, F.col(f"{into}.redacted")).otherwise(F.col("text"))
    out = []
    for name, column in zip(docs.columns, own_columns(docs)):
        if name == "text":
            column = text.alias("text")
        elif name == "n_chars":
            kind = docs.schema["n_chars"].dataType
            column = F.when(changed, F.length(f"{into}.redacted").cast(kind)).otherwise(column).alias("n_chars")
        out.append(column)
    return found.select(*out)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 4096 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", redact),
    ("packing", pack),
]

#: Fingerprints, segmentations and tokens are beyond SQL; tests/llm/test_pipeline.py has plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
