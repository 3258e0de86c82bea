"""SimHash near-duplicate groups.

A text's fingerprint has a bit set where more than half of its shingle hashes have it.
Fingerprints within `max_bits` of each other are linked.  Links are found on distinct
fingerprints, so copies cost nothing: a fingerprint is split into `max_bits + 3` blocks
of bits, two linked ones share at least three of them, and fingerprints that share
three blocks meet in a join and are verified by their Hamming distance.

Where more than `_PAIRED` fingerprints share the same three blocks, pairs would grow
with the square.  There, every fingerprint meets its neighbours at the words around
it: two fingerprints are within `max_bits` exactly if some word is within half of that
of one and within the rest of the other.  Everything around a word is linked to one
fingerprint next to it, which yields the same groups from few links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epilode.llm.common import arrow_map, fresh_name, own_columns
from epilode.llm.components import connected_components
from epilode.session import cut_lineage

SHINGLE = 3
MAX_BITS = 2
SEED = 42
_PAIRED = 64
_CHUNK = 1 << 16  # shingles whose bits are counted at a time


def simhash(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of a UTF-8 text, as a signed 64-bit number; 0 if it has no words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = [b" ".join(g) for g in zip(*(words[i:] for i in range(shingle)))]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(grams), _CHUNK):
        part = grams[at : at + _CHUNK]
        hashes = np.fromiter((digest(g, seed) for g in part), "<u8", len(part))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(grams)).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """`doc_id, content, fp`: one row per document, computed over its whole text.

    `content` is a hash of the text as it is.  The fingerprint lower-cases A-Z; words are
    parted by blanks, tabs and line ends.  Texts of fewer words than a shingle count as
    one shingle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.int64()), ("fp", pa.int64())])

    def rows(batch: pa.RecordBatch) -> list[tuple]:
        key, content, texts = (batch.column(k).to_pylist() for k in range(3))
        return list(zip(key, content, (simhash(t, shingle) for t in texts)))

    chosen = docs.select(F.col(id_col).cast("long"), _content(text_col), F.col(text_col).cast("binary"))
    return arrow_map(chosen, schema, rows)


def _content(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def _keys(max_bits: int) -> list[tuple[int, list[int]]]:
    """(mask of the shared bits, free bits) for every choice of three shared blocks."""
    count = max_bits + 3
    cuts = [round(64 * i / count) for i in range(count + 1)]
    keys = []
    for shared in combinations(range(count), 3):
        bits = [b for k in shared for b in range(cuts[k], cuts[k + 1])]
        mask = sum(1 << b for b in bits)
        keys.append((_signed(mask), [b for b in range(64) if b not in bits]))
    return keys


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def links(nodes: DataFrame, max_bits: int = MAX_BITS, paired: int = _PAIRED) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `fp` of the written table `nodes`.

    Every fingerprint is connected, over these links, with all that are within
    `max_bits` of it.  All pairs are listed where at most `paired` share a key.
    """
    keys = _keys(max_bits)
    blocks = F.array(*[
        F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")) for k, (mask, _) in enumerate(keys)
    ])
    exploded = nodes.select("fp", F.explode(blocks).alias("key")).select("fp", "key.k", "key.v")
    shared = cut_lineage(exploded.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1"), "blocks")
    members = cut_lineage(exploded.join(shared, ["k", "v"]), "members")

    few = members.where(F.col("n") <= paired).select("k", "v", "fp")
    pairs = few.withColumnRenamed("fp", "a").join(few.withColumnRenamed("fp", "b"), ["k", "v"])
    pairs = pairs.where((F.col("a") < F.col("b")) & (_distance("a", "b") <= max_bits)).select("a", "b")

    near = max_bits // 2
    flips = F.array(*[
        F.array(*[
            F.lit(_signed(sum(1 << b for b in bits)))
            for size in range(max_bits - near + 1) for bits in combinations(free, size)
        ])
        for _, free in keys
    ])
    around = members.where(F.col("n") > paired).select(
        "k", "fp", F.explode(F.element_at(flips, F.col("k") + 1)).alias("flip")
    )
    around = around.groupBy("k", F.col("fp").bitwiseXOR(F.col("flip")).alias("word")).agg(
        F.min(F.when(F.bit_count("flip") <= near, F.col("fp"))).alias("a"), F.collect_list("fp").alias("others")
    )  # no more rows around a word than there are flips
    stars = around.where(F.col("a").isNotNull()).select("a", F.explode("others").alias("b"))
    stars = stars.where((F.col("a") != F.col("b")) & (_distance("a", "b") <= max_bits))
    return pairs.unionByName(stars)


def classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = SHINGLE, max_bits: int = MAX_BITS, paired: int = _PAIRED,
) -> tuple[DataFrame, DataFrame]:
    """The written tables of documents (`doc_id, content, fp`) and groups (`fp, root, component_id`)."""
    prints = cut_lineage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    edges = links(nodes.select("fp"), max_bits, paired)
    roots = cut_lineage(connected_components(edges), "components")
    grouped = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    grouped = cut_lineage(grouped.select("fp", "first", F.coalesce("root", "fp").alias("root")), "grouped")
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints, cut_lineage(grouped.join(least, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = SHINGLE, max_bits: int = MAX_BITS, paired: int = _PAIRED,
) -> DataFrame:
    """`doc_id, fingerprint, component_id` for every row of `docs`.

    `component_id` is the smallest doc_id that links reach, the row's own included.
    Null or empty texts have fingerprint zero and are linked like any other.  Rows with a
    null id keep it and never name a component (one of only such rows has a null
    component).  Repeated rows stay; other columns are not read; no rows give no rows.
    """
    prints, groups = classes(docs, id_col, text_col, shingle, max_bits, paired)
    return prints.join(groups.drop("root"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    shingle: int = SHINGLE, max_bits: int = MAX_BITS, paired: int = _PAIRED,
) -> DataFrame:
    """The rows of `docs` that stay when each near-duplicate group keeps one.

    That is the row of the smallest id (a null id only if there is no other), among
    rows of one id the text of the least hash, and of rows that repeat both just one.
    """
    prints, groups = classes(docs, id_col, text_col, shingle, max_bits, paired)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "content")
    chosen = prints.join(groups.select("fp", "root"), "fp").groupBy("root").agg(F.min(order).alias("own"))
    # A null id is told apart by a column of its own, so that plain equality serves.
    names = [fresh_name(docs, n) for n in ("own_null", "own_id", "own_content", "row", "kept_null", "kept_id", "kept_content")]
    null, id_, content, number, *kept = names
    zero = F.lit(0).cast("long")
    chosen = cut_lineage(
        chosen.select(*[
            c.alias(n) for c, n in zip((F.col("own.last"), F.coalesce("own.doc_id", zero), F.col("own.content")), kept)
        ]),
        "kept",
    )
    long_id = F.col(id_col).cast("long")
    keyed = docs.withColumn(null, long_id.isNull()).withColumn(id_, F.coalesce(long_id, zero)).withColumn(content, _content(text_col))
    # The window and the join share one shuffle; it drops repeats before that.
    first = Window.partitionBy(null, id_, content).orderBy(F.lit(1))
    keyed = keyed.withColumn(number, F.row_number().over(first)).where(F.col(number) == 1)
    same = [F.col(a) == F.col(b) for a, b in zip((null, id_, content), kept)]
    return keyed.join(chosen, same, "left_semi").select(*own_columns(docs))
