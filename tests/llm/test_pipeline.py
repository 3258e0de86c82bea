from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from epilode.llm import language, pii, simhash
from test_decontamination import words
from test_packing import check_places
from test_simhash import brute

FOLDER = "/root/testdata/sf0.001"


def window_set(items):
    out = set()
    for text in items:
        own = words(text)
        out |= {tuple(own[k : k + 10]) for k in range(max(1, len(own) - 9) if own else 0)}
    return out


def plain_stages(spark, rows, benchmark):
    """The rows that each of the first four stages keeps, one at a time and in plain Python."""
    docs = spark.createDataFrame(rows)
    model = language.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    kept = [r for r in rows if (p := model.predict([r.text])[0])[0] != "und" and p[1] >= 0.5]
    yield kept
    groups = brute([(r.doc_id, r.text) for r in kept])
    alone = {k for k, _, component in groups if k == component}
    kept = [r for r in kept if r.doc_id in alone]
    yield kept
    known = window_set(benchmark)
    sizes = {len(w) for w in known}

    def clean(text):
        own = words(text)
        return not any(tuple(own[k : k + n]) in known for n in sizes for k in range(len(own) - n + 1))

    kept = [r for r in kept if clean(r.text)]
    yield kept
    yield [(r, pii.redact_text(r.text, pii.find_spans(r.text))) for r in kept]


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    benchmark = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    plain = plain_stages(spark, docs.collect(), benchmark)
    now = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, FOLDER)
        assert now.columns == docs.columns and now.schema.simpleString() == docs.schema.simpleString()
        now = spark.createDataFrame(now.collect(), docs.schema)
        assert sorted(now.collect()) == sorted(next(plain)), name
    now = corpus_pipeline.redact(spark, now, FOLDER)
    assert now.columns == docs.columns
    want = {r.doc_id: (text, len(text)) for r, text in next(plain)}
    got = now.collect()
    assert {r.doc_id: (r.text, r.n_chars) for r in got} == want
    assert any("[EMAIL]" in r.text for r in got)
    check_places(corpus_pipeline.run(spark, FOLDER).collect(), [(r.doc_id, r.text) for r in got], 4096)


ROWS = [
    (None, "the house and the garden of the king", "en", 1), (1, None, "en", None), (2, "", None, 0), (3, "das haus und der garten", None, 1),
    (3, "das haus und der garten", None, 1), (3, "another text of the same id, the dog and the cat", "en", None), (None, "le chat et le chien de la maison", "fr", 2),
    (None, "le chat et le chien de la maison", "fr", 2), (4, "word " * 30000 + "the end", "en", 9), (5, "write to a.b@c.de and the man of the house", "en", None),
    (6, "!!! 123", "en", 1), (7, "the garden of the house and the king of the hill " * 3, "en", 5),
]


@pytest.fixture
def odd(spark):
    cols = "doc_id long, text string, lang string, n_chars int"
    return spark.createDataFrame(ROWS, cols).selectExpr(
        "*", "1 AS language", "2 AS contamination", "3 AS pii", "4 AS fp", "5 AS kept", "6 AS kept_id", "7 AS `a.b`", "'x' AS source"
    )


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_odd_rows_and_clashing_names(spark, odd, name, stage):
    out = stage(spark, odd, FOLDER)
    rows = out.collect()
    assert stage(spark, odd.where("false"), FOLDER).count() == 0
    if name == "packing":
        assert len({(r.doc_id, r.ids_crc32) for r in rows if r.piece == 0}) >= 9
        return
    assert out.columns == odd.columns
    texts = Counter(r.text for r in rows)
    if name == "language":
        assert None not in texts and "" not in texts and "!!! 123" not in texts
    if name == "near_duplicates":
        assert texts["das haus und der garten"] == 1 and texts["le chat et le chien de la maison"] == 1
        # Texts without words are one group; its smallest id stays.
        assert None in texts and "" not in texts and texts["!!! 123"] == 1
    if name == "decontamination":
        assert len(rows) == len(ROWS)
    if name == "personal_data":
        assert texts["write to [EMAIL] and the man of the house"] == 1 and len(rows) == len(ROWS)


def test_one_row_of_each_group_stays(spark, odd):
    kept = simhash.keep_one(odd).collect()
    groups = brute([(r[0], r[1]) for r in ROWS])
    assert len(kept) == len({(f, c) for _, f, c in groups})
