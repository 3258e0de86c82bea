import hashlib
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
from epilode.llm import decontamination as D
from oracle import compare, connect

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for key, text in docs:
        own = words(text)
        hit, names = set(), set()
        for item, item_text in items:
            w = words(item_text)
            n = min(window, len(w))
            for k in range(len(w) - n + 1) if w else ():
                for s in range(len(own) - n + 1):
                    if own[s : s + n] == w[k : k + n]:
                        hit |= set(range(s, s + n))
                        names |= {str(item)} if item is not None else set()
        out.append((key, len(own), tuple(sorted(hit)), tuple(sorted(names))))
    return Counter(out)


LONG = " ".join(f"w{i}" for i in range(30))
ITEMS = [
    (1, LONG), (2, "alpha beta"), (3, None), (4, "...!"), (5, "Solo"), (6, "a a a a a a a a a a a a"),
    (7, "w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (None, "nameless words here"), (2, "gamma delta"), (10, "É é x ñ"), (8, "alpha BETA"),
]
DOCS = [
    (0, None), (1, ""), (2, "--- !"), (3, "x " + LONG.upper() + " y"), (4, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w10"), (5, "ALPHA, beta"),
    (6, "alpha"), (7, "solo SOLO"), (8, "a " * 9), (9, "a " * 40), (10, "nameless-words/here"), (10, "gamma delta alpha beta"),
    (None, "solo"), (11, "w3 w4 w5 w6 w7 w8 w9 w10 w11"), (12, "beta alpha"), (13, "É é x ñ é é x ñ"), (14, "z " * 60000 + LONG),
    (15, "w20 w21 w22 w23 w24 w25 w26 w27 w28 w29 w20 w21"), (16, LONG + " " + LONG), (17, "w29"), (18, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"),
]


def found(df):
    return Counter(
        (r.doc_id, r.contamination.n_words, tuple(i for h in r.contamination.hits for i in range(h.start, h.end)), tuple(r.contamination.items))
        for r in df.collect()
    )


@pytest.mark.parametrize("block", [100_000, 7])
@pytest.mark.parametrize("window,shingle", [(10, 3), (3, 3), (1, 3), (10, 1)])
def test_equals_brute_force(spark, docs_of, window, shingle, block):
    items = spark.createDataFrame([(i, t, 9) for i, t in ITEMS], "item_id long, text string, words int")
    if block == 7 and (window, shingle) != (10, 3):
        return
    got = D.mark(docs_of(DOCS), items, window=window, shingle=shingle, block=block)
    assert got.columns[:7] == ["doc_id", "text", "source", "lang", "fp", "sequence_id", "n"]
    assert found(got) == brute(DOCS, ITEMS, window)


def test_no_items_and_no_documents(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert all(not r.contamination.hits for r in D.mark(docs_of(DOCS), none).collect())
    assert D.mark(docs_of([]), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_column_name_in_use(spark, docs_of):
    with pytest.raises(ValueError):
        D.mark(docs_of(DOCS), spark.createDataFrame(ITEMS, "item_id long, text string"), into="source")


def test_query_digest(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(entry.queries()["op10_decontamination"](spark, folder), connect(folder), entry.oracle_sql()["op10_decontamination"]) is None
    rows = entry.queries()["op10_decontamination"](spark, folder).collect()
    assert any(r.contaminated for r in rows)
    assert {r.items_sha256 for r in rows if not r.n_items} == {hashlib.sha256(b"").hexdigest()}
