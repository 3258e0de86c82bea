import math
from itertools import combinations
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest

import __spark_entry__ as entry
from epilode.llm import language as L

PATH = public_tokenizers.path("piece_bpe_32k.model")


def tiny(*texts):
    pieces = sorted({"▁", "▁a", "a", "b", "ab", "▁ab", "ba", "é", "bab"})
    rng = np.random.default_rng(5)
    table = rng.random((len(pieces), 3))
    return L.PieceModel(pieces, ["x", "y", "z"], table / table.sum(axis=0))


def brute_word(model, word):
    """Sum over all cuts of the marked word."""
    s, numbers = "▁" + word, {p: n for n, p in enumerate(model.pieces)}
    total = np.zeros(len(model.languages))
    for k in range(len(s)):
        for cut in combinations(range(1, len(s)), k):
            p = np.ones(len(model.languages))
            for i, j in zip((0, *cut), (*cut, len(s))):
                n = numbers.get(s[i:j], len(model.pieces) + (j - i == 1))
                p = p * model.table[n]
            total += p
    return np.log(total)


@pytest.mark.parametrize("word", ["a", "b", "ab", "abab", "babbab", "qa", "éaé", "aabbaqb"])
def test_forward_sums_all_segmentations(word):
    model = tiny()
    assert np.allclose(model.score_new([word])[0], brute_word(model, word))
    assert np.allclose(model.score_long(word), brute_word(model, word))


def test_long_words_and_a_full_memory(monkeypatch):
    model = tiny()
    long = "ab" * 5000 + "q" * 50
    assert np.isfinite(model.score_long(long)).all()
    assert np.allclose(model.score_new(["ab" * 16])[0], model.score_long("ab" * 16))
    words = ["a", "ab", "ba", "a", "bb", long, "a"]
    want = sum(model.score_long(w) for w in words)
    monkeypatch.setattr(L, "_REMEMBERED", 2)
    got = list(model.log_likelihoods([words, [], ["ab"]]))
    assert np.allclose(got, [want, np.zeros(3), model.score_long("ab")])
    assert np.allclose(next(model.log_likelihoods([["ba", "bab"]])), model.score_long("ba") + model.score_long("bab"))


def test_expected_counts_follow_the_segmentations():
    model = tiny()
    into = np.zeros_like(model.table)

    class Shared:
        value = model

    L._expected(Shared, ["ab"], [1], [3], into)
    s = "▁ab"
    numbers = {p: n for n, p in enumerate(model.pieces)}
    want, total = np.zeros_like(into), 0.0
    for cut in ([], [1], [2], [1, 2]):
        parts = [s[i:j] for i, j in zip([0, *cut], [*cut, 3])]
        if all(p in numbers for p in parts):
            p = math.prod(model.table[numbers[x], 1] for x in parts)
            total += p
            for x in parts:
                want[numbers[x], 1] += 3 * p
    assert np.allclose(into, want / total)


def test_accuracy_on_the_held_out_fold(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = entry.queries()["op5_language"](spark, folder).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    judged = [(r.lang_pred, docs[r.doc_id].lang) for r in got if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(a == b for a, b in judged) / len(judged) > 0.97


def test_edge_cases(spark):
    rows = [(i, t, la) for i, (t, la) in enumerate([
        ("the house and the garden", "en"), ("das haus und der garten", "de"), ("the dog and the cat", "en"),
        ("der hund und die katze", "de"), (None, "fr"), ("123", "xx"), (None, None), ("", None), ("42 !", None),
        ("the " * 20000, None), ("x" * 40000, None), ("the garden", None), ("the garden", None), ("日本語", None), ("²", None),
    ] * 4)] + [(None, "le chat", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS lang_pred", "2 AS score", "3 AS word")
    model = L.train(docs, PATH)
    assert model.languages == ["de", "en"]
    out = L.predict(docs, model)
    assert out.columns == [*docs.columns, "language"]
    got = [(r.text, r.language.lang_pred) for r in out.collect()]
    assert len(got) == len(rows)
    for text, lang in got:
        want = "und" if text in (None, "", "123", "42 !", "²") else "en" if text.startswith("the ") else None
        assert want is None or lang == want
    with pytest.raises(ValueError):
        L.predict(docs, model, into="word")
    none = docs.where("false")
    empty = L.train(none, PATH)
    assert empty.languages == [] and L.predict(none, empty).count() == 0
    assert {r.language.lang_pred for r in L.predict(docs, empty).collect()} == {"und"}
