import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from epilode.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
MODEL = Tokenizer.from_file(PATH)

ODD = [
    "", " ", None, "a", "a", "a", "It's the dog's, isn't it? 'S 'T", "tab\there nbsp ls\x1c.", "ÉTÉ été été.",
    "é, x́!!", "<|endoftext|> x<|startoftext|>y", "ΑΣ ΑΣ. Σ", "日本語 テキスト、", "1234 ½ x² Ⅷ, ...!!!", "don't!!", "İstanbul ǅ",
    "word " * 9000, "x" * 30000, "\r\n a\r\nb\n\n c", "🙂🙂, 🙂", "a'b'c' 'd'",
]


def plain_ids(text):
    return MODEL.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_words_put_together_are_the_text(text):
    encoded = next(packing.WordTokenizer.of(PATH).encode([text]))
    assert np.frombuffer(encoded, "<u4").tolist() == plain_ids(text)[:-1]


def test_any_letter_stands_before_marks():
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalnum()]
    texts = [f"a{c}, b {c}.) {c}x! {c}\n" for c in letters]
    whole = MODEL.encode_batch_fast(texts, add_special_tokens=False)
    for text, want, got in zip(texts, whole, packing.WordTokenizer.of(PATH).encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, text


def test_odd_letters_marks_and_blanks():
    alphabet = "İIıiabAZéßΣς\u0307\u0301\u0327\u0338\u0958ǅ½²7日🙂 \n\t" + "".join(map(chr, range(33, 127)))
    rng = random.Random(13)
    texts = ["".join(rng.choices("İi\u0307 \n" if n % 3 else "İ \n,.-", k=rng.randint(0, 6))) + "".join(rng.choices(alphabet, k=rng.randint(0, 30))) for n in range(30_000)]
    texts += ["İ. a", "İ- x", "BAKİ-- a", "DİYARBAKIRLİ, a", *(f"İ{chr(m)} a{chr(m)}İ\n{chr(m)}" for m in range(33, 127))]
    whole = MODEL.encode_batch_fast(texts, add_special_tokens=False)
    for text, want, got in zip(texts, whole, packing.WordTokenizer.of(PATH).encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, text


def test_a_full_memory_is_emptied(monkeypatch):
    monkeypatch.setattr(packing, "_REMEMBERED", 3)
    own = packing.WordTokenizer(Path(PATH).read_text())
    texts = ["The cat, the DOG.", "a b c d e f g h", "the cat", "the THE a, (b) c!! d.), x<|endoftext|> y <|startoftext|>."] * 2
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == [plain_ids(t)[:-1] for t in texts]


def test_mixed_words_of_the_table():
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    for text, got in zip(rows, packing.WordTokenizer.of(PATH).encode(rows)):
        assert np.frombuffer(got, "<u4").tolist() == plain_ids(text)[:-1]


def brute_best_fit(lengths, capacity):
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect_left(rooms, n)
        if at == len(rooms):
            bins += 1
            room = capacity
        else:
            room = rooms.pop(at)
        if room - n:
            insort(rooms, room - n)
    return bins, rooms


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200))
def test_runs_equal_best_fit_decreasing(lengths):
    runs = packing.best_fit_runs(Counter(lengths), 40)
    used = defaultdict(list)
    for length, first, last, start, each, offset in runs:
        for j in range(last - first):
            used[start + j // each].append((offset + j % each * length, length))
    rooms = []
    for places in used.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 40
        rooms += [40 - end] if end < 40 else []
    assert (len(used), sorted(rooms)) == brute_best_fit(lengths, 40)
    assert Counter(n for p in used.values() for _, n in p) == Counter(lengths)


def test_tree_finds_the_tightest_room():
    tree = packing.CapacityTree(40)
    for room in (3, 17, 40):
        tree.add(room, 0, 1)
    assert [tree.tightest(n) for n in (1, 3, 4, 17, 18, 40)] == [3, 3, 17, 17, 40, 40]
    tree.take(17)
    assert tree.tightest(4) == 40
    tree.take(40)
    assert tree.tightest(4) is None


def test_length_out_of_range():
    with pytest.raises(ValueError):
        packing.best_fit_runs({41: 1}, 40)


def check_places(got, texts, capacity):
    want = Counter()
    for key, text in texts:
        ids = plain_ids(text)
        for p, at in enumerate(range(0, len(ids), capacity)):
            cut = np.array(ids[at : at + capacity], "<u4")
            want[(key, p, at, len(cut), zlib.crc32(cut.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= capacity
    assert len(bins) == brute_best_fit([r.length for r in got], capacity)[0]


def test_documents(docs_of):
    texts = [*enumerate(ODD), (None, "null id"), (5, "the same id"), *[(100 + i, "copy of a text") for i in range(300)]]
    check_places(packing.pack(docs_of(texts), PATH).collect(), texts, 4096)
    check_places(packing.pack(docs_of(texts), PATH, capacity=16).collect(), texts, 16)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check_places(packing.pack(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()], 4096)


def test_sequences_hold_the_ids(docs_of):
    texts = [(i, t) for i, t in enumerate(ODD)]
    packed = packing.pack(docs_of(texts), PATH, with_ids=True).cache()
    found = {r.sequence_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        ids = plain_ids(ODD[r.doc_id])[r.start : r.start + r.length]
        assert found[r.sequence_id][r.offset : r.offset + r.length] == ids
    assert sum(map(len, found.values())) == sum(r.length for r in packed.collect())


def test_no_documents(docs_of):
    assert packing.pack(docs_of([]), PATH).count() == 0
