import random
import re
from collections import Counter

import pytest
import xxhash

from epilode.llm import simhash
from epilode.llm.components import connected_components

SHINGLE_TEXTS = [
    (0, None), (1, ""), (2, " \t\r\n\x0b\x0c"), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE two three"),
    (7, "one two three one two three one two three"), (8, "É é x y z"), (9, "word " * 50000), (None, "null id"),
    (6, "repeated id"), (6, "repeated id"), (11, "a\x1fb c d e"), (12, "日本 語 の テ キ スト"),
]


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute(pairs, max_bits=2):
    """(doc_id, fingerprint, component) by comparing all fingerprints."""
    prints = [(k, plain(t)) for k, t in pairs]
    known = sorted({f for _, f in prints})
    root = {f: f for f in known}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(known):
        for b in known[i + 1 :]:
            if (a ^ b).bit_count() <= max_bits:
                root[find(a)] = find(b)
    least = {}
    for k, f in prints:
        r = find(f)
        if k is not None:
            least[r] = min(least.get(r, k), k)
    return Counter((k, f"{f:016x}", least.get(find(f))) for k, f in prints)


def test_edge_cases(docs_of):
    got = simhash.near_duplicates(docs_of(SHINGLE_TEXTS)).collect()
    assert Counter(tuple(r) for r in got) == brute(SHINGLE_TEXTS)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = simhash.near_duplicates(docs).collect()
    assert Counter(tuple(r) for r in got) == brute([(r.doc_id, r.text) for r in docs.collect()])


def dense(seed, n):
    """Fingerprints around a few centres, so that keys are shared by many."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(3)]
    out = set()
    while len(out) < n:
        f = rng.choice(centres)
        for _ in range(rng.randrange(6)):
            f ^= 1 << rng.randrange(64)
        out.add(f)
    return sorted(out)


@pytest.mark.parametrize("max_bits,paired", [(2, 64), (2, 2), (1, 2), (3, 3), (0, 1)])
def test_links_connect_what_is_close(spark, max_bits, paired):
    known = dense(max_bits, 250)
    signed = [simhash._signed(f) for f in known]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    found = simhash.links(nodes, max_bits, paired).collect()
    mask = (1 << 64) - 1
    assert all(((r.a & mask) ^ (r.b & mask)).bit_count() <= max_bits for r in found)

    def classes(pairs):
        root = {f: f for f in signed}

        def find(f):
            while root[f] != f:
                f = root[f]
            return f

        for a, b in pairs:
            root[find(a)] = find(b)
        groups = {}
        for f in signed:
            groups.setdefault(find(f), set()).add(f)
        return sorted(map(sorted, groups.values()))

    want = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if ((a & mask) ^ (b & mask)).bit_count() <= max_bits]
    assert classes((r.a, r.b) for r in found) == classes(want)


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(80)}


def test_no_documents(docs_of):
    assert simhash.near_duplicates(docs_of([])).count() == 0
