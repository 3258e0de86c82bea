import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as entry
from epilode.llm import lines
from oracle import compare, connect


def brute(pairs, least=40, documents=5):
    """(doc_id, n_lines, n_dropped, text) by the rule itself."""

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    held = {}
    for doc, text in pairs:
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= least:
                held.setdefault(k, []).append(doc)
    keeper = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= documents}
    out = []
    for doc, text in pairs:
        whole = (text or "").split("\n")
        kept = [line for line in whole if keeper.get(key(line)) in (None, doc)]
        out.append((doc, len(whole), len(whole) - len(kept), "\n".join(kept) if text is not None else None))
    return sorted(out, key=repr)


SHARED = [f"Shared line number {i} that stands in many of the documents" for i in range(40)]
NEAR = "ä" * 38


def corpus():
    rng = np.random.default_rng(5)
    pairs = []
    for i in range(300):
        own = [f"line {i}-{j} " + " ".join(map(str, rng.integers(0, 1000, 12))) for j in range(rng.integers(0, 4))]
        shared = [SHARED[int(k)] for k in rng.integers(0, 40, rng.integers(0, 4))]
        shared += [SHARED[0]] if i % 3 == 0 else []  # a third of the rows hold one line
        text = [f"  {x.upper()}\t" if rng.random() < 0.3 else x for x in shared + own]
        rng.shuffle(text)
        pairs.append((i, "\n".join(text)))
    return pairs


ODD = [
    (None, SHARED[0]), (None, "only without id, and long enough to be counted"), (7, None), (8, ""), (9, "\n\n"), (10, "\r\n" + SHARED[1] + "\r"),
    (11, SHARED[1] + "\n" + SHARED[1]), (11, SHARED[1] + "\n" + SHARED[1]), (12, SHARED[1]), (13, SHARED[1]), (500, SHARED[1] + "\nx"), (500, SHARED[1]),
    *[(20 + i, f"{NEAR}é{'ü' if i % 2 else ''}") for i in range(12)],  # 39 and 40 code points, over 40 bytes
    *[(40 + i, f" {NEAR}ü") for i in range(6)],  # a blank that is not stripped
    (60, SHARED[2] + " " + "word " * 200_000 + "\n" + SHARED[0]), *[(None, "only without id, and long enough to be counted")] * 6,
]


def got(docs_of, pairs, **sizes):
    found = lines.dedup(docs_of(pairs), **sizes)
    return sorted(((r.doc_id, r.lines.n_lines, r.lines.n_dropped, r.lines.text) for r in found.collect()), key=repr)


@pytest.mark.parametrize("sizes", [{}, {"shard": 4, "block": 4}, {"shard": 3, "block": 12}])
def test_equals_brute_force(docs_of, sizes):
    pairs = corpus() + ODD
    want = brute(pairs)
    assert sum(w[2] for w in want) > 300
    assert got(docs_of, pairs, **sizes) == want


def test_other_columns_stay(docs_of):
    found = lines.dedup(docs_of([(1, SHARED[0]), (2, None)]), into="kept")
    assert found.columns == ["doc_id", "text", "source", "lang", "fp", "sequence_id", "n", "kept"]
    with pytest.raises(ValueError):
        lines.dedup(docs_of([(1, "a")]), into="source")


def test_empty_table(docs_of):
    assert got(docs_of, []) == []


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 400), st.integers(1, 5), st.integers(0, 2**32 - 1))
def test_hash_is_minimal_and_perfect(n, shards, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, n))
    a[: n // 3] = a[:1] if n else 0  # halves may be equal; whole hashes are not
    parts, where = [], []
    for shard in range(shards):
        own = np.flatnonzero(a % shards == shard)
        if len(own):
            sizes, words, order = lines.perfect_hash(a[own], b[own])
            rows = own[order]
            arrays = [lines._mixed(a[rows], b[rows], -1), np.full(len(rows), 9, "<i4"), rows.astype("<i8")]
            parts.append(type("Part", (), dict(zip(
                ("shard", "sizes", "bits", "fingerprints", "counts", "largest"), (shard, sizes, words.tobytes(), *(x.tobytes() for x in arrays))))))
            where += rows.tolist()
    index = lines.LineIndex(shards, parts)
    slots = index.slots(a, b)
    assert sorted(slots.tolist()) == list(range(n)) and index.largest[slots].tolist() == list(range(n))
    assert (index.slots(a, b + 1) == -1).all()


def test_index_is_small():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, 20_000))
    assert 64 * len(lines.perfect_hash(a, b)[1]) < 5 * 20_000


def test_no_line_is_joined(spark, docs_of):
    plan = lines.dedup(docs_of(corpus()))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan.replace("Exchange RoundRobinPartitioning", "")


def test_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(entry.queries()["op13_lines"](spark, folder), connect(folder), entry.oracle_sql()["op13_lines"]) is None


def test_query_is_brute_force(spark):
    folder = "/root/testdata/sf0.1"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = sorted((d, n, k, hashlib.sha256((t or "").encode()).hexdigest()) for d, n, k, t in brute(docs))
    assert sorted(tuple(r) for r in entry.queries()["op13_lines"](spark, folder).collect()) == want
