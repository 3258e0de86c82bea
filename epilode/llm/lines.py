"""Lines that many documents share, found through a sharded minimal perfect hash.

A line's key is the line without white space at its ends, in lower case (A-Z).  Keys of
some length are hashed to 128 bits; one shuffle of these hashes, combined before it,
counts the documents that hold a key.  The distinct hashes of the keys held often enough
are dealt into shards by hash; a task per shard builds a minimal perfect hash: on each
level, hashes that fall alone on a bit of a bit array set it, and the rest go to the next,
smaller level.  The rank of a hash's bit is its slot in the shard's arrays of fingerprints
(64 bits), counts and largest ids.

Documents do not join lines.  They carry the arrays along, in blocks of a stated size, and
look each line up: the bit gives the slot, the fingerprint tells whether the line is the
slot's.  With one block that is a single map over the documents.  With more, each block's
map gives only the row's key and the places of lines to drop, which are joined once.

Another line passes for a slot's with a chance of 2^-64 a look-up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from epilode.llm.common import add_column, fresh_name, map_batches
from epilode.session import cut_lineage

#: White space at a line's ends: blank and the controls from tab to carriage return.
_WHITE = b" \t\n\x0b\x0c\r"
_FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of a code point after its first
#: Hashes of a shard (one task builds it) and of a block (tasks hold one at a time, 21 bytes a line).
SHARD = 1 << 16
BLOCK = 1 << 22
_SPREAD = 2  # bits of a level per hash that reaches it

_COUNTED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("doc_id", pa.int64())])
_SHARDS = pa.schema([
    ("shard", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("fingerprints", pa.binary()),
    ("counts", pa.binary()), ("largest", pa.binary()),
])
_DROPPED = pa.schema([("ka", pa.int64()), ("kb", pa.int64()), ("places", pa.list_(pa.int32()))])
_DECIDED = pa.struct([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("text", pa.string())])


def long_keys(text: bytes, least: int) -> list[tuple[int, bytes]]:
    """(place, key) of the lines whose key has at least `least` code points."""
    out = []
    for place, line in enumerate(text.lower().split(b"\n")):
        if len(line) >= least:
            key = line.strip(_WHITE)
            if len(key) >= least and (key.isascii() or len(key.translate(None, _FOLLOWING)) >= least):
                out.append((place, key))
    return out


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the keys' 128-bit hashes."""
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _mixed(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit hash of both halves for a level."""
    x = a.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (level + 2) & 0xFFFFFFFFFFFFFFFF)
    for y in (b.view(np.uint64), np.uint64(0)):
        x = (x ^ (x >> np.uint64(30)) ^ y) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return x


def perfect_hash(a: np.ndarray, b: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(bits of each level, all levels' bits as words, order of the hashes by slot) for distinct hashes."""
    a, b = np.ascontiguousarray(a), np.ascontiguousarray(b)
    sizes, words, bit = [], [np.zeros(0, "<u8")], np.zeros(len(a), np.int64)
    left, start = np.arange(len(a)), 0
    while len(left):
        size = -(-_SPREAD * len(left) // 64) * 64
        place = (_mixed(a[left], b[left], len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        settled = alone[place]
        bit[left[settled]] = start + place[settled]
        left, start = left[~settled], start + size
        sizes.append(size)
    return sizes, np.concatenate(words), np.argsort(bit)


class LineIndex:
    """Shards side by side: a hash's slot in the arrays, if it is one of theirs."""

    def __init__(self, shards: int, parts: list):
        self.shards, self.part = shards, np.full(shards, -1)
        levels = max((len(p.sizes) for p in parts), default=0)
        self.size = np.zeros((len(parts), levels), np.int64)
        self.start = np.zeros((len(parts), levels), np.int64)
        bits = [np.frombuffer(p.bits, "<u8") for p in parts]
        begin = 0
        for i, (p, w) in enumerate(zip(parts, bits)):
            self.part[p.shard] = i
            self.size[i, : len(p.sizes)] = p.sizes
            self.start[i, : len(p.sizes)] = begin + np.cumsum([0, *p.sizes[:-1]])
            begin += 64 * len(w)
        self.bits = np.concatenate([*bits, np.zeros(0, "<u8")]).astype(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.bits), dtype=np.int64)])

        def joined(name: str, kind: str) -> np.ndarray:
            return np.concatenate([np.zeros(0, kind), *(np.frombuffer(getattr(p, name), kind) for p in parts)])

        self.fingerprints, self.counts, self.largest = joined("fingerprints", "<u8"), joined("counts", "<i4"), joined("largest", "<i8")

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 for those that are not indexed."""
        a, b = np.ascontiguousarray(a), np.ascontiguousarray(b)
        out, part = np.full(len(a), -1), self.part[a % self.shards]
        left = np.flatnonzero(part >= 0)
        for level in range(self.size.shape[1]):
            left = left[self.size[part[left], level] > 0]
            own = part[left]
            place = (_mixed(a[left], b[left], level) % self.size[own, level].astype(np.uint64)).astype(np.int64) + self.start[own, level]
            word, bit = place >> 6, (place & 63).astype(np.uint64)
            found = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            slot = self.before[word] + np.bitwise_count(below)
            out[left[found]] = slot[found]
            left = left[~found]
        met = np.flatnonzero(out >= 0)
        out[met[self.fingerprints[out[met]] != _mixed(a[met], b[met], -1)]] = -1
        return out


def count_lines(docs: DataFrame, least: int, documents: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`a, b, n, largest`: hashes of the keys held by so many documents, with their number and the largest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for row, text in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                own = {key for _, key in long_keys(text, least)}
                keys += own
                rows += [row] * len(own)
            a, b = _hashes(keys)
            ids = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), ids], schema=_COUNTED)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") >= least)
    held = map_batches(texts, run, from_arrow_schema(_COUNTED)).groupBy("a", "b")
    return held.agg(F.count("*").alias("n"), F.max("doc_id").alias("largest")).where((F.col("n") >= documents) & F.col("largest").isNotNull())


def build_index(counted: DataFrame, shard: int = SHARD) -> tuple[DataFrame, int, int]:
    """The shards of an index over counted hashes, one row each, with the numbers of shards and of hashes."""
    total = counted.count()
    shards = max(1, -(-total // shard))

    def build(key: tuple, own: pa.Table) -> pa.Table:
        a, b, n, largest = (own.column(c).to_numpy() for c in ("a", "b", "n", "largest"))
        sizes, words, order = perfect_hash(a, b)
        a, b = np.ascontiguousarray(a[order]), np.ascontiguousarray(b[order])
        arrays = [words, _mixed(a, b, -1).astype("<u8"), np.minimum(n[order], 2**31 - 1).astype("<i4"), largest[order].astype("<i8")]
        return pa.Table.from_pylist([dict(zip(_SHARDS.names, [key[0].as_py(), sizes, *(x.tobytes() for x in arrays)]))], schema=_SHARDS)

    dealt = counted.withColumn("shard", F.pmod("a", F.lit(shards).cast("long")))
    return cut_lineage(dealt.groupBy("shard").applyInArrow(build, from_arrow_schema(_SHARDS)), "line_index"), shards, total


def _hits(index: LineIndex, documents: int, least: int, ids: list, texts: list[bytes]) -> dict[int, list[int]]:
    """Places of the lines to drop, by row."""
    rows, places, keys = [], [], []
    for row, text in enumerate(texts):
        for place, key in long_keys(text, least):
            rows.append(row)
            places.append(place)
            keys.append(key)
    out: dict[int, list[int]] = {}
    slots = index.slots(*_hashes(keys))
    for i in np.flatnonzero(slots >= 0).tolist():
        slot = slots[i]
        if index.counts[slot] >= documents and ids[rows[i]] != index.largest[slot]:
            out.setdefault(rows[i], []).append(places[i])
    return out


def dedup(
    docs: DataFrame, into: str = "lines", least: int = 40, documents: int = 5, id_col: str = "doc_id", text_col: str = "text",
    shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """`docs` and the struct `into`: n_lines, n_dropped and the text without lines that many documents share.

    A text is parted at line feeds; a null or empty one is one empty line.  Keys of at
    least `least` code points in at least `documents` documents lose all their lines but
    those in the document with the largest id; there, all stay, repeated ones too.  Every
    row is a document: equal rows count one by one, and rows that share the largest id all
    keep the line.  A null id is below all others; a key that only rows without id hold is
    never dropped.  A null text stays null.  Texts are read whole; an empty table gives an
    empty one; other columns stay, whatever their names, but `into` must not be taken.
    """
    counted = cut_lineage(count_lines(docs, least, documents, id_col, text_col), "lines")
    parts, shards, total = build_index(counted, shard)
    per_block = max(1, block // shard)
    blocks = max(1, -(-shards // per_block)) if total else 1
    context = docs.sparkSession.sparkContext

    def loaded(i: int):
        """A block of the index, at most `block` lines long, for all tasks."""
        own = parts.where((F.col("shard") >= i * per_block) & (F.col("shard") < (i + 1) * per_block))
        return context.broadcast(LineIndex(shards, own.collect()))

    last, names = loaded(blocks - 1), docs.columns
    ids, texts = F.col(id_col).cast("long"), F.col(text_col)
    places = F.lit(None).cast("array<int>")
    if blocks > 1:
        ka, kb, known = (fresh_name(docs, n) for n in ("ka", "kb", "known"))
        keyed = docs.withColumns({ka: F.xxhash64(ids, texts), kb: F.xxhash64(F.lit(1), texts, ids)})
        found = None
        for i in range(blocks - 1):
            one = _block_places(keyed.select(F.col(ka).alias("ka"), F.col(kb).alias("kb"), ids.alias("id"), texts.alias("text")), loaded(i), documents, least)
            found = one if found is None else found.unionByName(one)
        # Equal rows give equal places, so a frequent key is combined before the shuffle.
        found = found.groupBy("ka", "kb").agg(F.flatten(F.collect_set("places")).alias(known)).withColumnsRenamed({"ka": f"{ka}_", "kb": f"{kb}_"})
        docs = keyed.join(cut_lineage(found, "line_places"), (F.col(ka) == F.col(f"{ka}_")) & (F.col(kb) == F.col(f"{kb}_")), "left")
        places = F.col(known)

    def decide(keys: list, texts: list[str | None], known: list[list[int] | None]) -> list[dict]:
        raw = [(t or "").encode() for t in texts]
        hits, out = _hits(last.value, documents, least, keys, raw), []
        for row, text in enumerate(raw):
            lines, dropped = text.count(b"\n") + 1, {*hits.get(row, ()), *(known[row] or ())}
            kept = texts[row]
            if dropped:
                kept = b"\n".join(line for i, line in enumerate(text.split(b"\n")) if i not in dropped).decode()
            out.append({"n_lines": lines, "n_dropped": len(dropped), "text": kept})
        return out

    return add_column(docs, names, into, _DECIDED, [ids, texts, places], decide)


def _block_places(keyed: DataFrame, index, documents: int, least: int) -> DataFrame:
    """`ka, kb, places` of the rows that hold lines to drop by one block of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ka, kb, ids, texts = batch.columns
            hits = _hits(index.value, documents, least, ids.to_pylist(), [t or b"" for t in texts.cast(pa.binary()).to_pylist()])
            rows = pa.array(list(hits), pa.int64())
            yield pa.RecordBatch.from_arrays([ka.take(rows), kb.take(rows), pa.array(hits.values(), pa.list_(pa.int32()))], schema=_DROPPED)

    return map_batches(keyed, run, from_arrow_schema(_DROPPED))
