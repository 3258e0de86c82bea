"""Benchmark passages in documents, by a prefix-filtered set join.

A benchmark item is cut into windows of `window` consecutive words.  A window occurs in
a document only if all of its shingles do, so its rarest shingle alone is the necessary
prefix: shingles are ordered by their frequency in the whole corpus, and documents are
joined with windows on that one shingle.  The shingle's place in the window then bounds
where the window would start and end; candidates that stick out of the document are
dropped, and the others are compared word by word.

The join runs on the documents' side, without a shuffle: the windows are broadcast.  Their
number is not bounded, so they are dealt into blocks of about `BLOCK` (window, item)
pairs, and the documents are passed over once per block.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, from_arrow_type

from epilode.llm.common import add_column, arrow_map, as_batch, map_batches
from epilode.session import cut_lineage

WINDOW = 10
SHINGLE = 3
BLOCK = 100_000
_GROUP = 1 << 21  # bytes of text whose words are looked up at a time
_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_EDGE = b"\x01"  # stands between documents; no word holds it

SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = pa.struct([("n_words", pa.int64()), ("hits", SPANS), ("items", pa.list_(pa.string()))])


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a UTF-8 text: runs of 0-9, letters a-z and all beyond ASCII."""
    return (text or b"").translate(_LETTERS).split()


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct (`words`, `item`): every run of `window` words; a shorter item is one run.

    Items without words have none.  Rows with the same id are one item.
    """
    schema = pa.schema([("words", pa.binary()), ("item", pa.string())])

    def rows(batch: pa.RecordBatch) -> list[tuple]:
        out = set()
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = words(text)
            for at in range(max(1, len(own) - window + 1) if own else 0):
                out.add((b" ".join(own[at : at + window]), key))
        return list(out)

    chosen = items.select(F.col(id_col).cast("string"), F.col(text_col).cast("binary"))
    return arrow_map(chosen, schema, rows).distinct()


class WindowIndex:
    """A block of windows as arrays, looked up by their rarest shingle."""

    def __init__(self, pairs: list[tuple[bytes, str | None]], window: int, shingle: int):
        texts = sorted({w for w, _ in pairs})
        self.items = sorted({i for _, i in pairs if i is not None})
        numbers = {w: n for n, w in enumerate(texts)}
        places = {i: n for n, i in enumerate(self.items)}
        own = sorted((numbers[w], places[i]) for w, i in pairs if i is not None)
        self.own_window = np.array([w for w, _ in own], np.int64)
        self.own_item = np.array([i for _, i in own], np.int64)
        split = [w.split(b" ") for w in texts]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for s in split for w in s}))}
        self.base = len(self.vocabulary) + 1
        # A shingle's code must fit 63 bits.
        self.shingle = min(shingle, int(63 // max(1, self.base.bit_length())))
        self.sizes = np.array([len(s) for s in split], np.int64)
        self.ids = np.full((len(split), window), -9, np.int64)
        for n, s in enumerate(split):
            self.ids[n, : len(s)] = [self.vocabulary[w] for w in s]
        # All shingles of every window; windows shorter than a shingle are one.
        codes, of, at = [], [], []
        for n, s in enumerate(split):
            width = min(self.shingle, len(s))
            for k in range(len(s) - width + 1):
                codes.append(self._code(self.ids[n, k : k + width]))
                of.append(n)
                at.append(k)
        self.vocabulary[_EDGE] = -2
        self.codes, self.of, self.at = np.array(codes, np.int64), np.array(of, np.int64), np.array(at, np.int64)
        self.known = np.unique(self.codes)
        self.widths = sorted(set(np.minimum(self.sizes, self.shingle).tolist()))
        self.prefix = self.starts = self.ends = None

    def _code(self, ids: np.ndarray) -> int:
        code = 0
        for i in ids.tolist():
            code = code * self.base + i + 1
        return code

    def order(self, frequency: dict[int, int]) -> None:
        """Keep each window's rarest shingle (the first of the least code among equals)."""
        counts = np.array([frequency.get(c, 0) for c in self.codes.tolist()], np.int64)
        by = np.lexsort((self.at, self.codes, counts, self.of))
        first = np.unique(self.of[by], return_index=True)[1] if len(by) else np.zeros(0, np.int64)
        chosen = by[first]
        chosen = chosen[np.argsort(self.codes[chosen], kind="stable")]
        self.prefix, self.starts = np.unique(self.codes[chosen], return_index=True)
        self.ends = np.append(self.starts[1:], len(chosen)) if len(chosen) else self.starts
        self.of, self.at = self.of[chosen], self.at[chosen]
        self.codes = self.known = None

    def read(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the texts, -1 for unknown and -2 after each text; the places of the latter."""
        joined = (b" " + _EDGE + b" ").join((t or b"").translate(_LETTERS) for t in texts) + b" " + _EDGE
        parts = joined.split()
        ids = np.fromiter(map(self.vocabulary.get, parts, repeat(-1)), np.int64, len(parts))
        return ids, np.flatnonzero(ids == -2)

    def shingles(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, codes) of the runs of known words, for each width that windows have."""
        known = ids >= 0
        for width in self.widths:
            n = len(ids) - width + 1
            if n <= 0:
                continue
            whole = known[:n].copy()
            for k in range(1, width):
                whole &= known[k : k + n]
            at = np.flatnonzero(whole)
            code = np.zeros(len(at), np.int64)
            for k in range(width):
                code = code * self.base + ids[at + k] + 1
            yield at, code

    def count(self, texts: list[bytes | None], counts: np.ndarray) -> None:
        ids, _ = self.read(texts)
        for _, code in self.shingles(ids):
            where = np.searchsorted(self.known, code)
            where[where == len(self.known)] = 0
            hit = where[self.known[where] == code] if len(self.known) else where[:0]
            counts += np.bincount(hit, minlength=len(counts))

    def find(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """(number of words, hit ranges of words, items) for each text."""
        ids, edges = self.read(texts)
        begins = np.append(0, edges[:-1] + 1)
        starts, found = [], []
        for at, code in self.shingles(ids) if len(self.prefix) else ():
            where = np.searchsorted(self.prefix, code)
            where[where == len(self.prefix)] = 0
            hit = np.flatnonzero(self.prefix[where] == code)
            # Every window of the shingle, at the place that it would have there.
            group = where[hit]
            repeats = self.ends[group] - self.starts[group]
            total = int(repeats.sum())
            entry = np.repeat(self.starts[group], repeats) + np.arange(total) - np.repeat(np.cumsum(repeats) - repeats, repeats)
            window, start = self.of[entry], np.repeat(at[hit], repeats) - self.at[entry]
            # It has to lie between the document's edges.
            doc = np.searchsorted(edges, np.repeat(at[hit], repeats))
            inside = (start >= begins[doc]) & (start + self.sizes[window] <= edges[doc])
            window, start = window[inside], start[inside]
            # Word by word.
            for k in range(self.ids.shape[1]):
                longer = self.sizes[window] > k
                same = ~longer
                same[longer] = ids[start[longer] + k] == self.ids[window[longer], k]
                window, start = window[same], start[same]
            starts.append(start)
            found.append(window)
        start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        window = np.concatenate(found) if found else np.zeros(0, np.int64)
        out = [(int(e - b), [], []) for b, e in zip(begins, edges)]
        if not len(start):
            return out
        cover = np.zeros(len(ids) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + self.sizes[window], -1)
        covered = np.cumsum(cover) > 0
        change = np.flatnonzero(np.diff(np.concatenate(([False], covered))))
        for b, e in change.reshape(-1, 2).tolist():
            doc = int(np.searchsorted(edges, b))
            out[doc][1].append((b - int(begins[doc]), e - int(begins[doc])))
        # Distinct (document, window), then their items.
        pairs = np.unique(np.searchsorted(edges, start) * len(self.sizes) + window)
        doc, window = pairs // len(self.sizes), pairs % len(self.sizes)
        low, high = np.searchsorted(self.own_window, window), np.searchsorted(self.own_window, window, "right")
        repeats = high - low
        total = int(repeats.sum())
        entry = np.repeat(low, repeats) + np.arange(total) - np.repeat(np.cumsum(repeats) - repeats, repeats)
        if total:
            named = np.unique(np.repeat(doc, repeats) * len(self.items) + self.own_item[entry])
            for d, i in zip((named // len(self.items)).tolist(), (named % len(self.items)).tolist()):
                out[d][2].append(self.items[i])
        return out


def _groups(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `_GROUP` bytes."""
    first, size = 0, 0
    for n, text in enumerate(texts):
        size += len(text or b"")
        if size >= _GROUP:
            yield first, n + 1
            first, size = n + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _frequencies(docs: DataFrame, index: WindowIndex) -> dict[int, int]:
    """How often each shingle of the block occurs in all documents; `docs` is the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    schema = pa.schema([("code", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(shared.value.known), np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for first, last in _groups(texts):
                shared.value.count(texts[first:last], counts)
        some = np.flatnonzero(counts)
        yield as_batch(list(zip(shared.value.known[some].tolist(), counts[some].tolist())), schema)

    partial = map_batches(docs, run, from_arrow_schema(schema))
    return {r.code: r.n for r in partial.groupBy("code").agg(F.sum("n").alias("n")).collect()}


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges, in order; ranges that touch become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def mark(
    docs: DataFrame, items: DataFrame, into: str = "contamination", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK,
) -> DataFrame:
    """`docs` and a struct column `into`: `n_words, hits, items`.

    `hits` are the ranges (start, end) of words that lie in an occurrence of a window,
    `items` the ids, as sorted strings, of items with occurring windows.  Null and empty
    texts have no words.  Items without words have no window; an item with a null id
    marks words but is not listed; repeated items and documents are no special case: every
    row of `docs` is judged alone and keeps all its columns.  `into` must be a new name.
    Without items nothing is hit.
    """
    if into in docs.columns:
        raise ValueError(f"{into} is a column of the documents")
    spark = docs.sparkSession
    pairs = cut_lineage(windows(items, item_id, item_text, window), "windows")
    blocks = max(1, -(-pairs.count() // block))
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("words", "item"), F.lit(blocks)))
    columns, text = docs.columns, F.col(text_col).cast("binary")
    marked = docs
    for number in range(blocks):
        # About `block` rows, however many there are in all.
        part = [(bytes(r.words), r.item) for r in dealt.where(F.col("block") == number).select("words", "item").collect()]
        index = WindowIndex(part, window, shingle)
        index.order(_frequencies(docs.select(text), index))
        shared = spark.sparkContext.broadcast(index)

        def values(texts: list, before: list, shared=shared) -> list[dict]:
            out = []
            found = (f for first, last in _groups(texts) for f in shared.value.find(texts[first:last]))
            for (n, hits, names), old in zip(found, before):
                if old:
                    hits = merge_ranges([*hits, *((h["start"], h["end"]) for h in old["hits"])])
                    names = sorted({*names, *old["items"]})
                out.append({"n_words": n, "hits": [{"start": s, "end": e} for s, e in hits], "items": names})
            return out

        before = F.col(into) if number else F.lit(None).cast(from_arrow_type(FOUND))
        marked = add_column(marked, columns, into, FOUND, [text, before], values)
        if number + 1 < blocks:
            marked = cut_lineage(marked, "marked")
    return marked
