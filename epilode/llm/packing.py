"""Best-fit decreasing packing of token sequences.

Best-fit decreasing looks only at lengths, and equal lengths are interchangeable.
The packing of a corpus of any size is therefore decided on its histogram of
lengths, which has at most `capacity` rows: the driver walks it from long to short
and asks a segment tree over remaining capacities for the tightest open bin, once
for each run of equal documents.  The outcome is a table of runs ("the documents of
length 700 numbered 10 to 99 go two by two into bins 31 onwards, from place 2600"),
at most `50 * capacity` rows.  Documents are then numbered within their length and
joined with the runs by tasks.  The result equals best-fit decreasing over the whole
corpus.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from epilode.llm.common import as_batch, map_batches
from epilode.session import cut_lineage

CAPACITY = 4096
END = 1
# Words whose ids a worker remembers; a full table is emptied, which costs time only.
_REMEMBERED = 500_000
_JOINED = 1000  # new words encoded in one call
_WORD_END = "</w>"
_MARKS = r"[!-&(-/:-@\[-`{-~]"  # ASCII without letters, digits and the apostrophe


def _unfolded_end() -> str:
    """Letters whose normalised lower case ends in something else: a combining mark, which joins the marks behind it."""
    letters = (chr(c) for part in (range(0x80, 0x3000), range(0xF900, 0xFB50)) for c in part if chr(c).isalpha())
    return "".join(c for c in letters if not unicodedata.normalize("NFC", c).lower()[-1].isalnum())


# Marks between a letter and white space are a token run of their own.
_AFTER_LETTER = re.compile(rf"{_MARKS}(?<=[^\W\d_{_unfolded_end()}].){_MARKS}*(?=[ \n])", re.DOTALL)
_ONLY_MARKS = re.compile(rf"{_MARKS}+")


class _Memory(dict):
    """Ids by word; unknown words are noted."""

    def __init__(self):
        self.unknown: list[str] = []

    def __missing__(self, word: str) -> None:
        self.unknown.append(word)


class WordTokenizer:
    """Token ids of whole texts, for tokenizers that normalise (NFC), lower-case and drop white space before merging.

    Such a tokenizer never merges across a blank or line end, so a text's ids are the
    ids of its blank-parted words put together; each word is encoded once per worker.
    Ids are bytes, four per id, little-endian.
    """

    _shared: dict[str, WordTokenizer] = {}

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(definition)
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self.words = _Memory()

    @classmethod
    def of(cls, path: str, definition: str | None = None) -> WordTokenizer:
        """The process's own instance for a tokenizer file, kept between tasks."""
        if path not in cls._shared:
            cls._shared[path] = cls(definition or Path(path).read_text(encoding="utf-8"))
        return cls._shared[path]

    def _learn(self, unknown: set[str]) -> None:
        cased, plain, other = {}, [], []
        for word in unknown:
            if word.isalpha():
                if word.isascii() and not word.islower():
                    cased[word] = word.lower()
                else:
                    plain.append(word)
            elif _ONLY_MARKS.fullmatch(word) and "<|" not in word:
                plain.append(word)
            else:
                other.append(word)
        plain += {low for low in cased.values() if low not in self.words and low not in unknown}
        for at in range(0, len(plain), _JOINED):
            self._learn_joined(plain[at : at + _JOINED])
        self._learn_each(other)
        for word, low in cased.items():
            self.words[word] = self.words[low]

    def _learn_joined(self, words: list[str]) -> None:
        """Words of one run of tokens each; a run's last token is marked in the vocabulary."""
        ids = np.array(self.model.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(ends) != len(words) or ends[-1] != 4 * len(ids):
            self._learn_each(words)
            return
        raw, start = ids.tobytes(), 0
        for word, end in zip(words, ends):
            self.words[word] = raw[start:end]
            start = end

    def _learn_each(self, words: list[str]) -> None:
        for word, encoded in zip(words, self.model.encode_batch_fast(words, add_special_tokens=False)):
            self.words[word] = np.array(encoded.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        known, unknown = self.words.__getitem__, self.words.unknown
        for text in texts:
            if "<|" not in text:
                text = _AFTER_LETTER.sub(r" \g<0>", text)
            words = text.replace("\n", " ").split(" ")
            ids = list(map(known, words))
            if unknown:
                distinct = set(unknown)
                unknown.clear()
                if len(self.words) + 2 * len(distinct) > _REMEMBERED:
                    self.words.clear()
                    distinct = set(words)
                self._learn(distinct)
                ids = list(map(known, words))
            yield b"".join(ids)


def tokenize(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end: int = END, with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most `capacity` tokens: `doc_id, piece, start, length, ids_crc32[, ids], part, place`.

    `tokenizer` is a tokenizer file whose pre-tokenizer drops white space; only the driver reads it.  `part` and
    `place` number the pieces of one length: `place` counts within a task's `part`.
    Null texts count as empty, and an empty text is the one token `end`.  Every row of
    `docs` is a document of its own, also where ids are null or repeated.
    """
    schema = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else []),
        ("part", pa.int32()), ("place", pa.int64()),
    ])
    last = end.to_bytes(4, "little")
    definition = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = WordTokenizer.of(tokenizer, definition.value)
        seen: dict[int, int] = {}
        for batch in batches:
            out = []
            texts = (t or "" for t in batch.column(1).to_pylist())
            for key, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts)):
                ids += last
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    length = len(cut) // 4
                    place = seen.get(length, 0)
                    seen[length] = place + 1
                    out.append((key, piece, at // 4, length, zlib.crc32(cut), *([cut] if with_ids else []), part, place))
            yield as_batch(out, schema)

    return map_batches(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, from_arrow_schema(schema))


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity; a leaf is set while bins with that room are open."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.marks = [False] * (2 * self.leaves)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, room: int, on: bool) -> None:
        node = room + self.leaves
        while node and self.marks[node] != on:
            self.marks[node] = on
            node >>= 1
            on = on or (node > 0 and (self.marks[2 * node] or self.marks[2 * node + 1]))

    def add(self, room: int, first: int, count: int) -> None:
        """Open `count` bins numbered from `first` with `room` left."""
        if count and room:
            self.bins[room].append((first, count))
            self._mark(room, True)

    def take(self, room: int) -> tuple[int, int]:
        """Remove and return one range of bins with exactly `room` left."""
        found = self.bins[room].pop()
        if not self.bins[room]:
            self._mark(room, False)
        return found

    def tightest(self, length: int) -> int | None:
        """The least room of at least `length` among open bins, in logarithmic time."""
        node = length + self.leaves
        if node >= 2 * self.leaves:
            return None
        if self.marks[node]:
            return length
        while node > 1 and not (node % 2 == 0 and self.marks[node + 1]):
            node >>= 1
        if node <= 1:
            return None
        node += 1
        while node < self.leaves:
            node = 2 * node if self.marks[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a histogram {length: count}, as runs.

    A run (length, first, last, bin, each, offset) places the documents of that length
    numbered first..last-1, `each` to a bin, into consecutive bins from `bin`, starting
    at `offset` there.  A range of bins loses at least half of its room whenever a run
    uses it up, and a length ends at most four new ranges, so there are fewer than
    4 * (log2(capacity) + 1) runs for each length.
    """
    tree, runs, bins = CapacityTree(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        done, count = 0, histogram[length]
        while done < count:
            room = tree.tightest(length)
            if room is None:
                room, first, open_ = capacity, bins, None
            else:
                first, open_ = tree.take(room)
            each = room // length
            use = -(-(count - done) // each)
            if open_ is None:
                bins += use
            else:
                use = min(use, open_)
                tree.add(room, first + use, open_ - use)
            placed = min(count - done, use * each)
            runs.append((length, done, done + placed, first, each, capacity - room))
            full, rest = divmod(placed, each)
            tree.add(room - each * length, first, full)
            if rest:
                tree.add(room - rest * length, first + full, 1)
            done += placed
    return runs


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add `sequence_id` and `offset` to pieces from `tokenize`.

    `pieces` must be a written table, since it is read several times.  Lengths are
    counted by (length, part), so a length that a third of the rows share is spread
    over as many tasks as it came from.
    """
    spark = pieces.sparkSession
    counts = cut_lineage(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    total = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `capacity` rows
    runs = best_fit_runs({r.length: r.n for r in total}, capacity)
    plan = spark.createDataFrame(
        runs, "length long, first long, last long, bin long, each long, base long"
    )
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    number = F.col("place") + F.col("earlier")
    numbered = pieces.join(starts, ["length", "part"]).withColumn("number", number).drop("earlier", "part", "place")
    step = F.col("number") - F.col("first")
    # The runs are bounded by the capacity, not by the data.
    placed = numbered.join(
        F.broadcast(plan.withColumnRenamed("length", "run_length")),
        (F.col("length") == F.col("run_length")) & (F.col("number") >= F.col("first")) & (F.col("number") < F.col("last")),
    )
    return placed.select(
        *[c for c in pieces.columns if c not in ("part", "place")],
        (F.col("bin") + F.expr("(number - first) div each")).alias("sequence_id"),
        (F.col("base") + step % F.col("each") * F.col("length")).alias("offset"),
    )


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
    capacity: int = CAPACITY, end: int = END, with_ids: bool = False,
) -> DataFrame:
    """Pack documents into sequences of at most `capacity` tokens by best-fit decreasing.

    Returns one row per piece: `doc_id, piece, start, length, ids_crc32[, ids],
    sequence_id, offset`.  See `tokenize` for nulls, empty texts and repeated rows; a
    document longer than `capacity` is cut, all others stay whole.  Other columns of
    `docs` are not read.  No rows give no rows.
    """
    pieces = cut_lineage(tokenize(docs, tokenizer, id_col, text_col, capacity, end, with_ids), "pieces")
    return place(pieces, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: `sequence_id, n_tokens, ids` (little-endian, four bytes each).

    `packed` comes from `pack(..., with_ids=True)`.  A sequence has at most `capacity` pieces.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    grouped = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return grouped.select("sequence_id", "n_tokens", joined.alias("ids"))
