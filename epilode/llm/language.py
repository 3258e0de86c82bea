"""Language identification with unigram piece models over a fixed public vocabulary.

A language is a distribution over the pieces of a vocabulary.  The probability of a
word is the sum over all ways to cut it into pieces, which a forward pass adds up; a
text's is the product over its words (runs of letters, lower-cased, with the
vocabulary's word mark in front).  The piece probabilities are learned by expectation
maximisation over the same segmentations: every round is a Spark job over the
distinct words of the training sample, and only sums by (language, piece) come back.

Words are scored once per worker and then looked up, so scoring a text costs one look
at each of its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from epilode.llm.common import add_column, as_batch, map_batches
from epilode.session import cut_lineage

#: Documents per language that the model is fitted on, in expectation.
SAMPLE = 500
ROUNDS = 3
UNDETERMINED = "und"
_MARK = "▁"
_LONGEST_PIECE = 16
_LONGEST_WORD = 32  # longer ones are scored on their own, and not learned from
_REMEMBERED = 300_000
_GROUP = 1 << 20  # characters of text whose new words are scored together
_UNKNOWN = 1e-7  # probability of a letter that no piece holds, in every language
_SMOOTHING = 0.01
_LETTERS = re.compile(r"[^\W\d_]+")
HELD_OUT = 2


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased; a run may hold numerals that are no digits."""
    return _LETTERS.findall((text or "").lower())


def has_letter(words: list[str]) -> bool:
    return any(w.isalpha() or any(map(str.isalpha, w)) for w in words)


def vocabulary(path: str) -> list[str]:
    """Lower-case pieces of letters of a sentencepiece model, with or without the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    kept = {_MARK}
    for piece in pieces:
        letters = piece.removeprefix(_MARK)
        if letters.isalpha() and letters == letters.lower() and len(piece) <= _LONGEST_PIECE:
            kept.add(piece)
    return sorted(kept)


class PieceModel:
    """Piece probabilities, one column per language; two more rows: no piece, unknown letter."""

    def __init__(self, pieces: list[str], languages: list[str], probabilities: np.ndarray):
        self.pieces, self.languages = pieces, languages
        self.table = np.vstack([probabilities, np.zeros(len(languages)), np.full(len(languages), _UNKNOWN)])
        self.numbers: dict[str, int] | None = None
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)))
        self.used = 0

    def __getstate__(self):
        return {"pieces": self.pieces, "languages": self.languages, "table": self.table}

    def __setstate__(self, state):
        self.__init__(state["pieces"], state["languages"], state["table"][:-2])

    def _prefixes(self) -> dict[str, int]:
        """Numbers of the pieces, and -1 for what only begins one."""
        if self.numbers is None:
            self.numbers = {p[:k]: -1 for p in self.pieces for k in range(1, len(p))}
            self.numbers.update((p, n) for n, p in enumerate(self.pieces))
        return self.numbers

    def lattice(self, words: list[str]) -> np.ndarray:
        """Piece numbers of all spans of marked words of one length, a row each, in the order of `_layout`.

        A letter without a piece is unknown.
        """
        get, size = self._prefixes().get, len(words[0]) + 1
        layout = _layout(size)
        first = {i: k for i, j, k in reversed(layout)}
        none, unknown = len(self.pieces), len(self.pieces) + 1
        # Each piece as one number: its column times `step`, plus its own number.
        step, codes, base = none + 2, [], 0
        starts = [(i, (first[i] - i - 1) * step) for i in range(size)]
        add, row = codes.append, len(layout) * step
        for word in words:
            s = _MARK + word
            for i, k in starts:
                for j in range(i + 1, size + 1):
                    found = get(s[i:j])
                    if found is None:
                        break
                    if found >= 0:
                        add(base + k + j * step + found)
            base += row
        spans = np.full(len(words) * len(layout), none, np.int64)
        at, number = np.divmod(np.array(codes, np.int64), step)
        spans[at] = number
        spans = spans.reshape(len(words), len(layout))
        for i, j, k in layout:
            if j == i + 1:
                spans[spans[:, k] == none, k] = unknown
        return spans

    def forward(self, spans: np.ndarray, size: int, table: np.ndarray) -> list[np.ndarray]:
        """Summed probability of all segmentations up to each place; `table` rows by piece."""
        sums = [np.ones((len(spans), *table.shape[1:]))] + [0.0] * size
        for i, j, k in _layout(size):
            sums[j] = sums[j] + sums[i] * table[spans[:, k]]
        return sums

    def score_new(self, words: list[str]) -> np.ndarray:
        """Log probabilities of words, by language."""
        out = np.zeros((len(words), len(self.languages)))
        by_size: dict[int, list[int]] = {}
        for n, word in enumerate(words):
            by_size.setdefault(len(word), []).append(n)
        for size, where in by_size.items():
            if size > _LONGEST_WORD:
                for n in where:
                    out[n] = self.score_long(words[n])
                continue
            for at in range(0, len(where), 5000):
                part = where[at : at + 5000]
                spans = self.lattice([words[n] for n in part])
                out[part] = np.log(self.forward(spans, size + 1, self.table)[-1])
        return out

    def score_long(self, word: str) -> np.ndarray:
        """The same for a word of any length, in rescaled steps."""
        get, s = self._prefixes().get, _MARK + word
        sums, scale = [np.ones(len(self.languages))], np.zeros(len(self.languages))
        for j in range(1, len(s) + 1):
            total = np.zeros(len(self.languages))
            for back in range(1, min(j, _LONGEST_PIECE) + 1):
                piece = get(s[j - back : j], -1)
                if piece < 0 and back == 1:
                    piece = len(self.pieces) + 1
                if piece >= 0:
                    total = total + sums[-back] * self.table[piece]
            sums.append(total)
            sums = sums[-_LONGEST_PIECE:]
            if j % 4 == 0:
                by = sums[-1]
                scale += np.log(by)
                sums = [x / by for x in sums]
        return scale + np.log(sums[-1])

    def log_likelihoods(self, texts: list[list[str]]) -> Iterator[np.ndarray]:
        """Log probabilities of texts, given as words, by language."""
        new = set().union(*texts).difference(self.known)
        if len(self.known) + len(new) > _REMEMBERED:
            self.known.clear()
            self.used = 0
            new = set().union(*texts)
        ordered = list(new)
        for at in range(0, len(ordered), 100_000):
            self._remember(ordered[at : at + 100_000])
        for words in texts:
            numbers = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            yield self.scores[numbers].sum(axis=0)

    def _remember(self, words: list[str]) -> None:
        if self.used + len(words) > len(self.scores):
            self.scores = np.resize(self.scores, (max(2 * len(self.scores), self.used + len(words), 4096), len(self.languages)))
        self.scores[self.used : self.used + len(words)] = self.score_new(words)
        self.known.update(zip(words, range(self.used, self.used + len(words))))
        self.used += len(words)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, its posterior under equal priors) of each text; undetermined without letters or languages."""
        out, part, size = [], [], 0
        for n, text in enumerate(texts):
            part.append(words_of(text))
            size += len(text or "")
            if size >= _GROUP or n + 1 == len(texts):
                for words, total in zip(part, self.log_likelihoods(part)):
                    if self.languages and has_letter(words):
                        best = int(total.argmax())  # the first in order among equals
                        out.append((self.languages[best], float(1.0 / np.exp(total - total[best]).sum())))
                    else:
                        out.append((UNDETERMINED, 0.0))
                part, size = [], 0
        return out


_LAYOUTS: dict[int, list[tuple[int, int, int]]] = {}


def _layout(size: int) -> list[tuple[int, int, int]]:
    """(i, j, column) of the spans of a string, in the order of `spans`."""
    if size not in _LAYOUTS:
        spans = [(i, j) for i in range(size) for j in range(i + 1, min(size, i + _LONGEST_PIECE) + 1)]
        _LAYOUTS[size] = [(i, j, k) for k, (i, j) in enumerate(spans)]
    return _LAYOUTS[size]


def _expected(shared: Broadcast, words: list[str], codes: list[int], counts: list[int], into: np.ndarray) -> None:
    """Add the expected piece counts of (word, language, count) rows."""
    model: PieceModel = shared.value
    by_size: dict[int, list[int]] = {}
    for n, word in enumerate(words):
        by_size.setdefault(len(word), []).append(n)
    for size, where in by_size.items():
        spans = model.lattice([words[n] for n in where])
        lang = np.array([codes[n] for n in where])
        weight = np.array([counts[n] for n in where], float)
        layout = _layout(size + 1)
        p = model.table[spans, lang[:, None]]
        ahead = [np.ones(len(where))] + [np.zeros(len(where)) for _ in range(size + 1)]
        for i, j, k in layout:
            ahead[j] += ahead[i] * p[:, k]
        behind = [np.zeros(len(where)) for _ in range(size + 1)] + [np.ones(len(where))]
        for i, j, k in reversed(layout):
            behind[i] += p[:, k] * behind[j]
        for i, j, k in layout:
            np.add.at(into, (spans[:, k], lang), weight * ahead[i] * p[:, k] * behind[j] / ahead[-1])


def is_held_out(id_col: Column) -> Column:
    """The test fold: crc32 of the id as text, modulo 4, is 2; ids that are null are in no fold."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4 == HELD_OUT


def train(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample: int = SAMPLE, rounds: int = ROUNDS,
) -> PieceModel:
    """Fit the piece probabilities on labelled documents outside the test fold.

    About `sample` documents per language are used, chosen by a hash of the id.  Null
    texts and labels teach nothing; a language whose documents hold no letters is not
    learned.  A row without an id is in no fold, and teaches nothing either, and so do
    words of over 32 letters.  An empty table gives a model without languages.  The model has a row per
    piece and a column per language.
    """
    spark = docs.sparkSession
    labelled = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")
    ).where(~is_held_out(F.col("id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, sample / n)).otherwise(share)
    chosen = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("word", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield as_batch([(lang, w) for w in words_of(text) if len(w) <= _LONGEST_WORD], schema)

    found = map_batches(chosen, run, from_arrow_schema(schema))
    counts = cut_lineage(found.groupBy("lang", "word").agg(F.count("*").alias("n")), "words")
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())
    pieces = vocabulary(vocabulary_path)
    table = np.full((len(pieces), len(languages)), 1 / len(pieces))
    model = PieceModel(pieces, languages, table)
    sums = pa.schema([("piece", pa.int64()), ("lang", pa.int64()), ("n", pa.float64())])
    for _ in range(rounds if languages else 0):
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            into = np.zeros_like(shared.value.table)
            codes = {lang: n for n, lang in enumerate(shared.value.languages)}
            for batch in batches:
                lang, word, n = (batch.column(k).to_pylist() for k in range(3))
                _expected(shared, word, [codes[x] for x in lang], n, into)
            piece, lang = np.nonzero(into[:-2])
            yield as_batch(list(zip(piece.tolist(), lang.tolist(), into[piece, lang].tolist())), sums)

        expected = map_batches(counts.select("lang", "word", "n"), expect, from_arrow_schema(sums))
        # At most a row for each piece and language; rounded, since sums come in any order.
        total = expected.groupBy("piece", "lang").agg(F.round(F.sum("n"), 6).alias("n")).collect()
        table = np.full((len(pieces), len(languages)), _SMOOTHING)
        for r in total:
            table[r.piece, r.lang] += r.n
        model = PieceModel(pieces, languages, table / table.sum(axis=0))
    return model


def predict(docs: DataFrame, model: PieceModel, into: str = "language", text_col: str = "text") -> DataFrame:
    """`docs` and a struct column `into`: `lang_pred, score`.

    Only the text is read.  `score` is the predicted language's posterior probability
    under equal priors.  Texts that are null or hold no letter are `und` with score 0,
    as are all if no language was learned.  Ties go to the first language in order.
    Every row is judged alone and keeps its columns; `into` must be a new name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    def values(texts: list) -> list[dict]:
        return [dict(zip(("lang_pred", "score"), p)) for p in shared.value.predict(texts)]

    return add_column(docs, docs.columns, into, kind, [F.col(text_col).cast("string")], values)
