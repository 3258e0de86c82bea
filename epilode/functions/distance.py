"""String distances.

Jaro and weighted edit distance keep state from character to character, which
no built-in expression does, so they are Arrow UDFs that work on a whole batch
of pairs at once.  The bounds that decide which pairs reach them, the one-edit
test and the cosine distance are built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Digits kept before a distance is compared with a threshold or another one.
DIGITS = 12
# Cells (pairs x characters) handled at once inside one Arrow batch.
_CELLS = 4_000_000


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    width = max(int(lengths.max()), 1)
    return np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width), lengths


def _jaro_block(left: list[str], right: list[str]) -> np.ndarray:
    a, la = _codes(left)
    b, lb = _codes(right)
    n = len(left)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None]
    col = np.arange(b.shape[1])[None, :]
    free = col < lb[:, None]
    hit_a = np.zeros(a.shape, dtype=bool)
    rows = np.arange(n)
    for i in range(a.shape[1]):
        same = free & (b == a[:, i : i + 1]) & (np.abs(col - i) <= reach) & (i < la)[:, None]
        found = same.any(axis=1)
        first = same.argmax(axis=1)
        hit_a[:, i] = found
        free[rows[found], first[found]] = False
    hit_b = (col < lb[:, None]) & ~free
    m = hit_a.sum(axis=1)
    seq_a = np.zeros((n, a.shape[1]), dtype=np.uint32)
    seq_b = np.zeros((n, a.shape[1]), dtype=np.uint32)
    for hit, codes, seq in ((hit_a, a, seq_a), (hit_b, b, seq_b)):
        r, c = np.nonzero(hit)
        seq[r, (np.cumsum(hit, axis=1) - 1)[r, c]] = codes[r, c]
    swaps = (seq_a != seq_b).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        sim = (m / la + m / lb + (m - swaps) / m) / 3.0
    sim = np.where(m == 0, 0.0, sim)
    return np.where((la == 0) & (lb == 0), 0.0, 1.0 - sim)


def _in_blocks(
    left: pd.Series, right: pd.Series, block: Callable[[list[str], list[str]], np.ndarray]
) -> pd.Series:
    """Run `block` over pairs of similar length; NULL in, NULL out."""
    known = (left.notna() & right.notna()).to_numpy()
    out = np.full(len(left), np.nan)
    where = np.nonzero(known)[0]
    if len(where):
        a, b = left.to_numpy(dtype=object)[where], right.to_numpy(dtype=object)[where]
        size = np.array([max(len(x), len(y), 1) for x, y in zip(a, b)])
        order = np.argsort(size, kind="stable")
        start = 0
        while start < len(order):
            # Sizes ascend, so the run's last pair decides its width.
            stop = min(start + max(_CELLS // int(size[order[start]]), 1), len(order))
            stop = min(stop, start + max(_CELLS // int(size[order[stop - 1]]), 1))
            run = order[start:stop]
            out[where[run]] = block(list(a[run]), list(b[run]))
            start = stop
    return pd.Series(out).where(known, None)


@F.pandas_udf(T.DoubleType())
def _jaro(left: pd.Series, right: pd.Series) -> pd.Series:
    return _in_blocks(left, right, _jaro_block)


def jaro(left: Column, right: Column, prefix_weight: float = 0.0, boost: float = 0.0) -> Column:
    """Jaro distance in [0, 1], rounded to 12 digits.

    Characters match within half the longer length; an odd number of matched
    characters out of order counts rounded down.  A positive `prefix_weight`
    shortens distances above `boost` by the common prefix (four at most).
    """
    # Declared non-deterministic, or a filter on the distance would be pushed
    # through the projection and every pair measured twice.
    d = _jaro.asNondeterministic()(left, right)
    if prefix_weight:
        same = [F.substring(left, 1, k) == F.substring(right, 1, k) for k in (4, 3, 2, 1)]
        fits = [F.least(F.length(left), F.length(right)) >= k for k in (4, 3, 2, 1)]
        common = F.lit(0)
        for s, f, k in reversed(list(zip(same, fits, (4, 3, 2, 1)))):
            common = F.when(s & f, F.lit(k)).otherwise(common)
        d = F.when(d > boost, d * (1 - common * F.lit(prefix_weight))).otherwise(d)
    return F.round(d, DIGITS)


def osa(left: Column, right: Column, deletion: float = 1.0, insertion: float = 1.0,
        substitution: float = 1.0, transposition: float = 1.0) -> Column:
    """Weighted edit distance with swaps of neighbours (no substring edited twice)."""

    def block(lefts: list[str], rights: list[str]) -> np.ndarray:
        a, la = _codes(lefts)
        b, lb = _codes(rights)
        n, width = b.shape
        two_back = np.zeros((n, width + 1))
        one_back = np.tile(np.arange(width + 1) * insertion, (n, 1)).astype(float)
        out = np.where(la == 0, lb * insertion, 0.0)
        for i in range(1, a.shape[1] + 1):
            row = np.empty((n, width + 1))
            row[:, 0] = i * deletion
            for j in range(1, width + 1):
                same = a[:, i - 1] == b[:, j - 1]
                best = one_back[:, j - 1] + np.where(same, 0.0, substitution)
                best = np.minimum(best, one_back[:, j] + deletion)
                best = np.minimum(best, row[:, j - 1] + insertion)
                if i > 1 and j > 1:
                    swap = (a[:, i - 1] == b[:, j - 2]) & (a[:, i - 2] == b[:, j - 1])
                    best = np.where(swap, np.minimum(best, two_back[:, j - 2] + transposition), best)
                row[:, j] = best
            done = la == i
            out[done] = row[done, lb[done]]
            two_back, one_back = one_back, row
        return out

    @F.pandas_udf(T.DoubleType())
    def _osa(left: pd.Series, right: pd.Series) -> pd.Series:
        return _in_blocks(left, right, block)

    return F.round(_osa.asNondeterministic()(left, right), DIGITS)


def one_edit_apart(left: Column, right: Column) -> Column:
    """Edit distance with neighbour swaps is exactly one (built-in expressions)."""
    swap = (
        (F.length(left) == F.length(right))
        & (F.length(left) > 1)
        & (left != right)
        & F.exists(
            F.sequence(F.lit(1), F.greatest(F.length(left) - 1, F.lit(1))),
            lambda i: F.concat(
                F.substring(left, F.lit(1), i - 1),
                F.substring(left, i + 1, F.lit(1)),
                F.substring(left, i, F.lit(1)),
                F.substring(left, i + 2, F.length(left)),
            )
            == right,
        )
    )
    return (F.levenshtein(left, right, 1) == 1) | swap


def _char_count(text: Column, char: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, char, F.lit("")))).cast("double")


def characters(text: Column) -> Column:
    """The characters of a text as an array."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def dot(left: Column, right: Column) -> Column:
    """Inner product of the character counts of two texts: for each character of one, its count in the other."""
    return F.aggregate(characters(left), F.lit(0.0), lambda s, c: s + _char_count(right, c))


def cosine(left: Column, right: Column, left_square: Column | None = None, right_square: Column | None = None) -> Column:
    """Cosine distance between the character counts of two texts.

    The squared norms (`dot` of a text with itself) are computed unless they are given.
    """
    left_square = dot(left, left) if left_square is None else left_square
    right_square = dot(right, right) if right_square is None else right_square
    return F.round(F.lit(1.0) - F.try_divide(dot(left, right), F.sqrt(left_square) * F.sqrt(right_square)), DIGITS)
