"""Fuzzy matching of names against a list of candidates.

Names and candidates are reduced to distinct texts, written with their length and a
64-bit mask of their characters.  Two masks bound from above how many characters the
texts share, and with the lengths that bounds every distance from below, in a few
machine instructions a pair.  Searches for the nearest candidate go best first: of some
groups of candidates the one with the least bound is measured, and what it reaches limits
which lengths the name meets and which pairs are measured at all.

Pairs come from equi-joins on the length, and on a part of the candidates where there are
many, so the joins partition and turn into broadcast joins only where the written size of
a side allows it.  Where the product of both sides is large, names that equal a candidate
leave first, then those with one nearby, found by an equi-join on keys that near texts
must share: characters for Jaro (`_length_tokens`), segments for edits (`within_edits`),
leading characters for cosine.  No step loses a pair that matters.

Distances are computed on the surviving pairs, and the best candidate is a `min_by`, which
combines on the map side.  Keys are exploded with `explode_outer`: for a plain `explode`
the optimizer adds a not-empty test on the key array and pushes it below the `distinct`,
where the keys would be computed for every row instead of every distinct name.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epilode.functions import distance as D
from epilode.session import cut_lineage

# Letters from rare to frequent; any fixed order is correct, a rarity order
# makes the shared keys selective.  Other characters count as rare.
_LETTERS = "qjxzkvbywgpfmucdlhrsniotae "
# So many of the frequent ones have a bit for their second occurrence.
_DOUBLED = 14

# What counts as nearby where the product of both sides is large: a distance for Jaro and
# cosine, edits otherwise.
_NEAR = 0.1
_EDITS = 2

# Pairs of names and candidates from which on guesses come first, and from which on near
# ones are looked up by keys first.  Neither changes a result.
_FEW = 500_000
_MANY = 20_000_000_000
# Candidates of a list that is short.
_SHORT = 200
# Groups of candidates that each give a name one first guess.
_GUESSES = 4
# Candidates of a part, so that a length is no hot key.
_PART_ROWS = 250_000
# Names are spread by work and not by bytes: pairs of a task, at least where cores would
# be idle and else, and tasks at most.
_LEAST_PAIRS, _TASK_PAIRS, _TASKS = 5_000, 500_000, 4096
# Rounding of floating-point bounds.
_SLACK = 1e-9

# Tokens that make a lookup key, and what parts them in it.
_JOINED = 3
_PART = "\u0001"

_PLAIN = (1.0, 1.0, 1.0, 1.0)
#: A measure: method, distance of two columns, prefix weight, edit weights.
_Measure = tuple[str, Callable[[Column, Column], Column], float, tuple[float, float, float, float]]

# A Jaro distance from here on need not mean a shared character.
_JARO_LIMIT = 2.0 / 3.0


def _known(keys: Column) -> Column:
    """Key array that cannot be NULL.

    Joins add not-null tests on what they compare; on an array that may be NULL
    such a test would be pushed to the scan and compute the keys for every row.
    """
    return F.coalesce(keys, F.array().cast("array<string>"))


def _tokens(text: Column) -> Column:
    """Characters with their occurrence number, rarest first.

    `anna` -> n2, a2, n1, a1 (in some fixed order): two texts share as many
    tokens as they share characters, counted with repetition.  An empty text has
    one token of its own.
    """
    chars = D.characters(text)
    numbered = F.transform(
        chars,
        lambda c, i: F.struct(
            (-F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c))).alias("o"),
            F.instr(F.lit(_LETTERS), c).alias("r"),
            c.alias("c"),
        ),
    )
    tokens = F.transform(F.array_sort(numbered), lambda t: F.concat(t["c"], F.abs(t["o"]).cast("string")))
    return _known(F.when(text == "", F.array(F.lit(""))).otherwise(tokens))


def _combinations(tokens: Column, size: Column) -> Column:
    """All choices of `size` (up to `_JOINED`) tokens, in order, as texts."""
    chosen = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    out = [chosen]
    for _ in range(_JOINED - 1):
        chosen = F.flatten(F.transform(
            chosen,
            lambda c: F.transform(
                F.slice(tokens, c["i"] + 2, F.size(tokens)),
                lambda t, j: F.struct(F.concat(c["t"], F.lit(_PART), t).alias("t"), (c["i"] + 1 + j).alias("i")),
            ),
        ))
        out.append(chosen)
    picked = out[-1]
    for n, found in reversed(list(enumerate(out[:-1], 1))):
        picked = F.when(size == n, found).otherwise(picked)
    return F.transform(picked, lambda c: c["t"])


def _overlap_needed(la: Column, lb: Column, threshold: Column | float) -> Column:
    """Shared characters two strings need to be within a Jaro distance.

    Similarity is at most (m/la + m/lb + 1)/3 for m shared characters.
    """
    limit = F.least(F.lit(threshold) if isinstance(threshold, float | int) else threshold, F.lit(1.0))
    need = F.ceil(F.try_divide((2.0 - 3.0 * limit) * la * lb, la + lb) - _SLACK)
    # Two empty texts are equal.
    return F.when(la + lb == 0, F.lit(0)).otherwise(F.greatest(need, F.lit(1))).cast("int")


def _within_reach(a: Column, b: Column, la: Column, lb: Column, need: Column) -> Column:
    """At least `need` characters of `a` have an equal one in `b` near enough for Jaro."""
    reach = F.greatest(F.floor(F.greatest(la, lb) / 2) - 1, F.lit(0)).cast("int")

    def met(i: Column) -> Column:
        start = F.greatest(i - reach, F.lit(1))
        return F.instr(F.substring(b, start, i + reach - start + 1), F.substring(a, i, F.lit(1))) > 0

    return F.when(need == 0, F.lit(True)).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(la, F.lit(1))), met)) >= need)


def _length_tokens(df: DataFrame, mine: str, other: str, known: Column, threshold: float) -> DataFrame:
    """One row per (length of the other string, token) under which to look up.

    `known` holds the lengths that occur on the other side.

    If two strings share o of their tokens, they share s among the first
    len - o + s of each, in any common order; all choices of s of these are keys.
    """
    need = _overlap_needed(F.col(mine), F.col(other), threshold)
    return (
        df.withColumn("known", known)
        .withColumn(other, F.explode_outer("known"))
        .withColumn("need", need)
        .filter(F.col("need") <= F.least(F.col(mine), F.col(other)))
        .withColumn("joined", F.greatest(F.least("need", F.lit(_JOINED)), F.lit(1)))
        .withColumn("prefix", _known(F.slice("tokens", F.lit(1), F.col(mine) - F.col("need") + F.col("joined"))))
        .withColumn("token", F.explode_outer(_known(_combinations(F.col("prefix"), F.col("joined")))))
        .drop("known")
    )


def _lengths_of(df: DataFrame, col: str) -> Column:
    """All distinct lengths, as a scalar: as many values as the longest name has characters."""
    return df.agg(F.collect_set(col)).scalar()


def _mask(sorted_chars: Column) -> Column:
    """A bit for each character and its number of occurrences; some share a bit.

    Letters have bits of their own, and so has the second occurrence of frequent ones; all
    else is hashed to the other bits.
    """
    def before(i: Column, n: int) -> Column:
        return F.get(sorted_chars, i - n)

    def bit(c: Column, i: Column) -> Column:
        again = F.coalesce(before(i, 1) == c, F.lit(False))
        third = again & F.coalesce(before(i, 2) == c, F.lit(False))
        letter = F.instr(F.lit(_LETTERS), c)  # frequent ones last
        own = len(_LETTERS) + _DOUBLED
        hashed = own + F.pmod(F.hash(c) + F.when(third, 7).when(again, 5).otherwise(0), F.lit(64 - own))
        twice = letter - 1 + _DOUBLED
        place = F.when((letter > 0) & ~again, letter - 1).when((letter > 0) & ~third & (twice >= len(_LETTERS)), twice).otherwise(hashed)
        return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))

    return F.aggregate(F.transform(sorted_chars, bit), F.lit(0).cast("long"), lambda m, b: m.bitwiseOR(b))


def _profiled(df: DataFrame, text: str, side: str) -> DataFrame:
    """`df` with the text's length, mask and squared norm of character counts: `l`, `m`, `q` and the side."""
    return df.withColumn("_chars", F.array_sort(D.characters(F.col(text)))).withColumns({
        f"l{side}": F.length(text), f"m{side}": _mask(F.col("_chars")), f"q{side}": D.dot(F.col(text), F.col(text)),
    }).drop("_chars")


def _missing(a: str, b: str) -> Column:
    """Characters of one text, at least, without an equal one in the other."""
    return F.bit_count(F.col(a).bitwiseAND(F.bitwise_not(F.col(b))))


def _shared() -> Column:
    """Characters two texts share, at most."""
    return F.least(F.col("la") - _missing("ma", "mb"), F.col("lb") - _missing("mb", "ma"))


class _Options:
    """Written candidates, with what a search needs to know about them."""

    def __init__(self, candidates: DataFrame):
        self.table = cut_lineage(_profiled(candidates, "candidate", "b"), "candidates")
        # One row per length: as many as the longest candidate has characters.
        rows = self.table.groupBy("lb").agg(F.count("*").alias("n"), F.min("ordinal").alias("first")).collect()
        self.count, self.lengths = sum(r.n for r in rows), [r.lb for r in rows]
        self.firsts = {r.lb: r.first for r in rows}
        self.parts = max(1, -(-self.count // _PART_ROWS))

    def lengths_column(self) -> Column:
        return F.array(*[F.lit(n) for n in self.lengths]).cast("array<int>")

    def met_by(self, names: DataFrame, facts: dict[str, Column] | None = None, length_matters: Column | None = None) -> DataFrame:
        """Pairs of names and candidates of lengths that matter, with the bound `shared`.

        `facts` are columns of the name and the candidate's length, computed once for both.
        `is_first` tells the first candidate of a length: it stands for all that share
        nothing with a name.
        """
        left = names.withColumn("lb", F.explode(self.lengths_column())).withColumns(facts or {})
        left = left if length_matters is None else left.where(length_matters)
        firsts = F.create_map(*[x for n, o in self.firsts.items() for x in (F.lit(n), F.lit(o))])
        right = self.table.withColumn("is_first", F.col("ordinal") == firsts[F.col("lb")])
        on = ["lb"]
        if self.parts > 1:
            left = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1))))
            right, on = right.withColumn("part", F.pmod(F.xxhash64("candidate"), F.lit(self.parts)).cast("int")), ["lb", "part"]
        return left.join(right, on).withColumn("shared", _shared())


def _reachable(need: Column) -> Column:
    """A pair that may share so many characters near enough for Jaro, by masks and places."""
    name, candidate = F.col("name"), F.col("candidate")
    return (F.col("shared") >= need) & _within_reach(name, candidate, F.col("la"), F.col("lb"), need) & _within_reach(
        candidate, name, F.col("lb"), F.col("la"), need
    )


def jaro_pairs(names: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """All (name, candidate) pairs within a Jaro distance, each once.

    `names(name)` and `candidates(candidate, ordinal, ...)` hold the strings to
    compare as they are.  `threshold` must be below 2/3, since beyond that two
    texts need not share a character.
    """
    return measured_pairs(names, candidates, threshold).filter(F.col("distance") <= threshold)


def measured_pairs(names: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """Pairs that may be within a Jaro distance, with their distance."""
    if not threshold < _JARO_LIMIT:
        raise ValueError(f"a Jaro threshold of {threshold} is not below 2/3")
    extra = [c for c in candidates.columns if c not in ("candidate", "ordinal")]
    options = _Options(candidates)
    need = {"need": _overlap_needed(F.col("la"), F.col("lb"), threshold)}
    met = options.met_by(_spread(_profiled(names.select("name"), "name", "a"), 0), need, F.col("need") <= F.least("la", "lb"))
    met = met.where(_reachable(F.col("need")))
    return met.select("name", "candidate", "ordinal", *extra).withColumn("distance", D.jaro(F.col("name"), F.col("candidate")))


def _keyed_jaro_pairs(names: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """As `measured_pairs`, from an equi-join on characters that near texts share."""
    a = names.select("name", F.length("name").alias("la"), _tokens(F.col("name")).alias("tokens"))
    b = candidates.withColumn("lb", F.length("candidate")).withColumn("tokens", _tokens(F.col("candidate")))
    left = _length_tokens(a, "la", "lb", _lengths_of(b, "lb"), threshold)
    right = _length_tokens(b, "lb", "la", _lengths_of(a, "la"), threshold).withColumnsRenamed({"tokens": "tokens_b", "prefix": "prefix_b"}).drop("need", "joined")
    # Written first: a short list is broadcast and the names stay where they are.
    met = left.join(cut_lineage(right, "candidate_index"), ["la", "lb", "token"]).filter(
        # Prefixes keep the common order: count a pair at its first shared key.
        (F.array_join(F.slice(F.array_intersect("prefix", "prefix_b"), F.lit(1), F.col("joined")), _PART) == F.col("token"))
        & (F.size(F.array_intersect("tokens", "tokens_b")) >= F.col("need"))
        & _within_reach(F.col("name"), F.col("candidate"), F.col("la"), F.col("lb"), F.col("need"))
        & _within_reach(F.col("candidate"), F.col("name"), F.col("lb"), F.col("la"), F.col("need"))
    )
    return met.select("name", "candidate", "candidate_text", "ordinal").withColumn("distance", D.jaro(F.col("name"), F.col("candidate")))


def _segments(text: Column, length: Column, count: int, shift: Column | int) -> Column:
    """The `count` segments of a text of some length, cut evenly; with a shift, what stands there in another text."""
    def one(i: Column) -> Column:
        start, stop = F.floor(i * length / count), F.floor((i + 1) * length / count)
        return F.struct(i.alias("i"), (start + shift).alias("start"), (stop - start).alias("size"))

    places = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), one)
    inside = F.filter(places, lambda p: (p["start"] >= 0) & (p["start"] + p["size"] <= F.length(text)))
    return F.transform(inside, lambda p: F.concat(
        p["i"].cast("string"), F.lit(":"), F.substring(text, (p["start"] + 1).cast("int"), p["size"].cast("int"))
    ))


def within_edits(names: DataFrame, candidates: DataFrame, edits: int) -> DataFrame:
    """All pairs at most so many edits apart, swaps of neighbours included: `name`, the candidate's columns, `edits`.

    A candidate is cut into 2 * edits + 1 segments.  An edit spoils one of them, a swap
    two at most, so one stands in the name as it is, shifted by `edits` at most; pairs
    meet on the lengths and a segment with its number.
    """
    count = 2 * edits + 1
    left = names.select("name").withColumn("la", F.length("name")).withColumn(
        "lb", F.explode(F.sequence(F.greatest(F.col("la") - edits, F.lit(0)), F.col("la") + edits))
    )
    shifts = [_segments(F.col("name"), F.col("lb"), count, s) for s in range(-edits, edits + 1)]
    left = left.withColumn("keys", _known(F.array_distinct(F.concat(*shifts)))).withColumn("key", F.explode_outer("keys"))
    right = candidates.withColumn("lb", F.length("candidate")).withColumn("keys_b", _known(_segments(F.col("candidate"), F.col("lb"), count, 0)))
    right = right.withColumn("key", F.explode_outer("keys_b"))
    met = left.join(cut_lineage(right, "segments"), ["lb", "key"]).where(
        # Count a pair at its first shared segment; a swap is two plain edits at most.
        (F.element_at(F.array_intersect("keys", "keys_b"), 1) == F.col("key")) & (F.levenshtein("name", "candidate", 2 * edits) >= 0)
    )
    return met.drop("la", "lb", "key", "keys", "keys_b").withColumn("edits", D.osa(F.col("name"), F.col("candidate"))).where(F.col("edits") <= edits)


def _best(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Nearest candidate per key; the earlier one in the list wins a tie."""
    order = F.struct("distance", "ordinal")
    return pairs.groupBy(*keys).agg(
        F.min_by("candidate_text", order).alias("match"), F.min("distance").alias("distance")
    )


def _folded(candidates: DataFrame, candidate: str, ordinal: str, fold: bool = True) -> DataFrame:
    text = F.col(candidate)
    return candidates.select(
        (F.lower(text) if fold else text).alias("candidate"),
        F.col(ordinal).alias("ordinal"),
        text.alias("candidate_text"),
    ).filter(text.isNotNull())


def closest(df: DataFrame, name: str, candidates: DataFrame, candidate: str, ordinal: str,
            threshold: float = 0.25, method: str = "jw") -> DataFrame:
    """Nearest candidate by case-folded distance, if within the threshold.

    `method` is `jw`, `osa` or `cosine`, as in `nearest`.  Returns one row per distinct
    name that has a match: (name, match, distance).
    """
    names = df.select(F.lower(F.col(name)).alias("name")).filter("name is not null").distinct()
    folded = _folded(candidates, candidate, ordinal)
    if method == "jw" and not threshold < _JARO_LIMIT:
        raise ValueError(f"a Jaro threshold of {threshold} is not below 2/3")
    # The nearest by the folded text, given back as it stands in the list.
    found = _nearest_by(names, folded, {method: distance_of(method, 0.0, 0.0, _PLAIN)}, limit=threshold)
    found = found.where(F.col(f"{method}.distance") <= threshold).select("name", f"{method}.match", f"{method}.distance")
    raw = df.select(F.col(name)).filter(F.col(name).isNotNull()).distinct()
    return raw.join(found, F.lower(raw[name]) == found["name"]).select(raw[name].alias("name"), "match", "distance")


def add_closest(df: DataFrame, name: str, candidates: DataFrame, candidate: str, ordinal: str,
                threshold: float = 0.25) -> DataFrame:
    """`df` with the nearest candidate (`match`, `distance`), NULL beyond the threshold."""
    found = cut_lineage(closest(df, name, candidates, candidate, ordinal, threshold), "closest")
    found = found.withColumnRenamed("name", "_name")
    return df.join(found, F.col(name) == F.col("_name"), "left").drop("_name")


def closest_in_block(df: DataFrame, name: str, block: str, candidates: DataFrame, candidate: str,
                     candidate_block: str, ordinal: str, threshold: float = 0.35) -> DataFrame:
    """As `closest`, among the candidates of the row's block only.

    Returns one row per distinct (name, block) that has a match.
    """
    left = (
        df.select(F.col(name).alias("name"), F.col(block).alias("block"))
        .filter("name is not null and block is not null")
        .distinct()
    )
    right = candidates.select(
        F.col(candidate_block).alias("block"),
        F.lower(F.col(candidate)).alias("candidate"),
        F.col(ordinal).alias("ordinal"),
        F.col(candidate).alias("candidate_text"),
    )
    la, lb = F.length("name"), F.length("candidate")
    # Blocks are short lists, so lengths and masks decide which pairs to measure.
    pairs = (
        _profiled(left.withColumn("_text", F.lower("name")), "_text", "a").join(cut_lineage(_profiled(right, "candidate", "b"), "block_lists"), "block")
        .filter(_overlap_needed(la, lb, threshold) <= _shared())
        .withColumn("distance", D.jaro(F.lower("name"), F.col("candidate")))
        .filter(F.col("distance") <= threshold)
    )
    return _best(pairs, ["name", "block"])


def edit_keys(text: Column) -> Column:
    """A text and its variants with one character removed.

    Two texts one edit apart (insert, delete, replace, swap neighbours) share a
    key: remove the edited character, or either of the swapped two.
    """
    removed = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
        lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))),
    )
    return _known(F.array_distinct(F.concat(F.array(text), removed)))


def only_one_edit_away(df: DataFrame, name: str, candidates: DataFrame, candidate: str,
                       ordinal: str) -> DataFrame:
    """The candidate at edit distance exactly one, where there is just one such.

    Returns (name, match) with the case-folded name.
    """
    left = (
        df.select(F.lower(F.col(name)).alias("name")).filter("name is not null").distinct()
        .withColumn("keys", edit_keys(F.col("name")))
        .withColumn("edit_key", F.explode_outer("keys"))
    )
    right = (
        _folded(candidates, candidate, ordinal)
        .withColumn("keys_b", edit_keys(F.col("candidate")))
        .withColumn("edit_key", F.explode_outer("keys_b"))
    )
    pairs = left.join(cut_lineage(right, "candidate_index"), "edit_key").filter(
        # count a pair at the first key of the name that the candidate shares
        (F.element_at(F.array_intersect("keys", "keys_b"), 1) == F.col("edit_key"))
        & D.one_edit_apart(F.col("name"), F.col("candidate"))
    )
    return (
        pairs.groupBy("name")
        .agg(F.count(F.lit(1)).alias("n"), F.min_by("candidate_text", "ordinal").alias("match"))
        .filter("n = 1")
        .select("name", "match")
    )


def _cosine_prefix(text: Column, similarity: float) -> Column:
    """Leading characters, rarest first, without which a similarity is out of reach.

    Characters past the prefix have a joint norm below similarity x norm, so two
    texts that share none of their prefixes stay below that similarity.
    """
    chars = F.transform(
        F.array_sort(F.transform(F.array_distinct(D.characters(text)),
                                 lambda c: F.struct(F.instr(F.lit(_LETTERS), c).alias("r"), c.alias("c")))),
        lambda t: t["c"],
    )

    def norm2(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda s, c: s + F.pow(D._char_count(text, c), F.lit(2.0)))

    return F.filter(
        chars,
        lambda c, i: norm2(F.slice(chars, i + 1, F.size(chars))) >= norm2(chars) * (similarity**2) - 1e-9,
    )


def _sharing(names: DataFrame, candidates: DataFrame, keys) -> DataFrame:
    """Pairs that share one of the keys `keys(text)`, each once."""
    left = names.withColumn("keys", _known(keys(F.col("name")))).withColumn("key", F.explode_outer("keys"))
    right = candidates.withColumn("keys_b", _known(keys(F.col("candidate")))).withColumn("key", F.explode_outer("keys_b"))
    return left.join(cut_lineage(right, "candidate_index"), "key").filter(
        F.element_at(F.array_intersect("keys", "keys_b"), 1) == F.col("key")
    ).drop("key", "keys", "keys_b")


def distance_of(method: str, p: float, bt: float, weight: tuple[float, float, float, float]) -> _Measure:
    """A method with its distance of two columns."""
    if method == "jw":
        return method, lambda a, b: D.jaro(a, b, p, bt), p, weight
    if method == "osa":
        return method, lambda a, b: D.osa(a, b, *weight), 0.0, weight
    if method == "cosine":
        return method, D.cosine, 0.0, weight
    raise ValueError(f"{method} is none of jw, osa, cosine")


def _apart(la: Column, lb: Column, weight: tuple[float, float, float, float]) -> Column:
    """Edit distance of texts without a common character, and a bound for all others."""
    deletion, insertion, substitution, _ = weight
    both = F.least(la, lb)
    longer = F.greatest(la - lb, F.lit(0)) * deletion + F.greatest(lb - la, F.lit(0)) * insertion
    return longer + both * min(substitution, deletion + insertion)


def _bound(method: str, p: float, weight: tuple[float, float, float, float]) -> Column:
    """A pair's least possible distance by its lengths, masks and norms."""
    la, lb, shared = F.col("la"), F.col("lb"), F.col("shared")
    if method == "jw":
        # A common prefix shortens a distance to this share of it at least.
        least = (1.0 - (F.try_divide(shared, la) + F.try_divide(shared, lb) + 1.0) / 3.0) * (1 - 4 * p)
        least = F.when(shared > 0, least).when(la + lb == 0, 0.0).otherwise(1.0)
    elif method == "osa":
        least = _apart(la - shared, lb - shared, weight)
    else:
        # Counts that differ by n in all differ by n at least when squared.
        apart = F.greatest(_missing("ma", "mb") + _missing("mb", "ma"), F.abs(la - lb))
        likeness = F.try_divide(F.col("qa") + F.col("qb") - apart, 2.0 * F.sqrt(F.col("qa") * F.col("qb")))
        least = 1.0 - F.coalesce(likeness, F.lit(0.0))
    return least - _SLACK


def _near_pairs(names: DataFrame, options: DataFrame, measure: _Measure) -> tuple[DataFrame, float] | None:
    """Pairs among which is a name's nearest candidate if that is below the level."""
    method, distance, p, weight = measure
    if method == "jw":
        pairs, level = _keyed_jaro_pairs(names, options, _NEAR), _NEAR * (1 - 4 * p)
        return (pairs.withColumn("distance", distance(F.col("name"), F.col("candidate"))) if p else pairs), level
    if method == "cosine":
        pairs, level = _sharing(names, options, lambda t: _cosine_prefix(t, 1 - _NEAR)), _NEAR
    elif min(weight) > 0:
        # All others are this many of the least weight apart.
        pairs, level = within_edits(names, options, _EDITS), (_EDITS + 1) * min(weight)
    else:
        return None
    return pairs.withColumn("distance", distance(F.col("name"), F.col("candidate"))), level


def _spread(names: DataFrame, pairs: int) -> DataFrame:
    """Names in as many parts as their pairs are worth."""
    cores = names.sparkSession.sparkContext.defaultParallelism
    if not pairs:  # not counted
        return names.repartition(max(cores, int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "name")
    return names.repartition(max(1, min(cores, pairs // _LEAST_PAIRS), min(_TASKS, pairs // _TASK_PAIRS)), "name")


def _search(names: DataFrame, count: int, options: _Options, measures: list[_Measure], limit: float | None) -> DataFrame:
    """`name` and, per method, its best candidate: best first, over written and profiled names."""
    name, candidate = F.col("name"), F.col("candidate")
    spread = _spread(names, count * options.count)
    jaro = next((m for m in measures if m[0] == "jw"), None)

    def met(reached: dict[str, Column], names: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
        """Pairs that may be within what was reached, and which of them each method asks for."""
        facts, lengths, wanted = {}, [], {}
        if jaro:
            facts["need"] = _overlap_needed(F.col("la"), F.col("lb"), reached["jw"] / (1 - 4 * jaro[2]))
        for m in measures:
            if m[0] == "jw":
                lengths.append((F.col("need") <= F.least("la", "lb")) | (reached["jw"] >= 1.0 - _SLACK))
                wanted["jw"] = (F.col("shared") >= F.col("need")) | (F.col("is_first") & (_bound(m[0], m[2], m[3]) <= reached["jw"]))
                continue
            if m[0] == "osa":
                both = F.least("la", "lb")
                lengths.append(_apart(F.col("la") - both, F.col("lb") - both, m[3]) - _SLACK <= reached["osa"])
            else:
                lengths.append(F.lit(True))
            wanted[m[0]] = ((F.col("shared") > 0) | F.col("is_first")) & (_bound(m[0], m[2], m[3]) <= reached[m[0]])
        return options.met_by(names, facts, reduce(or_, lengths)).where(reduce(or_, wanted.values())), wanted

    reached = {m[0]: F.lit(float("inf") if limit is None else limit) for m in measures}
    if count * options.count > _FEW:
        # Of each group of candidates, the one with the least bound.
        group = F.pmod(F.hash("candidate"), F.lit(_GUESSES))
        guesses = met(reached, spread)[0].groupBy("name", group.alias("group")).agg(
            *[F.min_by("candidate", F.struct(_bound(m[0], m[2], m[3]), "ordinal")).alias(m[0]) for m in measures]
        )
        guesses = guesses.select("name", *[F.coalesce(m[1](name, F.col(m[0])), F.lit(1.0)).alias(m[0]) for m in measures])
        best = cut_lineage(guesses.groupBy("name").agg(*[F.min(m[0]).alias(f"reach_{m[0]}") for m in measures]), "guesses")
        # A name without a guess has no candidate within the limit.
        spread = spread.join(best, "name")
        reached = {m: F.least(reached[m], F.col(f"reach_{m}")) for m in reached}
    pairs, wanted = met(reached, spread)
    pairs = pairs.select("name", "candidate", "candidate_text", "ordinal", "qa", "qb", *[w.alias(f"wanted_{m}") for m, w in wanted.items()])
    for m in measures:
        asked = F.col(f"wanted_{m[0]}")
        # What is not asked for is null, which the measures leave out.
        squares = (F.col("qa"), F.col("qb")) if m[0] == "cosine" else ()
        pairs = pairs.withColumn(m[0], F.when(asked, F.coalesce(m[1](F.when(asked, name), F.when(asked, candidate), *squares), F.lit(1.0))))
    return pairs.groupBy("name").agg(*[
        F.struct(
            F.min_by("candidate_text", F.when(F.col(m[0]).isNotNull(), F.struct(F.col(m[0]), "ordinal"))).alias("match"),
            F.min(m[0]).alias("distance"),
        ).alias(m[0]) for m in measures
    ])


def _nearest_by(names: DataFrame, options: DataFrame, measures: dict[str, _Measure], limit: float | None = None) -> DataFrame:
    """`name` and, per method, a struct of its nearest candidate and the distance.

    A name without a candidate (within the limit, if there is one) may be left out, or its
    struct's fields null.
    """
    names, known = _profiled(names.select("name"), "name", "a"), _Options(options)
    nothing = names.select("name", *[F.lit(None).cast("struct<match:string,distance:double>").alias(m) for m in measures])
    if known.count <= _SHORT:
        # So few that each name meets them all at once, and names need not be counted.
        return _search(names, 0, known, list(measures.values()), limit) if known.count else nothing
    names = cut_lineage(names, "names")
    count = names.count()
    if not count:
        return nothing
    if len(measures) > 1 and count * known.count <= _MANY:
        return _search(names, count, known, list(measures.values()), limit)
    found = None
    for method, measure in measures.items():
        left, settled = names, []
        if method == "jw" or (method == "osa" and min(measure[3]) > 0):
            # Nothing but an equal text is at distance zero.
            equal = left.join(known.table.drop("la"), F.col("name") == F.col("candidate")).groupBy("name").agg(F.min_by("candidate_text", "ordinal").alias("match"))
            settled.append(cut_lineage(equal.withColumn("distance", F.lit(0.0)), "equal"))
            left = cut_lineage(left.join(settled[-1], "name", "left_anti"), "left_open")
            count = left.count()
        near = _near_pairs(left, known.table.select("candidate", "candidate_text", "ordinal"), measure) if count * known.count > _MANY else None
        if near is not None:
            settled.append(cut_lineage(_best(near[0], ["name"]).where(F.col("distance") < near[1]), "near"))
            left = cut_lineage(left.join(settled[-1], "name", "left_anti"), "left_open")
            count = left.count()
        if count:
            settled.append(_search(left, count, known, [measure], limit).select("name", f"{method}.match", f"{method}.distance"))
        one = reduce(DataFrame.unionByName, [x.select("name", "match", "distance") for x in settled]) if settled else None
        one = one.select("name", F.struct("match", "distance").alias(method))
        found = one if found is None else found.join(one, "name", "full")
    return found


def nearest(df: DataFrame, name: str, candidates: DataFrame, candidate: str, ordinal: str,
            method: str = "jw", p: float = 0.0, bt: float = 0.0,
            weight: tuple[float, float, float, float] = _PLAIN) -> DataFrame:
    """Nearest candidate without a threshold and without case folding.

    `method` is `jw` (with the prefix weight `p` above `bt`), `osa` (with the weights of
    deletion, insertion, substitution and swap) or `cosine`.  Returns (name, match,
    distance) per distinct name; the first candidate of the list wins a tie.
    """
    found = nearest_by(df, name, candidates, candidate, ordinal, (method,), p, bt, weight)
    return found.select("name", f"{method}.match", f"{method}.distance")


def nearest_by(df: DataFrame, name: str, candidates: DataFrame, candidate: str, ordinal: str, methods: tuple[str, ...],
               p: float = 0.0, bt: float = 0.0, weight: tuple[float, float, float, float] = _PLAIN) -> DataFrame:
    """As `nearest` by several methods at once: per distinct name, a struct (match, distance) for each."""
    measures = {m: distance_of(m, p, bt, weight) for m in methods}
    names = df.select(F.col(name).alias("name")).filter("name is not null").distinct()
    found = _nearest_by(names, _folded(candidates, candidate, ordinal, fold=False), measures)
    # Candidates without a common character are at the distance one: the first stands for them.
    return found.select("name", *[
        F.struct(F.col(f"{m}.match").alias("match"), F.coalesce(f"{m}.distance", F.lit(1.0)).alias("distance")).alias(m) for m in methods
    ])
