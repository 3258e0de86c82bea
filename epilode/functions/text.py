"""Text cleaning as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from epilode.functions import fixed_values as V

_META = re.compile(r"[\\^$.|?*+()\[\]{}]")
_CLASSES = re.compile(r"\\[bBwWdDsS]")
_BLANKS = " \t\r\n"


def _touch(a: str, b: str) -> bool:
    """One text contains the other, or the end of `a` is the start of `b`."""
    return a in b or b in a or any(a.endswith(b[:i]) for i in range(1, len(b)))


def _literals(pattern: str, replacement: str) -> list[str] | None:
    """Plain texts whose replacement one after another equals the pattern's.

    That holds for one escaped text, and for alternatives that neither overlap
    each other nor can arise from the replacement and its neighbours.
    """
    texts = [re.sub(r"\\(\W)", r"\1", t) for t in pattern.split("|")]
    if any(_META.search(re.sub(r"\\\W", "", t)) for t in pattern.split("|")):
        return None
    for i, t in enumerate(texts):
        if any(_touch(t, u) or _touch(u, t) for u in texts[i + 1 :]):
            return None
        if len(texts) > 1 and (_touch(t, replacement) or _touch(replacement, t)):
            return None
    return texts


def fold_rules(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Apply ordered (pattern, replacement) rules one after another.

    Where a pattern is only text, plain string replacement takes its place, at a
    fraction of the cost.  Word classes are Unicode-aware.
    """
    for pattern, replacement in rules:
        texts = _literals(pattern, replacement)
        if texts is None:
            classes = "(?U)" if _CLASSES.search(pattern) else ""
            text = F.regexp_replace(text, classes + pattern, replacement)
        else:
            for plain in texts:
                text = F.replace(text, F.lit(plain), F.lit(replacement))
    return text


def trim_blanks(text: Column) -> Column:
    """Strip blanks, tabs and line ends (Spark's trim strips blanks only)."""
    return F.btrim(text, F.lit(_BLANKS))


def title_case(text: Column) -> Column:
    """Capitalise every word, also after `-` and `/`.

    A single `'`, `.` or `:` between letters does not end a word: `O'brien`.
    """
    # initcap splits on blanks only, so put a marked blank where a word starts.
    marked = F.regexp_replace(text, r"(?U)(?<=[^\w ])(?<!\p{L}['.:\u2019])(?=\w)", "\u0001 ")
    return F.replace(F.initcap(marked), F.lit("\u0001 "), F.lit(""))


def correct_town(town: Column) -> Column:
    """Ordered, case-sensitive corrections; expects title case."""
    return fold_rules(trim_blanks(town), V.TOWN_CORRECTIONS)


def normalise_town(town: Column) -> Column:
    """Title case plus the abbreviations expanded before fuzzy matching."""
    return fold_rules(trim_blanks(title_case(town)), V.TOWN_NORMALISATION)


def blank_to_null(town: Column) -> Column:
    """Placeholder entries become NULL."""
    return F.when(town.isin(V.BLANK_TOWNS), F.lit(None)).otherwise(town)


def clean_address(address: Column, shorten_zip: bool = True) -> Column:
    """Upper case, spelled-out directions and street types, no unit."""
    out = F.replace(F.upper(address), F.lit("."), F.lit(""))
    out = fold_rules(out, [(rf"\b{short}\b", full) for short, full in V.ADDRESS_WORDS])
    out = F.regexp_replace(out, V.ADDRESS_UNIT, "")
    return F.regexp_replace(out, V.ZIP_PLUS_FOUR, "") if shorten_zip else out


def name_key(name: Column) -> Column:
    """Person-name key: upper case letters without suffix or final initial."""
    return F.regexp_replace(F.upper(name), "(?U)" + V.NAME_NOISE, "")


def city_part(text: Column) -> Column:
    """`City, ST` -> `City`."""
    return F.regexp_replace(text, r"(?s),.*$", "")


def state_part(text: Column) -> Column:
    """`City, ST` -> `ST` (unchanged without a comma and blank)."""
    return F.regexp_replace(text, r"(?s)^.*, ", "")


def zip5(text: Column) -> Column:
    """Text before the dash of a nine-digit zip."""
    return F.regexp_replace(text, r"(?s)-.*$", "")


def strip_parens(text: Column) -> Column:
    """Remove ` (...)` remarks."""
    return trim_blanks(F.regexp_replace(text, r"\s*\([^)]+\)", ""))


def split_last(text: Column) -> tuple[Column, Column]:
    """(all but the last character, the last character)."""
    return F.substring(text, F.lit(1), F.length(text) - 1), F.right(text, F.lit(1))
