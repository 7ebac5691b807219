"""Text helpers: homoglyph folding, LIKE ANY, occurrence counts, NULL-skipping concat."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cyrillic capitals that look like Latin capitals, and the Latin
# letters they are folded to (position i of one string maps to position i of
# the other).  Codes typed with either alphabet compare equal after folding.
CYRILLIC_LOOKALIKES = "АВЕКМНОРСТХ"
LATIN_EQUIVALENTS = "ABEKMHOPCTX"


def fold_homoglyphs(col: Column | str) -> Column:
    """Upper-case and map Cyrillic look-alike letters onto Latin ones."""
    c = F.col(col) if isinstance(col, str) else col
    return F.translate(F.upper(c), CYRILLIC_LOOKALIKES, LATIN_EQUIVALENTS)


def fold_literal(text: str) -> str:
    """The same folding applied to a Python literal (a pattern)."""
    table = str.maketrans(CYRILLIC_LOOKALIKES, LATIN_EQUIVALENTS)
    return text.upper().translate(table)


def like_any(col: Column, patterns: Iterable[str]) -> Column:
    """``col LIKE ANY (p1, p2, ...)``: OR of LIKE predicates (NULL-aware like SQL)."""
    preds = [col.like(p) for p in patterns]
    return reduce(lambda a, b: a | b, preds)


def occurrences(col: Column, sep: str) -> Column:
    """Number of times ``sep`` occurs in ``col`` (length-difference idiom)."""
    return ((F.length(col) - F.length(F.replace(col, F.lit(sep), F.lit("")))) / F.lit(len(sep))).cast("int")


def concat_skip_nulls(*cols: Column) -> Column:
    """Postgres ``concat(...)``: NULL arguments are skipped, never NULL overall."""
    return F.concat_ws("", *cols)


def rtrim_chars(col: Column, chars: str) -> Column:
    """``rtrim(s, chars)``: strip any trailing run of the given characters."""
    return F.rtrim(col, F.lit(chars))
