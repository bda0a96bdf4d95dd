"""Scalar kernels, all as Spark expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truncate_bytes(c: Column | str, n: int) -> Column:
    """The first n bytes of the UTF-8 text; a character that is cut becomes U+FFFD; trailing NULs go."""
    cut = F.make_valid_utf8(F.substring(F.encode(column(c), "UTF-8"), 1, n).cast("string"))
    return F.rtrim(cut, F.lit("\x00"))


def distance(x: Column | str, y: Column | str, cx: float, cy: float) -> Column:
    """Euclidean, in the coordinates' own units, in double."""
    dx, dy = column(x).cast("double") - F.lit(float(cx)), column(y).cast("double") - F.lit(float(cy))
    return F.sqrt(dx * dx + dy * dy)


def box(x: Column | str, y: Column | str, cx: float, cy: float, r: float) -> Column:
    """The square around a circle, in a form that reaches the Parquet reader. Its sides are moved out by the rounding of 32-bit coordinates."""

    def out(v: float, sign: int) -> Column:
        v = v + sign * (abs(v) + abs(r)) * 1e-6
        return F.lit(math.nextafter(v, sign * math.inf)).cast("float")

    return column(x).between(out(cx - r, -1), out(cx + r, 1)) & column(y).between(out(cy - r, -1), out(cy + r, 1))


def comparable(kind: str, value: object) -> bool:
    """Whether a literal can equal values of a column at all: numbers with numbers, text with text."""
    return isinstance(value, str) == (kind == "char")


def compare(c: Column | str, kind: str, op: str, value: object) -> Column:
    """column op literal, the literal brought to the column's type so that the predicate is pushed down. A literal of another kind matches no row, whatever the operator."""
    c = column(c)
    if not comparable(kind, value):
        return F.lit(False)
    if kind == "int" and isinstance(value, float) and value != math.floor(value):
        if op in ("=", "!="):  # no whole number equals it; nulls match nothing
            return c.isNotNull() if op == "!=" else F.lit(False)
        op, value = ("<=", math.floor(value)) if op in ("<", "<=") else (">=", math.ceil(value))
    lit = F.lit(float(value)).cast("float") if kind == "float" else F.lit({"char": str, "double": float, "int": int}[kind](value))
    return {"=": c == lit, "!=": c != lit, "<": c < lit, ">": c > lit, "<=": c <= lit, ">=": c >= lit}[op]


def between(c: Column | str, kind: str, low: object, high: object) -> Column:
    return compare(c, kind, ">=", low) & compare(c, kind, "<=", high)


def loosely(c: Column | str, op: str, value: object) -> Column:
    """The lenient dialect's comparison: as numbers if both sides are, else as text without regard to case."""
    text, other = column(c).cast("string"), F.lit(str(value))
    a, b = text.try_cast("double"), other.try_cast("double")
    both = a.isNotNull() & b.isNotNull()

    def pick(number: Column, words: Column) -> Column:
        return F.when(both, number).otherwise(words)

    x, y = F.lower(text), F.lower(other)
    return {
        "=": pick(a == b, x == y), "!=": pick(a != b, x != y), "<": pick(a < b, x < y),
        ">": pick(a > b, x > y), "<=": pick(a <= b, x <= y), ">=": pick(a >= b, x >= y),
    }[op]


def loosely_between(c: Column | str, low: object, high: object) -> Column:
    """The lenient dialect's BETWEEN: numbers only; anything else is not between."""
    return F.coalesce(column(c).cast("string").try_cast("double").between(F.lit(str(low)).try_cast("double"), F.lit(str(high)).try_cast("double")), F.lit(False))


def point_of_text(c: Column | str) -> tuple[Column, Column]:
    """x and y of a text such as POINT(1.5, -2)."""
    numbers = F.regexp_extract_all(column(c), F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0))
    return F.get(numbers, 0).try_cast("double"), F.get(numbers, 1).try_cast("double")
