"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this a denominator counts as zero.
TINY = 1e-12


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def hashed_int(*parts: Column) -> Column:
    """32-bit integer from the first 8 hex digits of md5 over the parts joined by '|'."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(*parts: Column) -> Column:
    """Deterministic uniform draw in [0, 1); the same on every engine and every retry."""
    return hashed_int(*parts) / F.lit(4294967296.0)


def poisson1_cuts(upto: int = 12) -> list[float]:
    """CDF of Poisson(1) at 0..upto; what lies above 12 is less than one step of a 32-bit draw."""
    total, cuts = 0.0, []
    for k in range(upto + 1):
        total += math.exp(-1.0) / math.factorial(k)
        cuts.append(total)
    return cuts


def poisson1(u: Column) -> Column:
    """Poisson(1) count for a uniform draw: how many CDF cut points lie at or below it."""
    cuts = poisson1_cuts()
    case = F.when(u < F.lit(cuts[0]), 0)
    for k, cut in enumerate(cuts[1:], start=1):
        case = case.when(u < F.lit(cut), k)
    return case.otherwise(len(cuts))


def micros_between(later: Column | str, earlier: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", as_col(earlier), as_col(later))


def minutes_between(later: Column | str, earlier: Column | str) -> Column:
    """Exact elapsed minutes as a double."""
    return micros_between(later, earlier) / F.lit(6.0e7)


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return micros_between(later, earlier) / F.lit(8.64e10)


def micros(ts: Column | str) -> Column:
    """Timestamp as whole microseconds, for cut points and arithmetic."""
    return micros_between(as_col(ts), F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def ratio(num: Column, den: Column, tiny: float = TINY) -> Column:
    """num / den, NULL where the denominator is zero for practical purposes."""
    return F.when(F.abs(den) >= F.lit(tiny), num / den)


def unpivot_labels(df, keys: list[str], labels: list[str], name: str = "label", value: str = "y"):
    """Wide label columns to (keys, label, value) in one pass."""
    return df.unpivot(keys, labels, name, value)
