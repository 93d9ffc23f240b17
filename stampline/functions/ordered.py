"""Ordered work inside groups, when one group may hold a large share of all rows.

A window partitioned by a key puts the whole key in one task. `tag_slices` first counts the
keys; a key above the row budget gets cut points along the order column, so its rows fall into
several contiguous slices. Windows then run per (key, slice), and what earlier slices
contribute is added from a small per-slice summary.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stampline.functions.expr import micros
from stampline.session import pinned

SLICE = "_slice"
#: Rows one task may sort comfortably.
ROWS_PER_SLICE = 4_000_000
#: Cut points one broadcast may carry (8 bytes each).
MAX_BROADCAST_CUTS = 2_000_000


def attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left",
           broadcast: bool = False) -> DataFrame:
    """Join on null-safe keys and keep one copy of them."""
    small = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        one = left[k].eqNullSafe(small[f"_r_{k}"])
        cond = one if cond is None else cond & one
    if broadcast:
        small = F.broadcast(small)
    return left.join(small, cond, how).drop(*[f"_r_{k}" for k in keys])


def tag_slices(df: DataFrame, keys: list[str], order: Column, rows_per_slice: int | None = None,
               counted: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """Add `_slice`; it grows with `order` inside a key and equal order values share a slice.

    `counted` may stand in for `df` when counting keys, if it is cheaper and no smaller.

    Returns the tagged frame and whether any key was cut. One scalar reaches the driver; the
    cut points stay in a checkpointed table whose size is checked before it is broadcast.
    """
    budget = rows_per_slice or ROWS_PER_SLICE
    sizes = (df if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    hot = sizes.where(F.col("_rows") > budget)
    largest, n_hot = hot.agg(F.max("_rows"), F.count(F.lit(1))).first()
    if not n_hot:
        return df.withColumn(SLICE, F.lit(0)), False
    n_cuts = math.ceil(largest / budget)
    shares = [i / (n_cuts + 1) for i in range(1, n_cuts + 1)]
    small_enough = n_hot * n_cuts <= MAX_BROADCAST_CUTS
    hot_rows = attach(df.withColumn("_o", order), hot, keys, "inner", broadcast=small_enough)
    cuts = pinned(
        hot_rows.groupBy(*keys).agg(
            F.percentile_approx("_o", shares, F.lit(10 * n_cuts)).alias("_cuts"))
    )
    tagged = attach(df.withColumn("_o", order), cuts, keys, "left", broadcast=small_enough)
    place = F.size(F.filter("_cuts", lambda c: c < F.col("_o")))
    return tagged.withColumn(SLICE, F.when(F.col("_cuts").isNull(), 0).otherwise(place)) \
        .drop("_cuts", "_o"), True


def slice_carry(tagged: DataFrame, keys: list[str], summary: dict[str, Column],
                fold: dict[str, object], descending: bool = False) -> DataFrame:
    """What the slices before each (key, slice) add up to.

    `summary` aggregates one slice, `fold` combines the summaries of the earlier ones.
    The window holds at most one row per slice of the key.
    """
    per = tagged.groupBy(*keys, SLICE).agg(*[c.alias(n) for n, c in summary.items()])
    step = F.col(SLICE).desc() if descending else F.col(SLICE).asc()
    w = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*keys, SLICE, *[fn(F.col(n)).over(w).alias(n) for n, fn in fold.items()])


def running_before(df: DataFrame, keys: list[str], order: str, values: dict[str, str],
                   descending: bool = False, rows_per_slice: int | None = None) -> DataFrame:
    """Sum of each value over the rows strictly before this one in `order`.

    Expects one row per (keys, order); `values` maps output name to input column.
    """
    anchor = [] if keys else ["_all"]
    base = df if keys else df.withColumn("_all", F.lit(0))
    groups = list(keys) + anchor
    tagged, cut = tag_slices(base, groups, F.col(order), rows_per_slice)
    step = F.col(order).desc() if descending else F.col(order).asc()
    w = Window.partitionBy(*groups, SLICE).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    out = tagged.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0)) for n, c in values.items()})
    if cut:
        carry = slice_carry(tagged, groups, {f"_c_{n}": F.sum(c) for n, c in values.items()},
                            {f"_c_{n}": F.sum for n in values}, descending)
        out = attach(out, carry, groups + [SLICE])
        out = out.withColumns({n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in values})
        out = out.drop(*[f"_c_{n}" for n in values])
    return out.drop(SLICE, *anchor)


def position(df: DataFrame, keys: list[str], order: Column, tiebreak: list[str] | None = None,
             ties: str = "strict", name: str = "position",
             rows_per_slice: int | None = None) -> DataFrame:
    """Zero-based place of each row inside its key.

    ties='strict' counts rows with a smaller order value; ties='cumcount' numbers tied rows
    too, by `tiebreak`.
    """
    tagged, cut = tag_slices(df.withColumn("_ord", order), keys, F.col("_ord"), rows_per_slice)
    w = Window.partitionBy(*keys, SLICE)
    if ties == "strict":
        place = F.rank().over(w.orderBy("_ord"))
    elif ties == "cumcount":
        place = F.row_number().over(w.orderBy("_ord", *(tiebreak or [])))
    else:
        raise ValueError(f"ties must be 'strict' or 'cumcount', not {ties!r}")
    out = tagged.withColumn(name, (place - 1).cast("bigint"))
    if cut:
        carry = slice_carry(tagged, keys, {"_c": F.count(F.lit(1))}, {"_c": F.sum})
        out = attach(out, carry, keys + [SLICE])
        out = out.withColumn(name, F.col(name) + F.coalesce("_c", F.lit(0))).drop("_c")
    return out.drop(SLICE, "_ord")


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str,
         values: list[str] | None = None, strict: bool = True, direction: str = "backward",
         rows_per_slice: int | None = None) -> DataFrame:
    """Attach the nearest right row in time with the same key: `_hit` = struct(time, values…).

    One shuffle on the key: both sides are unioned and a running max (min when looking
    forward) of the right struct is read off at the left rows. Ties on the right time
    resolve to the largest (smallest) values, so the answer is deterministic.
    """
    values = values or []
    back = direction == "backward"
    hit = F.struct(F.col(right_time).alias("t"), *[F.col(v).alias(v) for v in values])
    events = (
        right.dropna(subset=[right_time, *by])
        .groupBy(*by, F.col(right_time).alias("_t"))
        .agg((F.max if back else F.min)(hit).alias("_hit"))
        .withColumn("_side", F.lit(1))
    )
    cols = left.columns
    rows = left.select(*by, F.col(left_time).alias("_t"), F.lit(0).alias("_side"),
                       F.struct(*cols).alias("_row"))
    both = rows.unionByName(events, allowMissingColumns=True)
    counted = left.select(*by).unionByName(right.select(*by))
    tagged, cut = tag_slices(both, by, micros_or_number(both, "_t"), rows_per_slice, counted)
    # A strict match must not see right rows of the same instant, so left rows come first.
    side = F.col("_side").asc() if strict else F.col("_side").desc()
    step = F.col("_t").asc() if back else F.col("_t").desc()
    fold = F.max if back else F.min
    w = Window.partitionBy(*by, SLICE).orderBy(step, side) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = tagged.withColumn("_hit", fold("_hit").over(w)).where(F.col("_side") == 0)
    if cut:
        carry = slice_carry(tagged, by, {"_c": fold("_hit")}, {"_c": fold}, descending=not back)
        out = attach(out, carry, by + [SLICE])
        out = out.withColumn("_hit", F.coalesce("_hit", "_c"))
    return out.select("_row.*", "_hit")


def micros_or_number(df: DataFrame, name: str) -> Column:
    """Order column as a number percentile cut points can be taken on."""
    return micros(F.col(name)) if "timestamp" in dict(df.dtypes)[name] else F.col(name)
