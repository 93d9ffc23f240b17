"""Reporting datasets: panels and the index of every reported number."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def arm_panel(arms: DataFrame, labels: list[str], values: dict[str, str], row: str = "arm", col: str = "label") -> DataFrame:
    """Wide grid: one row per arm, one column per (label, value), labels declared up front."""
    return arms.groupBy(row).agg(*[
        F.max(F.when(F.col(col) == label, F.col(source))).alias(f"{name}__{label}")
        for label in labels for name, source in values.items()])


def contrast_panel(contrasts: DataFrame, floors: DataFrame, adjusted: DataFrame, keys: list[str]) -> DataFrame:
    """Contrasts with their noise floor and adjusted p, in order of p."""
    return contrasts.join(floors, keys).join(adjusted, keys).orderBy("p_value", *keys)


def declared_and_sensitivity(declared: DataFrame, others: dict[str, DataFrame], cols: list[str]) -> DataFrame:
    """Declared rows and sensitivity rows in one frame with a `spec` tag."""
    out = declared.select(*cols).withColumn("spec", F.lit("declared"))
    for name, df in others.items():
        out = out.unionByName(df.select(*cols).withColumn("spec", F.lit(name)))
    return out


@dataclass(frozen=True)
class CellSpec:
    """Where a reported number comes from: source table, selector, column, aggregate."""

    table: str
    row_key: str
    source: str
    where: tuple[tuple[str, str], ...]
    column: str
    aggregate: str = "none"


def _aggregate(kind: str, col: Column) -> Column:
    if kind == "mean":
        return F.avg(col)
    if kind == "range":
        return F.max(col) - F.min(col)
    if kind == "absmax":
        return F.max(F.abs(col))
    if kind == "none":
        return F.max(col)
    raise ValueError(f"unknown aggregate {kind!r}")


def cell_index(sources: dict[str, DataFrame], specs: list[CellSpec]) -> DataFrame:
    """Every declared number in long form, with its selector, value and matching rows.

    Specs on one source are computed in a single pass. A spec without an aggregate must match
    exactly one row; `n_rows` shows it.
    """
    out = None
    for name, df in sources.items():
        mine = [s for s in specs if s.source == name]
        if not mine:
            continue
        aggs = []
        for i, s in enumerate(mine):
            hit = F.lit(True)
            for c, value in s.where:
                hit = hit & (F.col(c).cast("string") == value)
            aggs += [_aggregate(s.aggregate, F.when(hit, F.col(s.column).cast("double"))).alias(f"v{i}"),
                     F.count_if(hit).alias(f"n{i}")]
        parts = F.array(*[F.struct(
            F.lit(s.table).alias("table"), F.lit(s.row_key).alias("row_key"), F.lit(s.source).alias("source"),
            F.lit(";".join(f"{c}={x}" for c, x in s.where)).alias("selector"), F.lit(s.column).alias("column"),
            F.lit(s.aggregate).alias("aggregate"), F.col(f"v{i}").alias("value"), F.col(f"n{i}").alias("n_rows"))
            for i, s in enumerate(mine)])
        one = df.agg(*aggs).select(F.explode(parts).alias("_c")).select("_c.*")
        out = one if out is None else out.unionByName(one)
    return out


def rederive(index: DataFrame, sources: dict[str, DataFrame], specs: list[CellSpec], tol: float = 1e-9) -> DataFrame:
    """Recompute every number from its source and flag those that moved."""
    keys = ["table", "row_key", "column"]
    fresh = cell_index(sources, specs).select(*keys, F.col("value").alias("_fresh"), F.col("n_rows").alias("_rows"))
    same = (F.abs(F.col("value") - F.col("_fresh")) <= tol) & ((F.col("aggregate") != "none") | (F.col("_rows") == 1))
    return index.join(fresh, keys, "left").withColumn("matches", F.coalesce(same, F.lit(False))).drop("_fresh", "_rows")
