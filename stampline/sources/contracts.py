"""Contract-checked reading, validation and writing of tables."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class ColumnSpec:
    """One contracted column: Spark type name, role, whether NULL is allowed."""

    dtype: str
    role: str = "value"
    nullable: bool = True


@dataclass(frozen=True)
class TableSpec:
    """Contract of one table; `features` lists what falls away when the table is absent."""

    name: str
    columns: dict[str, ColumnSpec]
    features: tuple[str, ...] = field(default=())

    def schema(self) -> T.StructType:
        out = T.StructType()
        for name, c in self.columns.items():
            out.add(T.StructField(name, T._parse_datatype_string(c.dtype), c.nullable, {"role": c.role}))
        return out


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def read_contract_table(spark: SparkSession, path: str, spec: TableSpec, required: bool = True,
                        corrupt: str | None = None) -> DataFrame | None:
    """Read only the contract's columns from Parquet, CSV, CSV.gz or JSON lines.

    Text columns are parsed to their declared types; a missing column fails with the table and
    its name. An absent optional table gives None.

    JSON lines take their schema from the contract, so they are scanned once: a field that no line has is
    NULL, which `validate_table` counts where none may be. A broken line is a row of NULLs; `corrupt` names
    a column that holds such lines, which `validate_table` counts too.
    """
    if not _exists(spark, path):
        if required:
            raise FileNotFoundError(f"{spec.name}: no data at {path}")
        return None
    stem = re.sub(r"\.(gz|bz2|zst)$", "", path.rstrip("/"))
    if stem.endswith((".json", ".jsonl")):
        raw = _json_by_contract(spark, path, spec, corrupt)
    elif stem.endswith(".csv"):
        raw = spark.read.option("header", True).csv(path)
    else:
        raw = spark.read.parquet(path)
    absent = [c for c in spec.columns if c not in raw.columns]
    if absent:
        raise ValueError(f"{spec.name}: missing column(s) {', '.join(absent)}")
    have = dict(raw.dtypes)
    kept = [F.col(f"`{corrupt}`")] if corrupt in raw.columns and corrupt not in spec.columns else []
    return raw.select(*[
        (F.col(f"`{c}`") if have[c] == s.dtype else F.col(f"`{c}`").cast(s.dtype)).alias(c, metadata={"role": s.role})
        for c, s in spec.columns.items()], *kept)


def _json_by_contract(spark: SparkSession, path: str, spec: TableSpec, corrupt: str | None) -> DataFrame:
    """JSON lines with the contract's columns: nested ones by their types, all others as the text that stands there."""
    if corrupt in spec.columns:
        raise ValueError(f"{spec.name}: {corrupt} is a column of the contract")
    nested = (T.ArrayType, T.MapType, T.StructType)
    schema = T.StructType([T.StructField(f.name, f.dataType if isinstance(f.dataType, nested) else T.StringType())
                           for f in spec.schema()])
    reader = spark.read.option("mode", "PERMISSIVE")
    if corrupt is not None:
        schema.add(corrupt, T.StringType())
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.schema(schema).json(path)


def dropped_features(tables: dict[str, DataFrame | None], specs: list[TableSpec]) -> list[str]:
    """Features that cannot be built because their optional table is absent."""
    return [f for s in specs if tables.get(s.name) is None for f in s.features]


def validate_table(df: DataFrame, spec: TableSpec, corrupt: str | None = None) -> DataFrame:
    """(column, problem, rows): absent columns, uncastable values, NULLs where none may be, and broken lines
    where `corrupt` names the column that `read_contract_table` put them in.

    One pass counts everything; the result has at most two rows per contracted column and one for broken lines.
    """
    spark = df.sparkSession
    absent = [c for c in spec.columns if c not in df.columns]
    out = spark.createDataFrame([(c, "absent", None) for c in absent], "column string, problem string, rows bigint")
    here = {c: s for c, s in spec.columns.items() if c in df.columns}
    if not here:
        return out
    aggs = []
    for c, s in here.items():
        col = F.col(f"`{c}`")
        aggs += [F.count_if(col.isNotNull() & col.try_cast(s.dtype).isNull()).alias(f"uncastable#{c}"),
                 F.count_if(col.isNull()).alias(f"null#{c}")]
    broken = corrupt is not None and corrupt in df.columns
    if broken:
        aggs.append(F.count_if(F.col(f"`{corrupt}`").isNotNull()).alias(f"corrupt#{corrupt}"))
    one = df.agg(*aggs)
    counted = [(c, kind) for c, s in here.items() for kind in ("uncastable", "null")
               if kind == "uncastable" or not s.nullable] + [(corrupt, "corrupt")] * broken
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kind).alias("problem"),
                               F.col(f"`{kind}#{c}`").alias("rows")) for c, kind in counted])
    found = one.select(F.explode(parts).alias("_p")).select("_p.*")
    return out.unionByName(found.where(F.col("rows") > 0))


def require_valid(df: DataFrame, spec: TableSpec, corrupt: str | None = None) -> DataFrame:
    """Abort with every problem named, else hand the frame on."""
    problems = validate_table(df, spec, corrupt).collect()  # at most two rows per contracted column, and one
    if problems:
        text = "; ".join(f"{p.column}: {p.problem}" + (f" ({p.rows} rows)" if p.rows else "") for p in problems)
        raise ValueError(f"{spec.name}: {text}")
    return df


def safe_name(name: str) -> str:
    return re.sub(r"[^0-9a-zA-Z_]", "_", name)


def prefixed_columns(columns: list[str], prefixes: list[str], expect: int | None = None) -> dict[str, str]:
    """Column -> safe name for every column with one of the prefixes; collisions are refused."""
    chosen = [c for c in columns if any(c.startswith(p) for p in prefixes)]
    if expect is not None and len(chosen) != expect:
        raise ValueError(f"expected {expect} columns with prefixes {prefixes}, found {len(chosen)}")
    names: dict[str, str] = {}
    for c in chosen:
        safe = safe_name(c)
        if safe in names.values():
            raise ValueError(f"column names collide as {safe}")
        names[c] = safe
    return names


def select_by_prefix(cohort: DataFrame, wide: DataFrame, prefixes: list[str], key: str,
                     expect: int | None = None) -> DataFrame:
    """Left-join the prefixed columns to the cohort; refuse a key that would add rows."""
    names = prefixed_columns([c for c in wide.columns if c != key], prefixes, expect)
    right = wide.select(key, *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    repeated = right.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    if repeated.join(cohort.select(key), key, "left_semi").limit(1).count():
        raise ValueError(f"{key} repeats in the wide table; the join would add rows")
    return cohort.join(right, key, "left")


def table_fingerprint(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(n_rows, hash): independent of row order and partitioning, computed in one pass.

    Values carry their length, so neighbours cannot be confused, nor NULL with any text. All 256 bits of each
    row's SHA-256 count: as twelve limbs of 20 bits and one of 16, each summed over the rows and joined by
    colons, so fingerprints of parts add up limb by limb. A limb holds the sum of 2^43 rows.
    """
    cols = columns or df.columns
    parts = [F.col(f"`{c}`").cast("string") for c in cols]
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.length(p), F.lit(":"), p), F.lit("~")) for p in parts])
    digest = F.sha2(text, 256)
    words = df.select(*[F.conv(F.substring(digest, 15 * i + 1, 15), 16, 10).cast("bigint").alias(f"_{i}")
                        for i in range(5)])
    low = (1 << 20) - 1
    limbs = [F.shiftright(f"_{i}", shift).bitwiseAND(F.lit(low)) for i in range(4) for shift in (40, 20, 0)] + [F.col("_4")]
    return words.agg(F.count(F.lit(1)).alias("n_rows"),
                     F.concat_ws(":", *[F.coalesce(F.sum(x), F.lit(0)).cast("string") for x in limbs]).alias("hash"))


def require_fingerprint(df: DataFrame, n_rows: int, hash_: str) -> DataFrame:
    """Abort unless the table is exactly the one that was written."""
    seen = table_fingerprint(df).first()
    if (seen.n_rows, seen.hash) != (n_rows, hash_):
        raise ValueError(f"fingerprint mismatch: rows {seen.n_rows} vs {n_rows}, hash {seen.hash} vs {hash_}")
    return df


def write_derived(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None,
                  overwrite: bool = False, **extra: str) -> DataFrame:
    """Write the table and a one-row metadata table beside it; returns the metadata.

    An existing table is replaced only if asked for.

    The fingerprint is taken from what was written, so it can be re-checked before use.
    """
    spark = df.sparkSession
    mode = "overwrite" if overwrite else "errorifexists"
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.format(fmt).save(path)
    back = spark.read.option("header", True).format(fmt).load(path)
    meta = table_fingerprint(back, sorted(back.columns)).withColumns(
        {"path": F.lit(path), "format": F.lit(fmt), "columns": F.lit(",".join(df.columns)),
         **{k: F.lit(x) for k, x in extra.items()}})
    meta.write.mode(mode).json(path.rstrip("/") + "_meta")
    return spark.read.schema(meta.schema).json(path.rstrip("/") + "_meta")
