"""Event ledger and file manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stampline.operators.features import dense_rows


def latest_event_per_key(events: DataFrame, keys: list[str], order: str, kind: str | None = None,
                         event: str = "event") -> DataFrame:
    """The last event per key; a max over structs, so hot keys pre-aggregate map-side."""
    rows = events if kind is None else events.where(F.col(event) == kind)
    rest = [c for c in rows.columns if c not in keys and c != order]
    latest = F.max(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("_last")
    return rows.groupBy(*keys).agg(latest).select(*keys, "_last.*")


def resolve_cells(cells: DataFrame, latest: DataFrame, artefacts: DataFrame, keys: list[str], label: str,
                  fallback: str, run: str = "run_id") -> DataFrame:
    """Run behind each (arm, label, seed): its own, else the one under the fallback label.

    Runs whose artefact is gone do not count.
    """
    alive = latest.join(artefacts.select(run).distinct(), run, "left_semi").select(*keys, run)
    shared = [k for k in keys if k != label]
    own = alive.withColumnRenamed(run, "_own")
    spare = alive.where(F.col(label) == fallback).select(*shared, F.col(run).alias("_spare"))
    return cells.join(own, keys, "left").join(spare, shared, "left") \
        .withColumn(run, F.coalesce("_own", "_spare")).drop("_own", "_spare")


#: What a waveform path must contain, from its `files/` segment on (fixed value).
FILES_PATTERN = r"(?:^|/)(files/.*)$"


def normalised_path(raw: Column, pattern: str = FILES_PATTERN) -> Column:
    """Forward slashes, trimmed, from the recognised segment on; anything else stops the job."""
    text = F.trim(F.replace(raw, F.lit("\\"), F.lit("/")))
    hit = F.regexp_extract(text, pattern, 1)
    return F.when(hit != "", hit).otherwise(F.raise_error(F.concat(F.lit("unrecognised path "), raw)))


def manifest_build(df: DataFrame, path: str, fold: str, assignment: dict[str, list[int]],
                   priority: list[str], pattern: str = FILES_PATTERN) -> DataFrame:
    """Distinct paths in fetch order: split priority, then fold, then path.

    A path listed under several folds keeps its most urgent entry.
    """
    case = None
    for i, split in enumerate(priority):
        hit = F.col(fold).isin(*assignment[split])
        case = F.when(hit, i) if case is None else case.when(hit, i)
    rank = case.otherwise(len(priority) - 1)
    names = F.array(*[F.lit(p) for p in priority])
    rows = df.where(F.col(path).isNotNull()).select(
        normalised_path(F.col(path), pattern).alias("path"),
        F.struct(rank.alias("priority"), F.col(fold).cast("bigint").alias("fold")).alias("_k"))
    best = rows.groupBy("path").agg(F.min("_k").alias("_k")).select("path", "_k.*")
    ordered, _ = dense_rows(best, "priority", "fold", "path")
    return ordered.select(F.col("_row").alias("place"), "path", "fold",
                          names[F.col("priority")].alias("split"))


def manifest_counts(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("split").agg(F.count(F.lit(1)).alias("n_paths"))


#: Bytes per sample of each fixed-width signal format code (fixed values).
FORMAT_BYTES = {"8": 1, "80": 1, "16": 2, "61": 2, "160": 2, "24": 3, "32": 4}


def expected_bytes(header: Column) -> Column:
    """Signals x samples x width from a header text; NULL where the header does not say."""
    lines = F.split(header, r"\r?\n")
    first = F.split(F.trim(lines[0]), r"\s+")
    signals, samples = F.try_element_at(first, F.lit(2)), F.try_element_at(first, F.lit(4))
    n = signals.try_cast("bigint")
    listed = F.slice(lines, F.lit(2), F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("int"))
    codes = F.array_distinct(F.transform(
        F.filter(listed, lambda x: F.size(F.split(F.trim(x), r"\s+")) >= 2),
        lambda x: F.regexp_extract(F.split(F.trim(x), r"\s+")[1], r"^([^x:+]*)", 1)))
    width = F.create_map(*[F.lit(v) for kv in FORMAT_BYTES.items() for v in kv])
    return F.when(F.size(codes) == 1, n * samples.try_cast("bigint") * F.try_element_at(width, codes[0]))


def manifest_verify(expected: DataFrame, listing: DataFrame, headers: DataFrame) -> DataFrame:
    """Status of every expected file: ok, missing, empty or truncated, and a stray partial file.

    `expected` is (path, split), `listing` (path, length) as a directory scan gives it,
    `headers` (record, header) with the header text per record.
    """
    sizes = listing.select("path", "length")
    partial = listing.where(F.col("path").endswith(".part")) \
        .select(F.regexp_replace("path", r"\.part$", "").alias("path")).distinct() \
        .withColumn("stray_part", F.lit(True))
    record = F.regexp_replace("path", r"\.[^./]*$", "")
    want = headers.select("record", expected_bytes(F.col("header")).alias("want"))
    rows = expected.withColumn("record", record).join(sizes, "path", "left").join(partial, "path", "left") \
        .join(want, "record", "left")
    is_data = F.col("path").endswith(".dat")
    status = F.when(F.col("length").isNull(), "missing").when(F.col("length") == 0, "empty") \
        .when(is_data & (F.col("length") != F.col("want")), "truncated").otherwise("ok")
    return rows.select("path", "split", status.alias("status"),
                       F.coalesce("stray_part", F.lit(False)).alias("stray_part"))


def verify_totals(verified: DataFrame) -> DataFrame:
    """Files, and files of each status, per split."""
    return verified.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_files"),
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "missing", "empty", "truncated")],
        F.count_if("stray_part").alias("n_stray"))


def file_listing(spark, path: str) -> DataFrame:
    """(path, length) of every file under a folder, without reading contents."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
