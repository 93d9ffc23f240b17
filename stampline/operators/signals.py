"""Array jobs on multi-lead signals: cleaning, decimation, lead order, statistics, crops.

A record is one row with `leads`, an array of equally long channels. Every job works inside
the row, so nothing shuffles; NumPy runs on Arrow batches where a channel needs a recurrence.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stampline.functions.expr import uniform

LEADS = "array<array<double>>"


def on_channels(df: DataFrame, leads: str, fn: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Replace the channels by `fn(samples, bounds)` of a whole Arrow batch at once.

    samples: all channels end to end, NULL as NaN; bounds: where each begins, and the end. fn returns the new
    ones alike. NULL records and NULL channels stay NULL.
    """
    @F.arrow_udf(LEADS)
    def run(records: pa.Array) -> pa.Array:
        channels = records.flatten()
        samples = channels.flatten().to_numpy(zero_copy_only=False).astype(float)
        bounds = _bounds(channels)
        samples, bounds = fn(samples, bounds)
        inner = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(samples, from_pandas=True),
                                         mask=channels.is_null())
        return pa.ListArray.from_arrays(pa.array(_bounds(records), pa.int32()), inner, mask=records.is_null())

    # The flag keeps the planner from evaluating the function again in a filter it derives.
    return df.withColumn(leads, run.asNondeterministic()(F.col(leads)))


def _bounds(lists: pa.Array) -> np.ndarray:
    return np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))


def filled(samples: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Linear inside a channel, last value after the end; a leading gap has nothing to start from."""
    at, known = np.arange(len(samples)), ~np.isnan(samples)
    begin, end = (np.repeat(b, np.diff(bounds)) for b in (bounds[:-1], bounds[1:]))
    before = np.maximum.accumulate(np.where(known, at, -1)) if len(at) else at
    after = np.minimum.accumulate(np.where(known, at, len(at))[::-1])[::-1] if len(at) else at
    some, more = before >= begin, after < end
    left = samples[np.where(some, before, at)]
    right = samples[np.where(more, after, at)]
    slope = np.where(more & (after > before), (right - left) / np.maximum(after - before, 1), 0.0)
    return np.where(known, samples, np.where(some, left + slope * (at - before), np.nan))


def signal_clean(df: DataFrame, leads: str = "leads", clip: float = 3.0) -> DataFrame:
    """Fill interior gaps by linear interpolation, then clip to ±clip."""
    return on_channels(df, leads, lambda samples, bounds: (np.clip(filled(samples, bounds), -clip, clip), bounds))


def fir_taps(factor: int, half_width: int = 4) -> list[float]:
    """Hann-windowed sinc low-pass at the target Nyquist rate, unit gain at zero frequency."""
    half = half_width * factor
    taps = []
    for k in range(-half, half + 1):
        x = k / factor
        sinc = 1.0 if k == 0 else math.sin(math.pi * x) / (math.pi * x)
        taps.append(sinc * (0.5 + 0.5 * math.cos(math.pi * k / (half + 1))))
    total = sum(taps)
    return [t / total for t in taps]


def signal_decimate(df: DataFrame, factor: int, leads: str = "leads") -> DataFrame:
    """Band-limit each channel and keep every factor-th sample; the ends are held. NULL counts as 0."""
    taps = fir_taps(factor)
    half = len(taps) // 2

    def decimate(samples: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.nan_to_num(samples)
        kept = -(-np.diff(bounds) // factor)
        new = np.append(0, np.cumsum(kept))
        begin, last = (np.repeat(b, kept) for b in (bounds[:-1], bounds[1:] - 1))
        centre = begin + (np.arange(new[-1]) - np.repeat(new[:-1], kept)) * factor
        out = np.zeros(len(centre))
        for k, tap in enumerate(taps):  # one pass over all channels per tap
            out += tap * x[np.clip(centre + k - half, begin, last)]
        return out, new

    return on_channels(df, leads, decimate)


def leads_by_name(df: DataFrame, order: list[str], names: str = "names", leads: str = "leads") -> DataFrame:
    """Put channels in the declared order by lower-cased name, never by position.

    A lead that is not there becomes zeros; `leads_mapped` counts those that were.
    """
    low = F.transform(F.col(names), lambda n: F.lower(n))
    by_name = F.map_from_arrays(low, F.col(leads))
    zeros = F.array_repeat(F.lit(0.0), F.size(F.col(leads)[0]))
    wanted = [n.lower() for n in order]
    mapped = F.aggregate(F.array(*[F.array_contains(low, n).cast("int") for n in wanted]), F.lit(0), lambda a, x: a + x)
    return df.withColumns({
        leads: F.array(*[F.coalesce(F.try_element_at(by_name, F.lit(n)), zeros) for n in wanted]),
        "leads_mapped": mapped})


def nulls_in(leads: Column) -> Column:
    return F.aggregate(F.flatten(leads), F.lit(0), lambda a, x: a + x.isNull().cast("int"))


def signal_stats(df: DataFrame, raw: str = "raw", leads: str = "leads") -> DataFrame:
    """Per record: NULLs before and after, amplitude range, non-zero leads, content digest."""
    flat = F.flatten(F.col(leads))
    alive = F.filter(F.col(leads), lambda lead: F.exists(lead, lambda x: x.isNotNull() & (x != 0)))
    text = F.transform(flat, lambda x: F.coalesce(F.round(x * 1e6).cast("bigint").cast("string"), F.lit("~")))
    return df.withColumns({
        "nulls_before": nulls_in(F.col(raw)), "nulls_after": nulls_in(F.col(leads)),
        "amp_min": F.array_min(flat), "amp_max": F.array_max(flat), "leads_nonzero": F.size(alive),
        "digest": F.substring(F.sha2(F.array_join(text, ","), 256), 1, 16)})


def signal_totals(stats: DataFrame, n_leads: int) -> DataFrame:
    """One row: records, residual NULLs, records with residue, records short of leads."""
    return stats.agg(
        F.count(F.lit(1)).alias("n_records"), F.sum("nulls_after").alias("nulls_after_total"),
        F.count_if(F.col("nulls_after") > 0).alias("records_with_residue"),
        F.count_if(F.col("leads_nonzero") != n_leads).alias("records_incomplete"))


def fixed_crops(df: DataFrame, length: int, leads: str = "leads") -> DataFrame:
    """Non-overlapping crops at 0, L, 2L, …; NULL becomes 0; a length that does not divide fails."""
    n = F.size(F.col(leads)[0])
    checked = F.when(n % length == 0, n).otherwise(F.raise_error(F.lit(f"crop length {length} does not divide the signal")))
    starts = F.sequence(F.lit(0), F.floor(checked / length).cast("int") - 1)
    crop = F.transform(F.col(leads), lambda lead: F.transform(
        F.slice(lead, F.col("crop") * length + 1, length), lambda x: F.coalesce(x, F.lit(0.0))))
    return df.select("*", F.explode(starts).alias("crop")).withColumn("crop_leads", crop)


def hashed_crop(df: DataFrame, length: int, key: str, seed: int, epoch: int, leads: str = "leads") -> DataFrame:
    """One random crop per record whose offset depends on (seed, epoch, key) alone."""
    room = F.size(F.col(leads)[0]) - length + 1
    offset = F.floor(uniform(F.lit(seed), F.lit(epoch), F.col(key)) * room).cast("int")
    crop = F.transform(F.col(leads), lambda lead: F.transform(
        F.slice(lead, F.col("offset") + 1, length), lambda x: F.coalesce(x, F.lit(0.0))))
    return df.withColumn("offset", offset).withColumn("crop_leads", crop)
