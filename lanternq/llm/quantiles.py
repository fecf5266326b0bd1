"""Problem 3: percentiles per group of very large numeric columns by radix selection, and mergeable histograms.

A double is mapped to a 64-bit integer of the same order. Round by round the values are counted by their next `digit_bits` bits,
and only the digit that holds a target rank is followed. After all 64 bits the result is the exact order statistic (error bound 0);
after fewer rounds it is the smallest value of the digit, off by at most the digit's width. The histogram of the leading bits is
a summary: histograms of chunks, days or partitions are added up to that of their union, with the same bound.

The p-th percentile is the value of rank ceil(p * n), at least 1, in ascending order.

Defined results: null and NaN values are left out and counted in n_missing; infinities and values below zero are values; -0.0
counts as 0.0; null group columns are a group of their own; group columns that are named like a result are refused; a group without values has null percentiles; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanternq.session import materialize

#: Up to this many targets (groups x percentiles) are broadcast, about 5 MB; beyond, they are joined by shuffle.
BROADCAST_TARGETS = 50_000
SIGN = np.int64(-(1 << 63))


def to_ordered(x: np.ndarray) -> np.ndarray:
    """int64 of the same order as the doubles."""
    b = (np.asarray(x, np.float64) + 0.0).view(np.int64)
    return np.where(b < 0, np.bitwise_xor(np.bitwise_not(b), SIGN), b)


def from_ordered(k: np.ndarray) -> np.ndarray:
    k = np.asarray(k, np.int64)
    return np.where(k < 0, np.bitwise_not(np.bitwise_xor(k, SIGN)), k).view(np.float64)


@F.pandas_udf(T.LongType())
def ordered_bits(x: pd.Series) -> pd.Series:
    v = x.to_numpy(np.float64, na_value=np.nan)
    return pd.Series(to_ordered(v)).astype("Int64").mask(np.isnan(v))


@F.pandas_udf(T.DoubleType())
def ordered_value(k: pd.Series) -> pd.Series:
    return pd.Series(from_ordered(k.fillna(0).to_numpy(np.int64))).mask(k.isna().to_numpy())


def _same(a: DataFrame, b: DataFrame, names: Sequence[str]) -> Column:
    on = F.lit(True)
    for c in names:
        on = on & a[c].eqNullSafe(b[c])
    return on


def _refuse(by: Sequence[str], taken: Sequence[str]) -> None:
    clash = sorted(set(by) & set(taken))
    if clash:
        raise ValueError(f"group columns may not be named {clash}")


def histogram(df: DataFrame, by: Sequence[str], value: str, bits: int = 20) -> DataFrame:
    """(by..., digit bigint, n bigint): counts by the leading `bits` bits; digit is null for missing values. With b bits the
    digit of a value other than 0 spans at most 2**(12 - b) of it, b > 12."""
    _refuse(by, ("digit", "n"))
    key = F.shiftright(ordered_bits(F.col(value).cast("double")), 64 - bits)
    return df.select(*by, key.alias("digit")).groupBy(*by, "digit").agg(F.count(F.lit(1)).alias("n"))


def _bounds(digit: str, left: int) -> tuple[Column, Column]:
    """(low, high) of the doubles whose leading bits are the digit; beyond the infinities lie no numbers."""
    low = ordered_value(F.shiftleft(digit, left))
    high = ordered_value(F.shiftleft(digit, left).bitwiseOR(F.lit((1 << left) - 1)))
    return F.coalesce(low, F.lit(float("-inf"))).alias("low"), F.coalesce(high, F.lit(float("inf"))).alias("high")


def merge_histograms(hist: DataFrame, by: Sequence[str]) -> DataFrame:
    """Histograms of parts added up to those of the coarser groups `by`."""
    return hist.groupBy(*by, "digit").agg(F.sum("n").alias("n"))


def percentiles_from_histogram(hist: DataFrame, by: Sequence[str], qs: Sequence[float], bits: int = 20) -> DataFrame:
    """(by..., q, n, n_missing, low, high): the exact percentile lies in [low, high]."""
    w = Window.partitionBy(*by).orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
    sums = hist.groupBy(*by).agg(F.sum(F.when(F.col("digit").isNotNull(), F.col("n")).otherwise(0)).alias("total"), F.sum(F.when(F.col("digit").isNull(), F.col("n")).otherwise(0)).alias("n_missing"))
    cum = hist.filter("digit is not null").withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    hit = (
        cum.withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in qs))))
        .withColumn("rank", F.greatest(F.ceil(F.col("q") * F.col("total")), F.lit(1)))
        .filter("upto >= rank and upto - n < rank")
        .select(*by, "q", *_bounds("digit", 64 - bits))
    )
    grid = sums.withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in qs))))
    return grid.join(hit, _same(grid, hit, [*by, "q"]), "left").select(*(grid[c] for c in by), grid["q"], F.col("total").alias("n"), "n_missing", "low", "high")


def radix_percentiles(df: DataFrame, by: Sequence[str], value: str, qs: Sequence[float], digit_bits: int = 16, rounds: int = 4) -> DataFrame:
    """(by..., q, n, n_missing, value, error_bound): the value of rank ceil(q * n). error_bound is 0 after all rounds
    (digit_bits * rounds = 64), else the width of the last digit."""
    by = list(by)
    _refuse(by, ("key", "w", "q", "n", "n_missing", "value", "error_bound", "prefix", "digit", "rank", "c", "upto", "wanted_rank"))
    if digit_bits * rounds > 64:
        raise ValueError("at most 64 bits")
    keyed = df.select(*by, ordered_bits(F.col(value).cast("double")).alias("key"))
    # equal values of a group are counted before anything else, so hot values and hot groups shrink in their own tasks
    base = materialize(keyed.groupBy(*by, "key").agg(F.count(F.lit(1)).alias("w")), "radix")
    totals = base.groupBy(*by).agg(F.sum(F.when(F.col("key").isNotNull(), F.col("w")).otherwise(0)).alias("n"), F.sum(F.when(F.col("key").isNull(), F.col("w")).otherwise(0)).alias("n_missing"))
    grid = materialize(totals.withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in qs)))), "radix-grid")
    small = grid.count() <= BROADCAST_TARGETS
    targets = grid.filter("n > 0").select(*by, "q", F.lit(0).cast("bigint").alias("prefix"), F.greatest(F.ceil(F.col("q") * F.col("n")), F.lit(1)).cast("bigint").alias("rank"))
    rows = base.filter("key is not null")
    for r in range(rounds):
        left = 64 - digit_bits * (r + 1)
        prefix = F.lit(0).cast("bigint") if r == 0 else F.shiftright("key", left + digit_bits)
        wanted = targets.select(*by, "prefix").distinct()
        here = rows.withColumn("prefix", prefix)
        if r:
            side = F.broadcast(wanted) if small else wanted
            here = here.join(side, _same(here, side, [*by, "prefix"]), "left_semi")
        counts = here.groupBy(*by, "prefix", F.shiftright("key", left).alias("digit")).agg(F.sum("w").alias("c"))
        w = Window.partitionBy(*by, "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("upto", F.sum("c").over(w))
        t = targets.withColumnRenamed("rank", "wanted_rank")
        side = F.broadcast(t) if small else t
        found = counts.join(side, _same(counts, side, [*by, "prefix"]) & (F.col("upto") >= F.col("wanted_rank")) & (F.col("upto") - F.col("c") < F.col("wanted_rank")))
        targets = materialize(found.select(*(counts[c] for c in by), "q", F.col("digit").alias("prefix"), (F.col("wanted_rank") - (F.col("upto") - F.col("c"))).alias("rank")), "radix-round")
    left = 64 - digit_bits * rounds
    low, high = _bounds("prefix", left)
    bound = F.when(low == high, F.lit(0.0)).otherwise(high - low) if left else F.lit(0.0)
    got = targets.select(*by, "q", low.alias("value"), bound.alias("error_bound"))
    return grid.join(got, _same(grid, got, [*by, "q"]), "left").select(*(grid[c] for c in by), grid["q"], "n", "n_missing", "value", "error_bound")
