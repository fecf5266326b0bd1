"""Deterministic samples, splits and slices: row order comes from a hash of a seed and the key, so both engines and all runs agree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column | str, seed: str) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}|"), c.cast("string")).cast("binary"))


def first_per_group(df: DataFrame, by: str, order: Sequence[Column], n: int) -> DataFrame:
    return df.withColumn("rk", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rk") <= n)


def hash_rank(df: DataFrame, by: str, key: str, seed: str = "s", name: str = "rk") -> DataFrame:
    """df with the rank of each row of its stratum in hash order, from 1, and the stratum's size as `{name}_of`. Strata are ranked in
    256 parts by the leading byte of the hash, and the counts of earlier parts are added, so no task sorts a whole stratum."""
    part, start, size = f"{name}_part", f"{name}_start", f"{name}_of"
    rows = df.withColumn(part, F.substring(hash_order(key, seed), 1, 2))
    counts = rows.groupBy(F.col(by).alias("stratum__"), F.col(part).alias("part__")).agg(F.count(F.lit(1)).alias("n__"))
    w = Window.partitionBy("stratum__")
    before = F.coalesce(F.sum("n__").over(w.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn(start, before).withColumn(size, F.sum("n__").over(w)).drop("n__")
    inside = F.row_number().over(Window.partitionBy(by, part).orderBy(hash_order(key, seed), F.col(key)))
    ranked = rows.withColumn(name, inside)
    on = ranked[by].eqNullSafe(counts["stratum__"]) & ranked[part].eqNullSafe(counts["part__"])
    return ranked.join(counts, on).withColumn(name, (F.col(name) + F.col(start)).cast("int")).drop(part, start, "stratum__", "part__")


def stratified(df: DataFrame, by: str, key: str, targets: DataFrame, seed: str = "s") -> DataFrame:
    """The first `target` rows of each stratum in hash order, all rows of those that have fewer. targets: (by, target)."""
    return hash_rank(df, by, key, seed).join(targets, by).filter(F.col("rk") <= F.col("target")).drop("target", "rk_of")


def train_split(df: DataFrame, by: str, key: str, share: float = 0.8, seed: str = "s") -> DataFrame:
    """df with `part`: the first share of each stratum in hash order is train, the rest validation."""
    ranked = hash_rank(df, by, key, seed)
    return ranked.withColumn("part", F.when(F.col("rk") <= F.floor(F.col("rk_of") * share), "train").otherwise("validation")).drop("rk", "rk_of")


def cut(df: DataFrame, order: Sequence[Column], start: int = 0, n: int | None = None) -> DataFrame:
    """Rows start .. start + n in an explicit order; all from start on without n."""
    out = df.orderBy(*order).offset(start)
    return out if n is None or n < 0 else out.limit(n)
