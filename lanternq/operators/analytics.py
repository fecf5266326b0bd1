"""Aggregates over a results log: rates, groups, pivots, confusion, calibration, coverage, histograms and a two-way analysis of
variance. Values are read through functions.records.number, so NaN and text that is no number count as missing."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternq.functions import text as X
from lanternq.functions.records import number, rate_value


def mean(c: str, digits: int = 6) -> Column:
    return F.round(F.avg(number(c)), digits)


def means(df: DataFrame, by: Sequence[str], columns: Sequence[str], digits: int = 6) -> DataFrame:
    """Means of those columns that are present, by group, with the group's rows."""
    there = [c for c in columns if c in df.columns]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(mean(c, digits).alias(c) for c in there))


def share(condition: Column, digits: int = 6) -> Column:
    """Share of rows on which the condition holds; a null condition counts as not; 0 for no rows."""
    return F.round(F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), F.lit(0.0)), digits)


def grouping_rates(df: DataFrame, sets: Sequence[Sequence[str]], rates: dict[str, Column]) -> DataFrame:
    """Mean rates over several groupings in one pass; columns outside a grouping are null and `grouping` tells which one it is."""
    names = sorted({c for s in sets for c in s})
    sizes = {c: 1 << (len(names) - 1 - i) for i, c in enumerate(names)}
    label = F.lit("")
    for s in sets:
        code = sum(v for c, v in sizes.items() if c not in s)
        label = F.when(F.grouping_id() == code, F.lit("+".join(sorted(s)) or "all")).otherwise(label)
    cols = [df[c] for c in names]
    return df.groupingSets([[df[c] for c in s] for s in sets], *cols).agg(label.alias("grouping"), F.count(F.lit(1)).alias("n"), *(F.round(F.avg(c), 6).alias(k) for k, c in rates.items()))


def pivot_mean(df: DataFrame, row: str, column: str, values: Sequence[str], measure: str) -> DataFrame:
    """One row per `row`, one mean per value; values are named, so that the pivot needs no pass of its own."""
    means_ = (F.round(F.avg(F.when(F.col(column) == v, number(measure))), 6).alias(v) for v in values)
    return df.groupBy(row).agg(*means_)


def middle(c: Column, q: float, accuracy: int | None) -> Column:
    """A percentile, exact with interpolation, or within 1 / accuracy of its rank where a group has too many distinct values to be counted."""
    return F.percentile(c, q) if accuracy is None else F.percentile_approx(c, q, accuracy)


def describe_by(df: DataFrame, by: Sequence[str], columns: Sequence[str], accuracy: int | None = None) -> DataFrame:
    """Long form: group, metric, count, mean, median, min and max."""
    long = df.select(*by, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), number(c).alias("v")) for c in columns))).alias("s")).select(*by, "s.*")
    return long.groupBy(*by, "metric").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(middle(F.col("v"), 0.5, accuracy), 6).alias("median"), F.min("v").alias("low"), F.max("v").alias("high"))


def value_share(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, value, n, share): how the values of a group are distributed; null values are left out."""
    c = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(by)), 6))


def confusion(df: DataFrame, gold: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., gold, predicted, n, row_share) of pairs in which neither side is blank; pairs that don't occur have no row."""
    ok = df.filter(~X.is_blank(gold) & ~X.is_blank(predicted))
    c = ok.groupBy(*by, F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("row_share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*by, "gold")), 6))


def class_accuracy(df: DataFrame, gold: str, predicted: str, by: Sequence[str] = (), labels: DataFrame | None = None) -> DataFrame:
    """(by..., gold, total, correct, accuracy); with labels (gold), those without rows get 0."""
    hit = F.coalesce(F.col(gold) == F.col(predicted), F.lit(False))
    out = df.groupBy(*by, F.col(gold).alias("gold")).agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("correct"))
    if labels is not None:
        out = labels.join(out, "gold", "left").fillna(0, ["total", "correct"])
    return out.withColumn("accuracy", F.round(F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)), 6))


def slice_accuracy(df: DataFrame, gold: str, predicted: str, bucket: str, labels: DataFrame) -> DataFrame:
    """(level, value, total, correct, accuracy) in one pass: overall, per label (those of labels (gold) without rows get 0) and per bucket. Gold labels that
    can't be mapped count for the fallback."""
    rows = df.select(X.label_or_fallback(gold).alias("gold"), X.label_or_text(predicted).alias("p__"), F.col(bucket).alias("bucket"))
    hit = F.coalesce(F.col("gold") == F.col("p__"), F.lit(False))
    sets = rows.groupingSets([[], [F.col("gold")], [F.col("bucket")]], "gold", "bucket").agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("correct"), F.grouping_id().alias("g__"))
    level = F.when(F.col("g__") == 3, "overall").when(F.col("g__") == 1, "label").otherwise("bucket")
    some = sets.select(level.alias("level"), F.when(F.col("g__") == 1, F.col("gold")).when(F.col("g__") == 2, F.col("bucket")).alias("value"), "total", "correct")
    wanted = labels.select(F.lit("label").alias("level"), F.col("gold").alias("value"), F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias("correct"))
    out = some.unionByName(wanted).groupBy("level", "value").agg(F.sum("total").alias("total"), F.sum("correct").alias("correct"))
    return out.withColumn("accuracy", F.round(F.coalesce(F.try_divide("correct", "total"), F.lit(0.0)), 6))


def extremes(pairs: DataFrame, value: str, first: str = "a", second: str = "b") -> DataFrame:
    """One row: the mean of a value over pairs, the least and the greatest one, and the pairs that have them (the first by name on ties)."""
    low, high = F.min(F.struct(value, first, second)).alias("l"), F.min(F.struct((-F.col(value)).alias("v"), first, second)).alias("h")
    one = pairs.agg(F.avg(value).alias("mean"), low, high)
    return one.select("mean", F.col(f"l.{value}").alias("low"), F.col(f"l.{first}").alias("low_a"), F.col(f"l.{second}").alias("low_b"), (-F.col("h.v")).alias("high"), F.col(f"h.{first}").alias("high_a"), F.col(f"h.{second}").alias("high_b"))


def calibration(df: DataFrame, by: str, confidence: str, correct: str, edges: Sequence[float]) -> DataFrame:
    """(by, low, high, n, mean_confidence, accuracy) for every bin [low, high) of every group; empty bins have n 0 and nulls. Values
    outside all bins and missing ones are left out."""
    c = number(confidence)
    no = F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        no = F.when((c >= edges[i]) & (c < edges[i + 1]), F.lit(i)).otherwise(no)
    rows = df.select(by, c.alias("c"), number(correct).alias("y"), no.alias("bin")).groupBy(by, "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("mean_confidence"), F.round(F.avg("y"), 6).alias("accuracy"))
    bins = F.explode(F.array(*(F.struct(F.lit(i).alias("bin"), F.lit(float(edges[i])).alias("low"), F.lit(float(edges[i + 1])).alias("high")) for i in range(len(edges) - 1))))
    grid = df.select(by).distinct().select(by, bins.alias("s")).select(by, "s.*")
    on = grid[by].eqNullSafe(rows[by]) & (grid["bin"] == rows["bin"])
    return grid.join(rows, on, "left").select(grid[by], "low", "high", F.coalesce("n", F.lit(0)).alias("n"), "mean_confidence", "accuracy")


def coverage(df: DataFrame, confidence: str, correct: str, thresholds: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., threshold, n, coverage, accuracy): rows at or above each threshold, of all rows with a confidence; one pass."""
    c, y = number(confidence), number(correct)
    base = df.filter(c.isNotNull())
    cells = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.count_if(c >= t).alias("n"), F.count(F.lit(1)).alias("all"), F.avg(F.when(c >= t, y)).alias("a")) for t in thresholds))
    out = base.groupBy(*by).agg(cells.alias("s")).select(*by, F.explode("s").alias("s")).select(*by, "s.*")
    return out.select(*by, "threshold", "n", F.round(F.col("n") / F.col("all"), 6).alias("coverage"), F.round("a", 6).alias("accuracy"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin, low, high, n): equal-width bins from the least to the greatest value, the last one closed; empty bins are left out."""
    v = df.select(number(column).alias("v")).filter("v is not null")
    r = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    no = F.least(F.coalesce(F.floor(F.try_divide(F.col("v") - F.col("lo"), width)), F.lit(0)), F.lit(bins - 1)).cast("int")
    out = v.join(F.broadcast(r)).groupBy(no.alias("bin"), "lo", width.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("bin", F.round(F.col("lo") + F.col("bin") * F.col("w"), 6).alias("low"), F.round(F.col("lo") + (F.col("bin") + 1) * F.col("w"), 6).alias("high"), "n")


def quartiles(df: DataFrame, by: str, column: str, accuracy: int | None = None) -> DataFrame:
    v = number(column)
    named = (F.round(middle(v, q, accuracy), 6).alias(n) for n, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)))
    return df.groupBy(by).agg(*named, F.round(F.avg(v), 6).alias("mean"))


def macro_f1(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row: accuracy, and the unweighted mean of F1 over all labels that are gold or predicted somewhere."""
    c = df.filter(F.col(gold).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = c.select(F.explode(F.array(F.struct(F.col("g").alias("label"), F.col("n").alias("gold"), F.lit(0).cast("bigint").alias("pred"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("gold"), F.col("n").alias("pred"), F.lit(0).cast("bigint").alias("tp")))).alias("s")).select("s.*")
    per = sides.groupBy("label").agg(F.sum("gold").alias("gold"), F.sum("pred").alias("pred"), F.sum("tp").alias("tp"))
    return per.agg(F.round(F.sum("tp") / F.sum("gold"), 6).alias("accuracy"), F.round(F.avg(2 * F.col("tp") / (F.col("gold") + F.col("pred"))), 6).alias("macro_f1"))


def class_weights(df: DataFrame, label: str, labels: DataFrame, boosts: dict[str, float]) -> DataFrame:
    """(label, n, weight): n_all / (k * n) times the label's boost; labels without rows weigh 1."""
    c = df.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("k"))
    boost = F.lit(1.0)
    for k, v in boosts.items():
        boost = F.when(F.col("label") == k, F.lit(v)).otherwise(boost)
    out = labels.join(c, "label", "left").join(F.broadcast(t))
    return out.select("label", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce(F.col("all") / (F.col("k") * F.col("n")) * boost, F.lit(1.0)), 6).alias("weight"))


def compliance(df: DataFrame, fallback: str = "miscellaneous") -> DataFrame:
    rates = {"json_rate": rate_value("json_valid"), "schema_rate": rate_value("schema_valid"), "fallback_rate": F.coalesce(F.lower("predicted_category") == fallback, F.lit(False)).cast("double")}
    return grouping_rates(df, [[], ["model"], ["router"]], rates)


def _beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by the continued fraction of Lentz."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_tail(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d, f = 1.0, 1.0 - (a + b) * x / (a + 1), 0.0
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    f = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or 1e-300)
            c = 1 + top / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-13:
            break
    return front * f


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f) with d1 and d2 degrees of freedom."""
    return 1.0 if f <= 0 else _beta_tail(d2 / (d2 + d1 * f), d2 / 2, d1 / 2)


def anova(df: DataFrame, first: str, second: str, value: str) -> DataFrame:
    """(term, sum_sq, df, f, p): two-way analysis of variance of type II with interaction. Only the cells' n, sum and sum of squares
    leave the executors (factor levels are few by nature; more than 2000 cells are refused). No rows if nothing can be tested."""
    cells = df.select(F.col(first).alias("a"), F.col(second).alias("b"), number(value).alias("v")).dropna().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    rows = cells.orderBy("a", "b").limit(2001).collect()
    if len(rows) > 2000:
        raise ValueError("more than 2000 cells")
    schema = "term string, sum_sq double, df double, f double, p double"
    spark = df.sparkSession
    if not rows:
        return spark.createDataFrame([], schema)
    n, s, q = (np.array([r[k] for r in rows], float) for k in "nsq")
    levels_a, levels_b = (sorted({r[k] for r in rows}) for k in "ab")
    one = np.ones((len(rows), 1))
    da = np.array([[r["a"] == x for x in levels_a[1:]] for r in rows], float).reshape(len(rows), -1)
    db = np.array([[r["b"] == x for x in levels_b[1:]] for r in rows], float).reshape(len(rows), -1)
    dab = (da[:, :, None] * db[:, None, :]).reshape(len(rows), -1)

    def residual(*parts: np.ndarray) -> tuple[float, int]:
        x = np.hstack([one, *parts])
        w = np.sqrt(n)
        beta, _, rank, _ = np.linalg.lstsq(x * w[:, None], s / w, rcond=None)
        fit = x @ beta
        return float(q.sum() - 2 * (fit * s).sum() + (n * fit * fit).sum()), int(rank)

    (ra, ka), (rb, kb), (rab, kab), (rfull, kfull) = residual(da), residual(db), residual(da, db), residual(da, db, dab)
    left = float(n.sum() - kfull)
    out = []
    for term, ss, d in ((first, rb - rab, kab - kb), (second, ra - rab, kab - ka), (f"{first}:{second}", rab - rfull, kfull - kab)):
        f = (ss / d) / (rfull / left) if d > 0 and left > 0 and rfull > 0 else None
        out.append((term, max(ss, 0.0), float(d), f, f_tail(f, d, left) if f is not None else None))
    out.append(("Residual", rfull, left, None, None))
    return spark.createDataFrame(out, schema)
