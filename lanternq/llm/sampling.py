"""Problem 4: samples whose categories meet target proportions, by the cube method.

Each unit of a category has the inclusion probability wanted / available. The balancing variables are the category indicators, so
a step along e_i - e_j of two units of one category keeps every balance; in a flight phase units meet in pairs and each
meeting decides at least one of them, with expectations unchanged (a martingale). The flight runs in every task on its own;
at most one undecided unit of each plan and category is left in a task. Those are merged upward and meet in turn, in blocks; the
landing phase decides what remains of each category by rounding its target, largest remainders first within a plan.

wanted of a category = the larger of target_permille * sample_rows / 1000 and min_rows, at most what is available.

Defined results: units without a key or category aren't at hand; a unit that occurs repeatedly counts once; categories of a plan
without units, and shares that cannot be met, are reported with their shortfall; null targets count as 0; an empty table of units
leaves every category of every plan in the report with nothing drawn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternq.session import materialize

EPS = 1e-9


def normal_label(c: Column) -> Column:
    """Lower case, `_` and `-` as spaces, single spaces, trimmed."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.translate(c, "_-", "  ")), r"(?U)\s+", " "), "^ | $", "")


def flight(pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase on one constraint: pairs of undecided units meet until at most one is undecided. The sum is kept."""
    pi = pi.astype(float).copy()
    open_ = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
    while len(open_) > 1:
        open_ = rng.permutation(open_)
        half = len(open_) // 2
        a, b = open_[:half], open_[half : 2 * half]
        s = pi[a] + pi[b]
        low = s <= 1
        # s <= 1: one gets all of s, the other 0; s > 1: one gets 1, the other s - 1
        first = rng.random(half) * np.where(low, s, 2 - s) < np.where(low, pi[a], 1 - pi[b])
        big, small = np.where(low, s, 1.0), np.where(low, 0.0, s - 1)
        pi[a], pi[b] = np.where(first, big, small), np.where(first, small, big)
        open_ = open_[(pi[open_] > EPS) & (pi[open_] < 1 - EPS)]
    return pi


def balanced_sample(units: DataFrame, plans: DataFrame, key: str, category: str, seed: int = 11, fan_in: int = 1024) -> tuple[DataFrame, DataFrame]:
    """(drawn, report). units: one row per key and category; plans: plan_id, category, target_permille, min_rows, sample_rows.
    drawn: (plan_id, category, key). report: each row of plans with available, wanted, drawn, shortfall and residual."""
    key_type = units.schema[key].dataType.simpleString()
    u = materialize(units.filter(F.col(key).isNotNull() & F.col(category).isNotNull()).select(F.col(key).alias("k0"), F.col(category).alias("c0")).dropDuplicates(["k0"]), "units")
    have = u.groupBy("c0").agg(F.count(F.lit(1)).alias("available"))
    zero = F.lit(0)
    targets = (
        plans.select("plan_id", F.col(category).alias("c0"), *(F.coalesce(F.col(c).cast("bigint"), zero).alias(c) for c in ("target_permille", "min_rows", "sample_rows")))
        .join(have, "c0", "left")
        .withColumn("available", F.coalesce("available", zero))
        .withColumn("target", F.col("target_permille") * F.col("sample_rows") / 1000.0)
        .withColumn("wanted", F.least(F.greatest("target", F.col("min_rows").cast("double")), F.col("available").cast("double")))
    )
    targets = materialize(targets, "targets")
    pdf = targets.filter("available > 0 and wanted > 0").select("plan_id", "c0", (F.col("wanted") / F.col("available")).alias("p")).distinct().toPandas()  # the plans table
    per: dict[str, list[tuple[int, float]]] = {}
    for plan, c, p in zip(pdf["plan_id"], pdf["c0"], pdf["p"]):
        per.setdefault(c, []).append((int(plan), float(p)))

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[tuple[int, str], list] = {}
        for f in frames:
            for c, g in f.groupby("c0", sort=False):
                for plan, p in per.get(c, ()):
                    keys, pi = list(g["k0"]), np.full(len(g), p)
                    if (plan, c) in open_:
                        k, q = open_.pop((plan, c))
                        keys.append(k)
                        pi = np.append(pi, q)
                    rng = np.random.default_rng([seed, plan, zlib.crc32(repr((c, keys[0], len(keys))).encode())])
                    pi = flight(pi, rng)
                    undecided = np.flatnonzero((pi > EPS) & (pi < 1 - EPS))
                    if len(undecided):
                        open_[plan, c] = [keys[undecided[0]], float(pi[undecided[0]])]
                    took = np.flatnonzero(pi >= 1 - EPS)
                    yield pd.DataFrame({"plan_id": plan, "c0": c, "k0": [keys[i] for i in took], "pi": 1.0})
        yield pd.DataFrame([(plan, c, k, q) for (plan, c), (k, q) in open_.items()], columns=["plan_id", "c0", "k0", "pi"])

    schema = f"plan_id int, c0 string, k0 {key_type}, pi double"
    after = materialize(u.mapInPandas(local, schema), "flight")
    decided, rest = after.filter(F.col("pi") >= 1 - EPS), after.filter(F.col("pi") < 1 - EPS)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k0").reset_index(drop=True)
        rng = np.random.default_rng([seed, int(pdf["plan_id"].iloc[0]), zlib.crc32(repr((pdf["c0"].iloc[0], pdf["k0"].iloc[0], len(pdf))).encode())])
        pdf["pi"] = flight(pdf["pi"].to_numpy(), rng)
        return pdf[pdf["pi"] > EPS]

    blocks = max(1, after.rdd.getNumPartitions())
    while True:  # each level leaves at most one undecided unit in a block
        blocks = -(-blocks // fan_in)
        rest = materialize(rest.groupBy("plan_id", "c0", F.pmod(F.xxhash64("k0"), F.lit(blocks))).applyInPandas(meet, schema), "upward")
        if blocks == 1:
            break
    decided = decided.unionByName(rest.filter(F.col("pi") >= 1 - EPS))
    left = rest.filter(F.col("pi") < 1 - EPS)  # at most one of each plan and category
    by_plan = Window.partitionBy("plan_id").orderBy(F.desc("pi"), "c0")
    room = F.round(F.sum("pi").over(Window.partitionBy("plan_id")))
    landed = left.filter(F.lit(True)).withColumn("rank", F.row_number().over(by_plan)).withColumn("room", room).filter("rank <= room").drop("rank", "room")
    drawn = materialize(decided.unionByName(landed).select("plan_id", F.col("c0").alias(category), F.col("k0").alias(key)), "drawn")
    got = drawn.groupBy("plan_id", F.col(category).alias("c0")).agg(F.count(F.lit(1)).alias("drawn"))
    report = (
        targets.join(got, ["plan_id", "c0"], "left")
        .withColumn("drawn", F.coalesce("drawn", zero))
        .select(
            "plan_id", F.col("c0").alias(category), "target_permille", "min_rows", "sample_rows", "available", "wanted", "drawn",
            F.greatest(F.greatest("target", F.col("min_rows").cast("double")) - F.col("available"), F.lit(0.0)).alias("shortfall"),
            (F.col("drawn") - F.col("wanted")).alias("residual"),
        )
    )
    return drawn, report
