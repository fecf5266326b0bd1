"""Problem 7: items into containers of fixed capacity, by first-fit decreasing in randomised groups.

Items are spread over groups of about `group_items` by a seeded hash of their key; every group is packed on its own with a
tournament tree over the room left in its containers, so the work is n log n and no task grows with the corpus. A larger item is
split into full containers and a rest; no other item is split.

Defined results: items of size 0 (null or empty texts) are placed in the first container of their group and take no room; equal
sizes are ordered by key; a capacity that is null or below 1 has no containers; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternq.session import materialize

#: Kinds of containers are a parameter table; a table beyond this is refused, never shortened.
MAX_KINDS = 1000


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item; sizes must be in descending order and at most capacity."""
    n = len(sizes)
    width = 1
    while width < max(n, 1):
        width *= 2
    tree = [capacity] * (2 * width)  # a node holds the most room left below it
    out = np.zeros(n, np.int64)
    i = 0
    while i < n:
        s = int(sizes[i])
        same = i
        while same < n and sizes[same] == s:
            same += 1
        while i < same:
            node = 1
            while node < width:
                node *= 2
                if tree[node] < s:
                    node += 1
            fits = same - i if s == 0 else min(same - i, tree[node] // s)
            out[i : i + fits] = node - width
            i += fits
            tree[node] -= fits * s
            while node > 1:
                node //= 2
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a >= b else b
    return out


def pack(items: DataFrame, containers: DataFrame, key: str = "doc_id", size: str = "n_tokens", group_items: int = 20000, seed: int = 7) -> DataFrame:
    """(model, capacity_tokens, container_id, key, part_no, start_token, tokens) for each row of containers
    (model string, capacity_tokens int) and each item. part_no counts the parts of a split item from 0."""
    key_type = items.schema[key].dataType.simpleString()
    base = items.select(F.col(key).alias("k0"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("n0"))
    base = materialize(base, "sizes")  # sizes may be costly to make and are read twice
    groups = max(1, -(-base.count() // group_items))
    caps = containers.select("model", F.col("capacity_tokens").cast("bigint").alias("cap")).filter("cap >= 1").distinct()
    kinds = caps.limit(MAX_KINDS + 1).collect()
    if len(kinds) > MAX_KINDS:
        raise ValueError(f"more than {MAX_KINDS} kinds of containers")
    if not kinds:
        return items.sparkSession.createDataFrame([], f"model string, capacity_tokens bigint, container_id bigint, {key} {key_type}, part_no bigint, start_token bigint, tokens bigint")
    joined = (
        base.withColumn("g0", F.pmod(F.xxhash64("k0", F.lit(seed)), F.lit(groups)))
        .withColumn("kind", F.explode(F.array(*(F.struct(F.lit(r["model"]).alias("model"), F.lit(int(r["cap"])).cast("bigint").alias("cap")) for r in kinds))))
        .select("k0", "n0", "g0", "kind.model", "kind.cap")
        .withColumn("full", F.when((F.col("n0") > F.col("cap")), F.floor((F.col("n0") - 1) / F.col("cap"))).otherwise(F.lit(0)).cast("bigint"))
    )

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        cap, g = int(pdf["cap"].iloc[0]), int(pdf["g0"].iloc[0])
        pdf = pdf.assign(rest=pdf["n0"] - pdf["full"] * cap).sort_values(["rest", "k0"], ascending=[False, True], kind="stable")
        bins = first_fit_decreasing(pdf["rest"].to_numpy(np.int64), cap)
        used = int(bins.max()) + 1 if len(bins) else 0
        small = pd.DataFrame({"no": bins, "k0": pdf["k0"], "part_no": pdf["full"], "start_token": pdf["full"] * cap, "tokens": pdf["rest"]})
        whole = pdf.loc[pdf["full"].to_numpy() > 0, ["k0", "full"]]
        times = whole["full"].to_numpy(np.int64)
        part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        large = pd.DataFrame({"no": used + np.arange(len(part)), "k0": np.repeat(whole["k0"].to_numpy(), times), "part_no": part, "start_token": part * cap, "tokens": cap})
        out = pd.concat([large, small], ignore_index=True) if len(large) else small
        return out.assign(model=pdf["model"].iloc[0], capacity_tokens=cap, container_id=(g << 32) + out["no"].to_numpy(np.int64))[["model", "capacity_tokens", "container_id", "k0", "part_no", "start_token", "tokens"]]

    schema = f"model string, capacity_tokens bigint, container_id bigint, k0 {key_type}, part_no bigint, start_token bigint, tokens bigint"
    return joined.groupBy("model", "cap", "g0").applyInPandas(group, schema).withColumnRenamed("k0", key)


def fill_report(placed: DataFrame) -> DataFrame:
    """Per container kind: containers, tokens, and the share of room left unused."""
    bins = placed.groupBy("model", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("t"))
    return (
        bins.groupBy("model", "capacity_tokens")
        .agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
        .withColumn("unused_share", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6))
    )
