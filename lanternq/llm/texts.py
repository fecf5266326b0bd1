"""Texts as sets of word sequences, and classes of texts with equal sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternq.llm import hashing as H
from lanternq.session import materialize


def set_keys(seqs: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that identify a set, as two numbers: wrapping sums of two hashes of its members."""
    u = seqs.view(H.U64)
    return tuple(H.segment_reduce(np.add, H.mix(u ^ H.U64(c)), counts).view(np.int64) for c in (0x51ED27, 0xA24BAED4963EE407))


def sequence_sets(
    df: DataFrame, key: str, text: str, order: str | None, width: int, min_words: int,
    extra: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict] | None = None, extra_schema: str = "", keep: tuple[str, ...] = (),
) -> DataFrame:
    """(k0, o0, keep..., key1, key2, seqs, extra...): the sorted distinct sequences of each text with at least min_words words.
    Rows with a null key or text are left out. extra(flat, h, at, seqs, counts) gives further columns, a list of values per text."""
    rows = df.filter(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).cast("bigint").alias("k0"), (F.col(order) if order else F.lit(0)).alias("o0"), F.col(text).alias("t0"), *keep
    )
    types = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in keep)
    o_type = rows.schema["o0"].dataType.simpleString()

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = H.WordHasher()
        for f in H.batches(frames, 1000, "t0"):
            flat, n = H.word_arrays(f["t0"].tolist(), hasher)
            ok = n >= max(min_words, width)
            if not ok.any():
                continue
            flat, f, n = flat[np.repeat(ok, n)], f[ok], n[ok]
            h, owner, at = H.sequences(flat, n, width)
            seqs, counts = H.distinct_by_owner(h, owner, len(n))
            k1, k2 = set_keys(seqs, counts)
            more = extra(flat, h, at, seqs, counts) if extra else {}
            yield f.drop(columns="t0").assign(key1=k1, key2=k2, seqs=H.split(seqs, counts), **more)

    return rows.mapInPandas(work, f"k0 bigint, o0 {o_type}{types}, key1 bigint, key2 bigint, seqs array<bigint>{', ' if extra_schema else ''}{extra_schema}")


def classes(features: DataFrame, columns: tuple[str, ...], sums: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """(reps, members) of a materialised sequence_sets. reps: rep, columns..., sums...; rep is the least key of the class. members:
    k0, rep; a key that comes with several texts counts with the one that is first in order."""
    by = ["key1", "key2"]
    reps = materialize(features.groupBy(*by).agg(F.min("k0").alias("rep"), *(F.first(c).alias(c) for c in columns), *sums), "classes")
    one = features.groupBy("k0").agg(F.min_by(F.struct(*by), F.struct("o0", *by)).alias("s")).select("k0", "s.*")
    return reps, materialize(one.join(reps.select(*by, "rep"), by).select("k0", "rep"), "members")


def expand_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of members of linked classes and of members of one class."""
    a = members.select(F.col("k0").alias("a0"), F.col("rep").alias("x"))
    b = members.select(F.col("k0").alias("b0"), F.col("rep").alias("y"))
    across = links.select("x", "y").join(a, "x").join(b, "y").select("a0", "b0")
    within = a.join(b, (F.col("x") == F.col("y")) & (F.col("a0") < F.col("b0"))).select("a0", "b0")
    return across.unionByName(within).select(F.least("a0", "b0").alias("id_a"), F.greatest("a0", "b0").alias("id_b"))
