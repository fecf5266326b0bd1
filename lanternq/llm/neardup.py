"""Problem 1: near-duplicate texts by the general pigeonhole principle on similarity signatures.

A text is the set of its sequences of five words, and its signature is `dims` min-hash symbols. Each symbol is one dimension of a
Hamming space (one-bit symbols would differ in a quarter of all bits at similarity 0.5, too many for any selective probe). With
similarity s a dimension agrees with probability s, and the radius is chosen so that a pair at the threshold is outside it with a
probability of at most `miss`.

1. Correlated dimensions (hot for the same texts) are grouped into partitions of two.
2. Every text gets a threshold for each partition, -1 (no probe), 0 (both symbols agree) or 1 (one of them agrees). If the sum
   of thresholds + 1 exceeds the radius, each pair within the radius agrees in some partition. Among all such allocations
   dynamic programming finds the one with the fewest candidates, estimated from a sketch of the signatures of all texts.
3. The probes meet the index of all texts (the half with larger keys), hot signatures in salted parts; candidates are verified by
   the exact similarity of their sets.

Texts with equal sets are one class and are compared once. Defined results: rows with a null key or text, and texts with fewer words
than min_words, link to nothing; a key that occurs repeatedly counts once, with the text that is first in order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternq.llm import hashing as H
from lanternq.llm import texts
from lanternq.session import discard, materialize


def radius_for(similarity: float, dims: int, miss: float) -> int:
    """The least radius that a pair at the similarity exceeds with a probability of at most `miss`."""
    tail = 1.0
    for r in range(dims + 1):
        tail -= math.comb(dims, r) * (1 - similarity) ** r * similarity ** (dims - r)
        if tail <= miss:
            return r
    return dims


def minhash(seqs: np.ndarray, counts: np.ndarray, dims: int) -> np.ndarray:
    """Symbols (texts x dims) as uint32."""
    base = H.mix(seqs.view(H.U64))
    rng = np.random.default_rng(20240101)
    mult = rng.integers(0, 2**63, dims, dtype=np.uint64) * H.U64(2) + H.U64(1)
    add = rng.integers(0, 2**63, dims, dtype=np.uint64)
    out = np.empty((len(counts), dims), np.uint32)
    at = np.cumsum(counts) - counts
    for d in range(dims):
        out[:, d] = np.minimum.reduceat(((base * mult[d] + add[d]) >> H.U64(32)).astype(np.uint32), at)
    return out


def single_signatures(symbols: np.ndarray) -> np.ndarray:
    return H.mix(symbols.astype(H.U64) | (np.arange(symbols.shape[1], dtype=H.U64) << H.U64(40)))


def pair_signatures(single: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    return H.mix(single[:, pairs[:, 0]] * H.U64(3) ^ single[:, pairs[:, 1]])


def group_dimensions(together: np.ndarray, n: int) -> np.ndarray:
    """Pairs of dimensions, those first that are hot together most beyond chance."""
    share = np.diag(together) / max(n, 1)
    cov = together / max(n, 1) - np.outer(share, share)
    dims = len(share)
    order = sorted(((i, j) for i in range(dims) for j in range(i + 1, dims)), key=lambda p: (-cov[p], p))
    free, out = set(range(dims)), []
    for i, j in order:
        if i in free and j in free:
            free -= {i, j}
            out.append((i, j))
    return np.array(out)


def allocate(cost_both: np.ndarray, cost_any: np.ndarray, need: int) -> np.ndarray:
    """Thresholds (texts x partitions) in {-1, 0, 1} with a sum of threshold + 1 of at least need and the least total cost."""
    n, m = cost_both.shape
    best = np.full((n, need + 1), np.inf)
    best[:, 0] = 0
    took = np.zeros((m, n, need + 1), np.int8)
    for p in range(m):
        new = best.copy()
        for gain, cost in ((1, cost_both[:, p]), (2, cost_any[:, p])):
            with_it = np.full_like(best, np.inf)
            with_it[:, gain:] = best[:, : need + 1 - gain] + cost[:, None]
            if gain == 2:
                with_it[:, need] = np.minimum(with_it[:, need], best[:, need - 1] + cost)
            better = with_it < new
            new = np.where(better, with_it, new)
            took[p][better] = gain
        best = new
    out = np.zeros((n, m), np.int64)
    left, rows = np.full(n, need), np.arange(n)
    for p in range(m - 1, -1, -1):
        g = took[p, rows, left]
        out[:, p] = g - 1
        left = np.maximum(left - g, 0)
    return out


def nibbles(symbols: np.ndarray) -> np.ndarray:
    """(texts x longs): four bits of each symbol, sixteen symbols to a number. Equal symbols have equal bits."""
    n, dims = symbols.shape
    low = np.zeros((n, -(-dims // 16) * 16), np.uint64)
    low[:, :dims] = symbols & np.uint32(15)
    return np.bitwise_or.reduce(low.reshape(n, -1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)


def differing(a: list[str], b: list[str]) -> Column:
    """How many nibbles differ: at most the Hamming distance of the symbols."""
    out = F.lit(0)
    for p, q in zip(a, b):
        x = F.col(p).bitwiseXOR(F.col(q))
        any_bit = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3))
        out = out + F.bit_count(any_bit.bitwiseAND(F.lit(0x1111111111111111)))
    return out


def candidate_pairs(reps: DataFrame, dims: int, radius: int, slack: int = 2) -> DataFrame:
    """(x, y), x < y: pairs of reps (rep, syms) that agree in a probed partition and whose symbols differ, as far as four bits of each
    tell, in at most radius + slack dimensions; holds all pairs within the Hamming radius."""
    spark = reps.sparkSession
    rows = reps.select("rep", "syms")
    symbols = lambda f: np.stack(f["syms"].to_numpy()).astype(np.int32).view(np.uint32)
    size = rows.count()
    single = H.Estimate(spark, H.count_sketch(rows, lambda f: single_signatures(symbols(f)).ravel(), H.sketch_bits(size * dims)))

    def hot(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros((dims, dims), np.int64), 0
        for f in H.batches(frames):
            h = (single(single_signatures(symbols(f))) > 8 + 4 * single.noise).astype(np.int64)
            total += h.T @ h
            n += len(f)
        yield pd.DataFrame({"i": np.arange(dims * dims + 1), "c": np.append(total.ravel(), n)})

    got = rows.mapInPandas(hot, "i int, c bigint").groupBy("i").agg(F.sum("c").alias("c")).toPandas()
    if not len(got):
        got = pd.DataFrame({"i": np.arange(dims * dims + 1), "c": 0})
    c = got.sort_values("i")["c"].to_numpy(np.int64)
    pairs = group_dimensions(c[:-1].reshape(dims, dims), int(c[-1]))
    both = H.Estimate(spark, H.count_sketch(rows, lambda f: pair_signatures(single_signatures(symbols(f)), pairs).ravel(), H.sketch_bits(size * dims // 2)))
    m = len(pairs)

    def all_signatures(f: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        s = single_signatures(symbols(f))
        sig = np.concatenate([pair_signatures(s, pairs), s[:, pairs[:, 0]], s[:, pairs[:, 1]]], axis=1)
        return sig, np.concatenate([both(sig[:, :m]), single(sig[:, m:])], axis=1)

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in H.batches(frames):
            sig, est = all_signatures(f)
            t = allocate(est[:, :m], est[:, m : 2 * m] + est[:, 2 * m :], radius + 1)
            use = np.concatenate([t == 0, t == 1, t == 1], axis=1)
            who = np.repeat(f["rep"].to_numpy(np.int64), use.sum(1))
            at, salt = H.spread(est[use], who, True)
            own = np.repeat(nibbles(symbols(f)), use.sum(1), axis=0)[at]
            yield pd.DataFrame({"sig": sig[use][at].view(np.int64), "salt": salt, "x": who[at], **dict(zip(xs, own.T))})

    longs = -(-dims // 16)
    xs, ys = [f"cx{i}" for i in range(longs)], [f"cy{i}" for i in range(longs)]
    probes = materialize(rows.mapInPandas(probe, f"sig bigint, salt int, x bigint, {', '.join(f'{c} bigint' for c in xs)}"), "probes")
    bits = H.filter_bits(probes.count())
    seen = spark.sparkContext.broadcast(H.bit_filter(probes, "sig", bits))

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in H.batches(frames):
            sig, est = all_signatures(f)
            who = np.repeat(f["rep"].to_numpy(np.int64), sig.shape[1])
            sig, est = sig.ravel(), est.ravel()
            ok = H.in_filter(seen.value, H.bucket_of(sig, bits))
            sig, est, who = sig[ok], est[ok], who[ok]
            at, salt = H.spread(est, who, False)
            own = np.repeat(nibbles(symbols(f)), 3 * m, axis=0)[ok][at]
            yield pd.DataFrame({"sig": sig[at].view(np.int64), "salt": salt, "y": who[at], **dict(zip(ys, own.T))})

    indexed = rows.mapInPandas(index, f"sig bigint, salt int, y bigint, {', '.join(f'{c} bigint' for c in ys)}")
    near = differing(xs, ys) <= radius + slack
    found = materialize(probes.join(indexed, ["sig", "salt"]).filter((F.col("x") < F.col("y")) & near).select("x", "y").distinct(), "candidates")
    discard(probes)
    return found


def near_duplicates(
    docs: DataFrame, key: str, text: str, order: str | None = None, similarity: float = 0.8, width: int = 5, min_words: int = 5, dims: int = 32, miss: float = 0.02
) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (x, y, similarity) between class representatives, members (k0, rep)."""

    def symbols(flat, h, at, seqs, counts):
        return {"syms": list(minhash(seqs, counts, dims).view(np.int32))}

    feats = materialize(texts.sequence_sets(docs, key, text, order, width, min_words, symbols, "syms array<int>"), "sets")
    reps, members = texts.classes(feats, ("seqs", "syms"))
    discard(feats)
    pairs = candidate_pairs(reps, dims, radius_for(similarity, dims, miss))
    n = pairs.count()
    a = H.keep_known(reps.select(F.col("rep").alias("x"), F.col("seqs").alias("sx")), "x", pairs, "x", n)
    b = H.keep_known(reps.select(F.col("rep").alias("y"), F.col("seqs").alias("sy")), "y", pairs, "y", n)
    shared = F.size(F.array_intersect("sx", "sy"))
    scored = pairs.join(a, "x").join(b, "y").select("x", "y", shared.alias("i"), (F.size("sx") + F.size("sy") - shared).alias("u"))
    links = scored.filter(F.col("i") >= F.lit(similarity) * F.col("u")).select("x", "y", (F.col("i") / F.col("u")).alias("similarity"))
    links = materialize(links, "links")
    discard(reps, pairs)
    return links, members


def components(links: DataFrame, members: DataFrame) -> DataFrame:
    """(k0, group_id, n_links): each key with the least representative it is connected to and the number of linked classes. Labels
    spread over links and jump to the label of their label, so the rounds grow with the logarithm of the longest chain."""
    nodes = members.select("rep").distinct()
    both = materialize(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))), "edges")
    label = materialize(nodes.select("rep", F.col("rep").alias("label")), "labels")
    while True:
        near = both.join(label, both["y"] == label["rep"]).groupBy("x").agg(F.min("label").alias("m"))
        step = label.join(near, label["rep"] == near["x"], "left").select("rep", "label", F.least("label", F.coalesce("m", "label")).alias("new"))
        step = materialize(step, "labels")
        up = step.select(F.col("rep").alias("new"), F.col("new").alias("top"))
        jumped = materialize(step.join(up, "new", "left").select("rep", "label", F.least("new", F.coalesce("top", "new")).alias("new")), "labels")
        moved = jumped.filter("new <> label").limit(1).count()
        label = jumped.select("rep", F.col("new").alias("label"))
        if not moved:
            break
    degree = both.groupBy(F.col("x").alias("rep")).agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(label, "rep").join(degree, "rep", "left").select("k0", F.col("label").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
