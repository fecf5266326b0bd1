"""Problem 2: texts of other splits that lie wholly or almost wholly in a text of the training split, by similarity-hash fingerprints.

A fingerprint of a whole text cannot show that it lies in a longer one, so each sequence of five words gets a 64-bit similarity hash:
every word votes with the bits of its own hash, the longer the word the more, and the majority decides. Sequences that differ by a small
word have codes that differ in a few bits, sequences of the same words have the same code. Codes are cut into two blocks of 32 bits:
codes within a Hamming radius of 1 agree in one of them, so blocks of other splits meet blocks of the training split.

A text with n distinct sequences of which at least the share c must be found can lack n - ceil(c * n) of them, so of any n - ceil(c * n) + 1
sequences at least one is in the training text, with its code: no pair is lost by probing only the rarest ones, by a sketch of the
training codes. Hot blocks are spread over parts of both sides. The radius adds candidates whose sequences differ by a small word.
Candidates are verified by their exact sets.

Texts with equal sets are one class. Defined results: null keys, texts or splits, and texts with fewer than min_words words,
overlap with nothing; a key that occurs repeatedly counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternq.llm import hashing as H
from lanternq.llm import texts
from lanternq.session import discard, materialize

BLOCKS, BLOCK_BITS = 2, 32


# The weight of a word of no to seven and more characters.
VOTES = np.array([0, 1, 1, 1, 5, 7, 8, 9], np.int16)


def similarity_codes(flat: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The similarity hash of the `width` words from each place on; flat holds word hashes whose lowest bits are the word's length. Other
    hashes make the weights of words and of their bits uneven, so that few ties between long words are left to a small one."""
    out = np.empty(len(at), H.U64)
    sign, more = (np.unpackbits(H.mix(flat ^ H.U64(c)).view(np.uint8).reshape(-1, 8), axis=1).view(np.int8) for c in (0, 0x5DEECE66D))
    weight = VOTES[(flat & H.U64(7)).astype(np.int64)] * (16 + (flat >> H.U64(3) & H.U64(31)).astype(np.int16))
    bits = (sign * 2 - 1) * (2 + more) * weight[:, None]
    for i in range(0, len(at), 50_000):
        sums = bits[at[i : i + 50_000]]
        for k in range(1, width):
            sums += bits[at[i : i + 50_000] + k]
        out[i : i + 50_000] = np.packbits(sums > 0, axis=1).view(H.U64).ravel()
    return out


def block_keys(codes: np.ndarray) -> np.ndarray:
    """(codes x BLOCKS) keys: the number of the block and its bits."""
    parts = codes[:, None] >> (np.arange(BLOCKS, dtype=H.U64) * H.U64(BLOCK_BITS))
    return H.mix((parts & H.U64((1 << BLOCK_BITS) - 1)) | (np.arange(BLOCKS, dtype=H.U64) << H.U64(BLOCK_BITS)))


def contained_pairs(
    docs: DataFrame, key: str, text: str, split: str, train: str = "train", order: str | None = None, share: float = 0.7, width: int = 5, min_words: int = 30, radius: int = 1
) -> tuple[DataFrame, DataFrame]:
    """(links, members). links (x, y, share): class x of another split lies in class y of the training split by that share of its
    sequences; x = y for equal sets. members (k0, rep, is_train)."""
    if radius >= BLOCKS:
        raise ValueError("the radius must be below the number of blocks")
    spark = docs.sparkSession
    per_mille = round(share * 1000)

    def codes(flat, h, at, seqs, counts):
        c = similarity_codes(flat, at, width)
        known, where = np.unique(h.view(np.int64), return_index=True)
        return {"codes": H.split(c[where][np.searchsorted(known, seqs)].view(np.int64), counts)}

    src = docs.filter(F.col(split).isNotNull()).withColumn("is_train", F.col(split) == F.lit(train))
    feats = materialize(texts.sequence_sets(src, key, text, order, width, min_words, codes, "codes array<bigint>", ("is_train",)), "codes")
    reps, members = texts.classes(feats, ("seqs", "codes"), (F.max("is_train").alias("has_train"), F.max(~F.col("is_train")).alias("has_other")))
    sides = materialize(feats.groupBy("k0").agg(F.min_by("is_train", "o0").alias("is_train")).join(members, "k0"), "sides")
    discard(feats, members)
    trained = reps.filter("has_train").select("rep", "codes")
    flat_codes = lambda f: np.concatenate(f["codes"].to_numpy()).astype(np.int64).view(H.U64) if len(f) else np.zeros(0, H.U64)
    size = trained.agg(F.coalesce(F.sum(F.size("codes")), F.lit(0))).first()[0] * BLOCKS
    est = H.Estimate(spark, H.count_sketch(trained, lambda f: block_keys(flat_codes(f)).ravel(), H.sketch_bits(size)))

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in H.batches(frames, 2000):
            c, n = flat_codes(f), f["codes"].map(len).to_numpy(np.int64)
            owner = np.repeat(np.arange(len(n)), n)
            keys = block_keys(c)
            e = est(keys)
            order_ = np.lexsort((c, e.max(axis=1), owner))
            rank = np.arange(len(c)) - np.repeat(np.cumsum(n) - n, n)
            need = n - -(-n * per_mille // 1000) + 1
            use = order_[rank < np.repeat(need, n)]
            who = np.repeat(f["rep"].to_numpy(np.int64)[owner[use]], BLOCKS)
            sig, code = keys[use].ravel(), np.repeat(c[use], BLOCKS)
            at, salt = H.spread(e[use].ravel(), who, True)
            yield pd.DataFrame({"sig": sig[at].view(np.int64), "salt": salt, "cx": code[at].view(np.int64), "x": who[at]})

    probes = materialize(reps.filter("has_other").select("rep", "codes").mapInPandas(probe, "sig bigint, salt int, cx bigint, x bigint"), "probes")
    bits = H.filter_bits(probes.count())
    seen = spark.sparkContext.broadcast(H.bit_filter(probes, "sig", bits))

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in H.batches(frames, 2000):
            c = flat_codes(f)
            keys = block_keys(c).ravel()
            ok = H.in_filter(seen.value, H.bucket_of(keys, bits))
            who = np.repeat(f["rep"].to_numpy(np.int64), f["codes"].map(len).to_numpy(np.int64) * BLOCKS)[ok]
            keys, c = keys[ok], np.repeat(c, BLOCKS)[ok]
            at, salt = H.spread(est(keys), who, False)
            yield pd.DataFrame({"sig": keys[at].view(np.int64), "salt": salt, "cy": c[at].view(np.int64), "y": who[at]})

    indexed = trained.mapInPandas(index, "sig bigint, salt int, cy bigint, y bigint")
    near = F.bit_count(F.col("cx").bitwiseXOR(F.col("cy"))) <= radius
    pairs = materialize(probes.join(indexed, ["sig", "salt"]).filter(near & (F.col("x") != F.col("y"))).select("x", "y").distinct(), "candidates")
    discard(probes)
    n = pairs.count()
    a = H.keep_known(reps.select(F.col("rep").alias("x"), F.col("seqs").alias("sx")), "x", pairs, "x", n)
    b = H.keep_known(reps.select(F.col("rep").alias("y"), F.col("seqs").alias("sy")), "y", pairs, "y", n)
    scored = pairs.join(a, "x").join(b, "y").select("x", "y", F.size(F.array_intersect("sx", "sy")).alias("i"), F.size("sx").alias("n"))
    across = scored.filter(F.col("i") * 1000 >= F.col("n") * per_mille).select("x", "y", (F.col("i") / F.col("n")).alias("share"))
    same = reps.filter("has_train and has_other").select(F.col("rep").alias("x"), F.col("rep").alias("y"), F.lit(1.0).alias("share"))
    links = materialize(across.unionByName(same), "overlaps")
    discard(reps, pairs)
    return links, sides


def pair_counts(links: DataFrame, sides: DataFrame) -> DataFrame:
    """(other_key, pairs): for each key of another split that lies in training texts, in how many; members of classes are counted, not paired."""
    train = sides.filter("is_train").groupBy(F.col("rep").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    per = links.join(train, "y").groupBy("x").agg(F.sum("n").alias("pairs"))
    return sides.filter("not is_train").select(F.col("k0").alias("other_key"), F.col("rep").alias("x")).join(per, "x").select("other_key", "pairs")


def expand(links: DataFrame, sides: DataFrame) -> DataFrame:
    """(other_key, train_key, share) of all members."""
    other = sides.filter("not is_train").select(F.col("k0").alias("other_key"), F.col("rep").alias("x"))
    train = sides.filter("is_train").select(F.col("k0").alias("train_key"), F.col("rep").alias("y"))
    return links.join(other, "x").join(train, "y").select("other_key", "train_key", "share")
