"""Word, sequence and symbol hashing in numpy batches, and bounded sketches of signature counts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile("[a-z0-9]+")
U64 = np.uint64
GOLD = U64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    x = x.astype(U64, copy=True)
    x += GOLD
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class WordHasher:
    """64-bit hashes of words, remembered while a task runs (the memory is emptied when it holds a million words). The lowest three
    bits are the word's length, at most 7."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, words: list[str]) -> list[int]:
        known = self.known
        if len(known) > 1_000_000:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) & ~7 | min(len(w), 7)
            out.append(h)
        return out


def word_arrays(texts: list[str | None], hasher: WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the lower-cased texts, end to end, and the number of words of each text."""
    flat: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            w = WORD.findall(t.lower())
            counts[i] = len(w)
            flat.extend(hasher(w))
    return np.array(flat, dtype=U64), counts


def sequences(flat: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each run of `width` words, the index of its text, and the place of its first word in flat."""
    ends = np.cumsum(counts)
    starts = ends - counts
    per = np.maximum(counts - width + 1, 0)
    owner = np.repeat(np.arange(len(counts)), per)
    total = int(per.sum())
    at = np.arange(total) - np.repeat(np.cumsum(per) - per, per) + np.repeat(starts, per)
    h = np.zeros(total, U64)
    for k in range(width):
        h = mix(h ^ (flat[at + k] + U64(k)))
    return h, owner, at


def distinct_by_owner(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each owner in ascending signed order, end to end, and their number per owner."""
    s = h.view(np.int64)
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[keep], owner[keep]
    return s, np.bincount(owner, minlength=n).astype(np.int64)


def segment_reduce(ufunc: np.ufunc, values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """ufunc over consecutive segments, all of which must hold at least one value."""
    return ufunc.reduceat(values, np.cumsum(counts) - counts)


def split(values: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return np.split(values, np.cumsum(counts)[:-1]) if len(counts) else []


def bucket_of(signature: np.ndarray, bits: int) -> np.ndarray:
    return (mix(signature.view(U64)) >> U64(64 - bits)).astype(np.int64)


def sketch_bits(expected: int, least: int = 16, most: int = 24) -> int:
    """Buckets, as a power of two, for so many signatures: about one for every two of them, at most 2**most (64 MB of counts)."""
    return int(min(max((max(expected, 1) // 2).bit_length(), least), most))


def count_sketch(df: DataFrame, signatures: Callable[[pd.DataFrame], np.ndarray], bits: int = 20) -> np.ndarray:
    """Counts per bucket of the signatures of all rows, as an array of 2**bits numbers. Each task counts its own rows in numpy and gives
    its counts as packed blocks of bytes, which are added up block by block; 2**bits sums reach the driver, whatever the size of the data."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen = np.zeros(1 << bits, np.uint32), False
        for f in batches(frames):
            total += np.bincount(bucket_of(signatures(f), bits), minlength=1 << bits).astype(np.uint32)
            seen = True
        if seen:
            yield from _blocks(total)

    return _gather(df.mapInPandas(count, _BLOCK), np.zeros(1 << bits, np.uint32), _add).astype(np.int64)


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums that stay at the largest number instead of running over."""
    return np.minimum(a.astype(U64) + b, U64(2**32 - 1)).astype(np.uint32)


_BLOCK = "block int, data binary"
_BLOCK_BYTES = 1 << 18


def _blocks(whole: np.ndarray) -> Iterator[pd.DataFrame]:
    size = _BLOCK_BYTES // whole.itemsize
    for i in range(0, len(whole), size):
        if whole[i : i + size].any():
            yield pd.DataFrame({"block": [i // size], "data": [zlib.compress(whole[i : i + size].tobytes(), 1)]})


def _gather(parts: DataFrame, out: np.ndarray, join: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The blocks of all tasks combined by join on the executors, as one array on the driver."""
    kind = out.dtype

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for f in frames:
            for k, data in zip(f["block"], f["data"]):
                x = np.frombuffer(zlib.decompress(data), kind)
                sums[k] = join(sums[k], x) if k in sums else x
        for k, x in sums.items():
            yield pd.DataFrame({"block": [k], "data": [zlib.compress(x.tobytes(), 1)]})

    size = _BLOCK_BYTES // out.itemsize
    for r in parts.repartition(max(1, min(16, len(out) // size)), "block").mapInPandas(merge, _BLOCK).collect():
        x = np.frombuffer(zlib.decompress(bytes(r["data"])), kind)
        out[r["block"] * size : r["block"] * size + len(x)] = x
    return out


class Estimate:
    """Estimated counts of signatures from a sketch: the bucket's count less the mean of the others, at least 1."""

    def __init__(self, spark, sketch: np.ndarray) -> None:
        self.bits = len(sketch).bit_length() - 1
        self.noise = float(sketch.mean())
        self.shared = spark.sparkContext.broadcast(np.minimum(sketch, 2**31 - 1).astype(np.int32))

    def __call__(self, signature: np.ndarray) -> np.ndarray:
        return np.maximum(self.shared.value[bucket_of(signature, self.bits)] - self.noise, 1.0)


def salts(estimate: np.ndarray, most: int = 4096) -> np.ndarray:
    """Into how many parts the rows of a signature are spread, so that no part is expected to hold more than `most`."""
    return np.ceil(estimate / most).astype(np.int64)


def spread(estimate: np.ndarray, who: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(index, salt): the parts that rows of hot signatures go to. With p parts of a side there are p * p of them; a probe stays in its
    part of the probes and meets all parts of the index, and the other way round, so that no part holds many rows of either side."""
    parts = salts(estimate)
    own = (mix(who.view(U64)) % parts.astype(U64)).astype(np.int64)
    at = np.repeat(np.arange(len(parts)), parts)
    other = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    return at, (own[at] * parts[at] + other if probe else other * parts[at] + own[at]).astype(np.int32)


def filter_bits(expected: int) -> int:
    """Bits, as a power of two, of a filter for so many entries: about sixteen each, at most 2**29 (64 MB)."""
    return int(min(max((max(expected, 1) * 16).bit_length(), 18), 29))


def bit_filter(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """One bit for each bucket of the column's values, as 2**bits / 64 words: a filter without false negatives and of bounded
    size (2**bits / 8 bytes), combined by OR on the executors."""

    def mark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, seen = np.zeros(1 << (bits - 6), U64), False
        for f in frames:
            b = np.unique(bucket_of(f[column].to_numpy(np.int64), bits))
            np.bitwise_or.at(words, b >> 6, U64(1) << (b & 63).astype(U64))
            seen = True
        if seen:
            yield from _blocks(words)

    return _gather(rows.select(column).mapInPandas(mark, _BLOCK), np.zeros(1 << (bits - 6), U64), np.bitwise_or)


def keep_known(df: DataFrame, column: str, known: DataFrame, name: str, expected: int) -> DataFrame:
    """Rows of df whose column occurs in known[name], and a few others: a filter that spares the shuffle of wide rows before a join."""
    bits = filter_bits(expected)
    shared = df.sparkSession.sparkContext.broadcast(bit_filter(known, name, bits))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[in_filter(shared.value, bucket_of(f[column].to_numpy(np.int64), bits))]

    return df.mapInPandas(work, df.schema)


def in_filter(words: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return ((words[bucket >> 6].view(U64) >> (bucket & 63).astype(U64)) & U64(1)).astype(bool)


def first_by(df: DataFrame, key: str, value: Column, order: Column, name: str) -> DataFrame:
    """For each key the value of the row that comes first in order."""
    return df.groupBy(key).agg(F.min_by(value, order).alias(name))


def batches(frames: Iterator[pd.DataFrame], size: int = 4000, text: str | None = None, chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """The same rows in frames of at most `size` rows and, with a text column, of about `chars` characters (a longer text is alone), so that
    numpy work stays small whatever the length of texts."""
    for f in frames:
        upto = f[text].str.len().fillna(0).to_numpy(np.int64).cumsum() if text else None
        i = 0
        while i < len(f):
            j = min(i + size, len(f))
            if upto is not None:
                j = min(j, max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + chars, side="right"))))
            yield f.iloc[i:j]
            i = j
