"""Problem 8: long exact spans shared between texts, by recompression.

Each text is rewritten in rounds, all texts by the same rules. In a round, maximal runs of one symbol become a symbol of their own; then
symbols are halved by a bit of their name (another one each round), and each pair of a left and a right symbol becomes one symbol.
The name of a new symbol is a 64-bit hash of what it stands for, so names agree globally without a shuffle. What becomes of
a symbol depends on its neighbours only: equal substrings are parsed alike but for a few symbols at both ends. Symbols stop growing
at `symbol_chars` characters. A chain is the shortest sequence of whole symbols of at least `chain_chars` characters; texts that
share a span of `span_chars` share a chain inside it.

Rare chains pair the texts that hold them, and the pairs are verified by extending the match in the texts. For chains that
many texts share (estimated by a sketch of all chains), each occurrence gives the hashes (128 bits) of all spans of exactly span_chars
that hold it, so that only texts that share such a span meet; none are dropped. Spans that stand in the same texts are one before
texts are paired, and the texts of hot spans are paired in parts.

Texts that are equal are one class. Lengths and places are in Unicode characters. Defined results: null and shorter texts share
nothing; equal texts of at least span_chars share all of their text; keys must be unique; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternq.llm import hashing as H
from lanternq.session import discard, materialize

ROUNDS = 18
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, H.U64(base))
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=H.U64)


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, end to end, and the length of each text."""
    n = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), n


def recompress(points: np.ndarray, lengths: np.ndarray, symbol_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, start, length, owner) of the final symbols; start counts from the start of all texts."""
    name = H.mix(points.astype(H.U64) + H.U64(1))
    start = np.arange(len(points), dtype=np.int64)
    length = np.ones(len(points), np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    for r in range(ROUNDS):
        if not len(name):
            break
        # runs
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(name)))
        fits = (times > 1) & (times * length[first] <= symbol_chars)
        if fits.any():
            keep = new | ~np.repeat(fits, times)
            f = first[fits]
            name[f] = H.mix(name[f] ^ H.mix(times[fits].astype(H.U64)))
            length[f] *= times[fits]
            name, start, length, owner = name[keep], start[keep], length[keep], owner[keep]
        # pairs
        right = ((H.mix(name ^ H.U64(0xD1B54A32D192ED03 + r)) >> H.U64(17)) & H.U64(1)).astype(bool)
        join = ~right[:-1] & right[1:] & (owner[:-1] == owner[1:]) & (length[:-1] + length[1:] <= symbol_chars)
        at = np.flatnonzero(join)
        if len(at):
            name[at] = H.mix(name[at] * H.U64(3) + H.mix(name[at + 1]))
            length[at] += length[at + 1]
            keep = np.ones(len(name), bool)
            keep[at + 1] = False
            name, start, length, owner = name[keep], start[keep], length[keep], owner[keep]
    return name, start, length, owner


def chains(name: np.ndarray, start: np.ndarray, length: np.ndarray, owner: np.ndarray, chain_chars: int) -> tuple[np.ndarray, ...]:
    """(signature, start, length, owner, last, step) of the chain from each symbol on. Chains equal to the one before (a symbol that
    repeats) are one: last is the start of the last of them and step the length of the symbol, else start and 0."""
    n = len(name)
    stop = np.searchsorted(start + length, start + chain_chars)
    ok = stop < n
    ok[ok] = owner[stop[ok]] == owner[ok]
    i = np.flatnonzero(ok)
    j = stop[i]
    sums = np.concatenate([np.zeros(1, H.U64), np.cumsum(name * _powers(BASE, n), dtype=H.U64)])
    sig = H.mix((sums[j + 1] - sums[i]) * _powers(BASE_INVERSE, n)[i])
    size = start[j] + length[j] - start[i]
    new = np.ones(len(i), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (owner[i][1:] != owner[i][:-1])
    first = np.flatnonzero(new)
    final = np.append(first[1:], len(i)) - 1
    last = start[i][final] if len(i) else start[:0]
    return sig[new], start[i][new], size[new], owner[i][new], last, np.where(final > first, length[i][new], 0)


def window_hashes(points: np.ndarray, starts: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hashes of the windows of `width` characters at the given places."""
    x = H.mix(points.astype(H.U64) * H.U64(seed) + H.U64(seed))
    sums = np.concatenate([np.zeros(1, H.U64), np.cumsum(x * _powers(BASE, len(x)), dtype=H.U64)])
    return H.mix((sums[starts + width] - sums[starts]) * _powers(BASE_INVERSE, len(x))[starts] + H.U64(5))


def common_run(a: str, b: str, i: int, j: int) -> tuple[int, int]:
    """Characters that agree to the left of a[i], b[j] and from there on."""
    n = 0
    while i + n < len(a) and j + n < len(b) and a[i + n : i + n + 64] == b[j + n : j + n + 64]:
        n += min(64, len(a) - i - n, len(b) - j - n)
    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
        n += 1
    m = 0
    while m < i and m < j and a[i - m - 1] == b[j - m - 1]:
        m += 1
    return m, n


def periodic_run(text: str, start: int, length: int, step: int) -> tuple[int, int]:
    """(start, length) of a stretch that repeats every `step` characters, drawn out as far as it goes on repeating."""
    stop = start + length
    while start > 0 and text[start - 1] == text[start - 1 + step]:
        start -= 1
    while stop < len(text) and text[stop] == text[stop - step]:
        stop += 1
    return start, stop - start


def shared_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", span_chars: int = 200, chain_chars: int = 80, symbol_chars: int = 24, hot: int = 48) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links, spans, members). links (x, y), x < y: classes that share a span of at least span_chars; spans (rep, start,
    length): places of shared spans, which may overlap; members (k0, rep, copies, n_chars)."""
    spark = docs.sparkSession

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            raw = [t.encode("utf-8", "surrogatepass") for t in f["t0"]]
            h = np.array([xxhash.xxh3_128_intdigest(r) for r in raw], object)
            yield f.assign(key1=np.array([int(v & (2**64 - 1)) for v in h], np.uint64).view(np.int64), key2=np.array([int(v >> 64) for v in h], np.uint64).view(np.int64))

    src = docs.filter(F.col(key).isNotNull() & (F.length(text) >= span_chars)).select(F.col(key).cast("bigint").alias("k0"), F.col(text).alias("t0"))
    keyed = src.mapInPandas(keys, "k0 bigint, t0 string, key1 bigint, key2 bigint")
    by = ["key1", "key2"]
    keyed = materialize(keyed, "keyed")
    reps = materialize(keyed.groupBy(*by).agg(F.min("k0").alias("rep"), F.first("t0").alias("t0"), F.countDistinct("k0").alias("copies")), "texts")
    members = materialize(keyed.select("k0", *by).distinct().join(reps.select(*by, "rep", "copies", F.length("t0").alias("n_chars")), by).drop(*by), "members")
    discard(keyed)
    rows = reps.select("rep", "t0")

    def signatures(f: pd.DataFrame) -> tuple:
        points, n = characters(f["t0"].tolist())
        return points, n, *chains(*recompress(points, n, symbol_chars), chain_chars)

    def all_signatures(f: pd.DataFrame) -> np.ndarray:
        parts = [signatures(g)[2] for g in H.batches([f], 200, "t0", 300_000)]
        return np.concatenate(parts) if parts else np.zeros(0, H.U64)

    chars = rows.agg(F.coalesce(F.sum(F.length("t0")), F.lit(0))).first()[0]
    est = H.Estimate(spark, H.count_sketch(rows, all_signatures, H.sketch_bits(chars // 8)))  # a symbol has about ten characters

    def occurrences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in H.batches(frames, 200, "t0", 300_000):
            points, n, sig, at, size, owner, last, step = signatures(f)
            base = np.cumsum(n) - n
            rep = f["rep"].to_numpy(np.int64)
            many = est(sig) > hot
            c = ~many
            yield pd.DataFrame({"sig": sig[c].view(np.int64), "more": 0, "rep": rep[owner[c]], "at": at[c] - base[owner[c]], "reach": last[c] - at[c] + size[c], "step": step[c], "whole": False})
            at, size, owner, last = at[many], size[many], owner[many], last[many]
            lo = np.maximum(at + size - span_chars, base[owner])
            hi = np.minimum(last, base[owner] + n[owner] - span_chars)
            times = np.maximum(hi - lo + 1, 0)
            starts = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(lo, times)
            starts, where = np.unique(starts, return_index=True)
            owner = np.repeat(owner, times)[where]
            if len(starts):
                h, g = window_hashes(points, starts, span_chars), window_hashes(points, starts, span_chars, 0x2545F491)
                yield pd.DataFrame({"sig": h.view(np.int64), "more": g.view(np.int64), "rep": rep[owner], "at": starts - base[owner], "reach": span_chars, "step": 0, "whole": True})

    found = materialize(rows.mapInPandas(occurrences, "sig bigint, more bigint, rep bigint, at bigint, reach bigint, step bigint, whole boolean"), "chains")
    same = ["sig", "more", "whole"]
    per = found.groupBy(*same).agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select(*same)
    shared = materialize(found.join(per, same, "left_semi"), "shared")
    discard(found)
    cold, spans = shared.filter("not whole"), shared.filter("whole")
    x = cold.select("sig", F.col("rep").alias("x"), F.col("at").alias("i"), F.col("reach").alias("ri"), "step")
    y = cold.select("sig", F.col("rep").alias("y"), F.col("at").alias("j"), F.col("reach").alias("rj"), F.col("step").alias("sj"))
    pairs = x.join(y, "sig").filter("x < y").groupBy("x", "y").agg(F.collect_list(F.struct("i", "j", "ri", "rj", F.greatest("step", "sj").alias("step"))).alias("places"))
    pairs = materialize(pairs, "pairs")
    n_pairs = pairs.count()
    left = H.keep_known(reps.select(F.col("rep").alias("x"), F.col("t0").alias("tx")), "x", pairs, "x", n_pairs)
    right = H.keep_known(reps.select(F.col("rep").alias("y"), F.col("t0").alias("ty")), "y", pairs, "y", n_pairs)
    with_text = pairs.join(left, "x").join(right, "y")

    def verify(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in H.batches(frames, 1000):
            out = []
            for x_, y_, places, a, b in zip(f["x"], f["y"], f["places"], f["tx"], f["ty"]):
                done: dict[int, int] = {}
                for i, j, ri, rj, step in sorted((p["i"], p["j"], p["ri"], p["rj"], p["step"]) for p in places):
                    if step:  # a text repeats one symbol here: a stretch that holds a span at every phase covers the other one's stretch
                        full = span_chars + step
                        pi, ni = periodic_run(a, i, ri, step)
                        pj, nj = periodic_run(b, j, rj, step)
                        out.append((x_, y_, pi, pj, ni if ni >= span_chars and nj >= full else 0, nj if nj >= span_chars and ni >= full else 0))
                    if done.get(i - j, -1) > i:
                        continue
                    left, right = common_run(a, b, i, j)
                    done[i - j] = i + right
                    if left + right >= span_chars:
                        out.append((x_, y_, i - left, j - left, left + right, left + right))
            yield pd.DataFrame(out, columns=["x", "y", "i", "j", "n", "m"])

    matched = materialize(with_text.select("x", "y", "places", "tx", "ty").mapInPandas(verify, "x bigint, y bigint, i bigint, j bigint, n bigint, m bigint"), "matched")
    discard(pairs, reps)
    links = matched.filter("n > 0 or m > 0").select("x", "y").unionByName(span_links(spans)).distinct()
    places = (
        matched.select(F.col("x").alias("rep"), F.col("i").alias("start"), F.col("n").alias("length"))
        .unionByName(matched.select(F.col("y").alias("rep"), F.col("j").alias("start"), F.col("m").alias("length")))
        .unionByName(spans.select("rep", F.col("at").alias("start"), F.lit(span_chars).cast("bigint").alias("length")))
        .unionByName(members.filter("copies > 1 and k0 = rep").select("rep", F.lit(0).cast("bigint").alias("start"), F.col("n_chars").cast("bigint").alias("length")))
        .filter("length > 0")
        .distinct()
    )
    return links, places, members


def span_links(spans: DataFrame, most: int = 4096) -> DataFrame:
    """(x, y), x < y: texts that share a span (sig, more). Of the spans that stand in the same texts, which two hashes of the set tell, one is
    paired; with p parts of its texts there are p * p tasks' worth of rows, so that no part holds more than about `most` of either side."""
    once = spans.select("sig", "more", "rep").distinct()
    sets = once.groupBy("sig", "more").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("rep")).alias("s1"), F.bit_xor(F.xxhash64(F.lit(3), "rep")).alias("s2"))
    chosen = sets.groupBy("n", "s1", "s2").agg(F.min(F.struct("sig", "more")).alias("w")).select("w.*", F.ceil(F.col("n") / most).alias("parts"))
    told = once.join(chosen, ["sig", "more"]).withColumn("own", F.pmod(F.xxhash64("rep"), "parts")).withColumn("other", F.explode(F.expr("sequence(0L, parts - 1)")))
    on = ["sig", "more", "p", "q"]
    a = told.select("sig", "more", F.col("own").alias("p"), F.col("other").alias("q"), F.col("rep").alias("x"))
    b = told.select("sig", "more", F.col("other").alias("p"), F.col("own").alias("q"), F.col("rep").alias("y"))
    return a.join(b, on).filter("x < y").select("x", "y")


def coverage(docs: DataFrame, key: str, places: DataFrame, members: DataFrame, text: str = "text") -> DataFrame:
    """(key, n_chars, shared_chars, shared_share, passages array<struct<start, length>>): one row for each text, with the
    passages that stand in other texts as well, merged where they overlap. n_chars and shared_share are null for null texts."""
    merged = places.groupBy("rep").agg(F.array_sort(F.collect_set(F.struct("start", F.expr("start + length").alias("stop")))).alias("s"))
    fold = """aggregate(s, cast(array() as array<struct<start:bigint,stop:bigint>>), (acc, v) ->
        case when size(acc) > 0 and element_at(acc, -1).stop >= v.start
        then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'stop', greatest(element_at(acc, -1).stop, v.stop))))
        else concat(acc, array(named_struct('start', v.start, 'stop', v.stop))) end)"""
    merged = merged.select("rep", F.expr(f"transform({fold}, v -> named_struct('start', v.start, 'length', v.stop - v.start))").alias("passages"))
    per = members.join(merged, "rep").select("k0", "passages")
    base = docs.select(F.col(key).alias("k0"), F.length(text).cast("bigint").alias("n_chars"))
    none = F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)")
    out = base.join(per, "k0", "left").withColumn("passages", F.coalesce("passages", none))
    total = F.expr("aggregate(passages, 0L, (t, v) -> t + v.length)")
    return out.select(F.col("k0").alias(key), "n_chars", total.alias("shared_chars"), F.round(F.try_divide(total, F.col("n_chars")), 6).alias("shared_share"), "passages")


def expand(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of members of linked classes and of one class."""
    a = members.select(F.col("k0").alias("a0"), F.col("rep").alias("x"))
    b = members.select(F.col("k0").alias("b0"), F.col("rep").alias("y"))
    across = links.join(a, "x").join(b, "y").select("a0", "b0")
    within = a.join(b, (F.col("x") == F.col("y")) & (F.col("a0") < F.col("b0"))).select("a0", "b0")
    return across.unionByName(within).select(F.least("a0", "b0").alias("id_a"), F.greatest("a0", "b0").alias("id_b"))
