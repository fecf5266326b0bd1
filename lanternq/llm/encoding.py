"""Problem 6: token ids of a whole corpus by a public byte-level tokenizer, with long texts cut into overlapping chunks.

Short texts are encoded where they lie. A text longer than a chunk is cut into chunks that overlap; each chunk is split into
pre-tokens on its own, in parallel. Where the pre-token starts of two neighbours coincide inside their overlap, both scanners go on
alike, so that place is a true boundary of the whole text: the text is cut there and the pieces are encoded in parallel.
Neighbours without such a place are joined to one piece, so the result is always that of the whole text.

Defined results: a null text and an empty text have no tokens, ids is the empty list for both; strings that look like special
tokens are ordinary text; other columns are ignored; rows that occur repeatedly come out once for each key.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternq.llm.hashing import batches

TOKENIZER_DIR = "/opt/tokenizers"
# Fixed value: the published pre-token pattern of the byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCANNER = regex.compile(PATTERN)


@functools.lru_cache(maxsize=4)
def load_encoding(name: str, folder: str):
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def decode_ids(ids: list[int], name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> str:
    """The text of a list of ids: their raw bytes one after another."""
    enc = load_encoding(name, folder)
    return b"".join(enc.decode_single_token_bytes(int(i)) for i in ids).decode("utf-8", "replace")


def pre_token_starts(text: str) -> list[int]:
    return [m.start() for m in SCANNER.finditer(text)]


def encode_corpus(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    name: str = "byte_bpe_50k",
    folder: str = TOKENIZER_DIR,
    chunk_chars: int = 16384,
    overlap_chars: int = 512,
    counts_only: bool = False,
) -> DataFrame:
    """(key, ids array<int>), or (key, n_tokens bigint) with counts_only. key must identify a text."""
    key_type = docs.schema[key].dataType.simpleString()
    out = "n_tokens bigint" if counts_only else "ids array<int>"
    src = docs.select(F.col(key).alias("k0"), F.col(text).alias("t0"))
    whole = F.coalesce(F.length("t0"), F.lit(0)) <= chunk_chars

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = load_encoding(name, folder)
        for f in batches(frames, 4000, "t0"):
            got = [enc.encode_ordinary(t) if t else [] for t in f["t0"]]
            rest = f.drop(columns="t0")
            yield rest.assign(**{"n_tokens": [len(x) for x in got]} if counts_only else {"ids": got})

    short = src.filter(whole).mapInPandas(encode, f"k0 {key_type}, {out}")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, t in zip(f["k0"], f["t0"]):
                n = -(-len(t) // chunk_chars)
                for lo in range(0, n, 64):
                    nos = range(lo, min(n, lo + 64))
                    yield pd.DataFrame({"k0": k, "no": nos, "piece": [t[i * chunk_chars : (i + 1) * chunk_chars + overlap_chars] for i in nos]})

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            starts = [pre_token_starts(p) for p in f["piece"]]
            yield f.assign(head=[[s for s in x if s <= overlap_chars] for x in starts], tail=[[s - chunk_chars for s in x if s >= chunk_chars] for x in starts])

    by_doc = Window.partitionBy("k0").orderBy("no")
    scanned = (
        src.filter(~whole)
        .mapInPandas(cut, f"k0 {key_type}, no int, piece string")
        .repartition("k0", "no")
        .mapInPandas(scan, f"k0 {key_type}, no int, piece string, head array<int>, tail array<int>")
    )
    stitched = (
        scanned.withColumn("cut", F.when(F.col("no") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", F.lag("tail").over(by_doc)))))
        .withColumn("next_cut", F.lead("cut").over(by_doc))
        .withColumn("last", F.lead("no").over(by_doc).isNull())
        .withColumn("run", F.count("cut").over(by_doc))
        .withColumn("start", F.coalesce("cut", F.lit(0)))
        .withColumn("stop", F.when(F.col("last"), F.length("piece")).otherwise(F.lit(chunk_chars) + F.coalesce("next_cut", F.lit(0))))
        .select("k0", "no", "run", F.expr("substring(piece, start + 1, stop - start)").alias("part"))
        .groupBy("k0", "run")
        .agg(F.expr("array_join(transform(array_sort(collect_list(struct(no, part))), x -> x.part), '')").alias("t0"))
    )
    pieces = stitched.mapInPandas(encode, f"k0 {key_type}, run bigint, {out}")
    if counts_only:
        long = pieces.groupBy("k0").agg(F.sum("n_tokens").alias("n_tokens"))
    else:
        long = pieces.groupBy("k0").agg(F.expr("flatten(transform(array_sort(collect_list(struct(run, ids))), x -> x.ids))").alias("ids"))
    return short.unionByName(long).withColumnRenamed("k0", key)
