"""Composed retrieval: a registry of retrievers with one payload, index updates, cached vectors, and filters with a fallback."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanternq.functions import text as X
from lanternq.functions import vectors as V
from lanternq.operators import retrieval

#: name -> function (queries (q, text), corpus (doc, text), k) giving (q, doc, score, rk)
RETRIEVERS: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {}


def retriever(name: str) -> Callable:
    def put(f: Callable) -> Callable:
        RETRIEVERS[name] = f
        return f

    return put


@retriever("none")
def _none(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    kinds = dict(corpus.dtypes)
    return queries.limit(0).select("q", F.lit(None).cast(kinds["doc"]).alias("doc"), F.lit(0.0).alias("score"), F.lit(0).alias("rk"))


@retriever("rag_bm25")
def _bm25(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    return retrieval.bm25_top(queries, "q", "text", corpus, "doc", "text", k)


def letters(df: DataFrame) -> DataFrame:
    """The default encoder: (..., v), unit vectors of letter counts; texts without letters get none."""
    out = df.withColumn("v", V.letter_vector("text"))
    return out.withColumn("v", F.when(V.norm("v") > 0, F.col("v")))


#: The encoder of the dense mode, a function from (..., text) to (..., text, v); replace it to use another model's vectors.
ENCODER: list[Callable[[DataFrame], DataFrame]] = [letters]


@retriever("rag_dense")
def _dense(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """By cosine of the encoder's vectors; a corpus that has a column v is taken with its stored vectors."""
    q = ENCODER[0](queries.select("q", "text"))
    d = corpus.select("doc", "v") if "v" in corpus.columns else ENCODER[0](corpus.select("doc", "text"))
    return retrieval.dense_top(q, "q", "v", d, "doc", "v", k)


@retriever("lexical")
def _lexical(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """By the share of the query's words, among all documents."""
    s = retrieval.lexical_scores(queries, "q", "text", corpus, "doc", "text").withColumn("score", F.round("score", 6))
    return retrieval.top_k(s, "q", "score", "doc", k).select("q", "doc", "score", "rk")


@retriever("rag_hybrid")
def _hybrid(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    return retrieval.fuse(_bm25(queries, corpus, k), _dense(queries, corpus, k), corpus, k=k)


def retrieve(queries: DataFrame, corpus: DataFrame, mode: str, k: int = 3, known_ids: DataFrame | None = None) -> DataFrame:
    """(q, context, relevance, hits, cost_tokens), one row for each query; those without hits have an empty context and relevance 0. With known_ids
    (doc), hits outside it are dropped. An unknown mode retrieves nothing."""
    hits = RETRIEVERS.get(mode, _none)(queries, corpus, k)
    if known_ids is not None:
        hits = hits.join(known_ids.select("doc"), "doc", "left_semi").select("q", "doc", "score", "rk")
    best = retrieval.context_block(hits, corpus, mode, F.max("score").alias("relevance"), F.count(F.lit(1)).alias("hits"))
    out = queries.join(best, "q", "left").withColumn("context", F.coalesce("context", F.lit("")))
    return out.select("q", "context", F.coalesce("relevance", F.lit(0.0)).alias("relevance"), F.coalesce("hits", F.lit(0)).alias("hits"), (X.token_estimate("text") + X.token_estimate("context")).alias("cost_tokens"))


def append_documents(corpus: DataFrame, new: DataFrame, text: str, parts: int = 256) -> DataFrame:
    """The corpus (doc string, text) with new texts as `dynamic:n`, numbered on from the corpus's size by order of arrival (at: a number, date or
    time), equal ones by text. Texts are numbered in ranges of `at` of about equal size, and the counts of earlier ranges are added, so no task numbers
    them all. Statistics follow from the union."""
    rows = new.filter(~X.is_blank(text)).select("at", X.strip(text).alias("text"))
    bounds = rows.agg(F.percentile_approx("at", [i / parts for i in range(1, max(parts, 2))]).alias("bounds__"))
    rows = rows.join(F.broadcast(bounds)).withColumn("part__", F.coalesce(F.size(F.filter("bounds__", lambda b: b < F.col("at"))), F.lit(0))).drop("bounds__")  # nulls are in the first range; no bounds, one range
    counts = rows.groupBy("part__").agg(F.count(F.lit(1)).alias("n__"))
    before = F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # as many rows as parts
    inside = F.row_number().over(Window.partitionBy("part__").orderBy("at", "text"))
    numbered = rows.withColumn("rk__", inside).join(F.broadcast(counts.select("part__", before.alias("start__"))), "part__")
    size = corpus.agg(F.count(F.lit(1)).alias("size__"))
    named = F.concat(F.lit("dynamic:"), F.col("size__") + F.col("start__") + F.col("rk__") - 1)
    return corpus.select("doc", "text").unionByName(numbered.join(F.broadcast(size)).select(named.alias("doc"), "text"))


def with_query_fallback(queries: DataFrame, last_text: str) -> DataFrame:
    """Blank queries ask for the last stored text instead."""
    return queries.withColumn("text", F.when(X.is_blank("text"), F.lit(last_text)).otherwise(F.col("text")))


def cached_vectors(docs: DataFrame, encode: Callable[[DataFrame], DataFrame], path: str) -> DataFrame:
    """(doc, sha256, v): vectors of docs (doc, text) from a parquet cache keyed by the text's hash; only texts that it lacks are encoded and appended."""
    spark = docs.sparkSession
    keyed = docs.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    if "://" in path or Path(path).exists():
        known = spark.read.parquet(path)
        missing = keyed.join(known.select("sha256"), "sha256", "left_anti")
    else:
        missing = keyed
    if missing.limit(1).count():
        encode(missing.select("sha256", "text").dropDuplicates(["sha256"])).select("sha256", "v").write.mode("append").parquet(path)
    return keyed.join(spark.read.parquet(path), "sha256").select("doc", "sha256", "v")


def filter_or_all(df: DataFrame, condition: Column) -> DataFrame:
    """The rows that meet the condition; all rows if none does."""
    kept = df.filter(condition)
    return kept if kept.limit(1).count() else df


def first_prediction(classifier: str, model: str) -> Column:
    """The classifier's label where it is one, else the model's, else `unknown`."""
    return F.coalesce(X.non_empty(X.strip(classifier)), X.non_empty(X.strip(model)), F.lit("unknown"))


def first_policy(allowed: Column, fields: Sequence[str], skip: str = "dynamic:") -> Column:
    """The first field whose id isn't empty, doesn't start with `skip` and is allowed."""
    return F.coalesce(*(F.when(~X.is_blank(f) & ~F.startswith(f, F.lit(skip)) & F.array_contains(allowed, F.col(f)), F.col(f)) for f in fields))


def review_decision(reviewer_reasons: Column, annotator_reasons: Column) -> Column:
    """Which answer stands: the reviewer's if nothing is held against it, else the annotator's, else none."""
    return F.when(F.size(reviewer_reasons) == 0, "reviewer").when(F.size(annotator_reasons) == 0, "annotator").otherwise("failed")
