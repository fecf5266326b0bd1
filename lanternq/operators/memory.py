"""Order-dependent memories of message sequences as window queries: rarity, continuity, decay and the best or last messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternq.functions import text as X
from lanternq.operators.retrieval import top_k


def salience(messages: DataFrame, conv: str, turn: str, text: str, decay: float = 0.9) -> DataFrame:
    """(conv, turn, pos, text, score). A message is rare by the mean of 1 / (1 + earlier uses of each token), more so the more
    sentences it has and the less it repeats the message before, plus a length bonus, all decayed by its place. Empty messages
    are skipped and take no place; a message of white space takes a place, scores 0 and makes the next one start afresh."""
    m = messages.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(text).alias("text"))
    m = m.withColumn("pos", F.row_number().over(Window.partitionBy("conv").orderBy("turn"))).withColumn("t", F.transform(X.tokens("text"), F.lower))
    counts = m.select("conv", "pos", F.explode("t").alias("tok")).groupBy("conv", "pos", "tok").agg(F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy("conv", "tok").orderBy("pos")
    seen = counts.withColumn("before", F.coalesce(F.sum("c").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("again", (F.lag("pos").over(by) == F.col("pos") - 1).cast("int"))
    parts = seen.groupBy("conv", "pos").agg(F.sum(F.col("c") / (1.0 + F.col("before"))).alias("r"), F.sum(F.coalesce("again", F.lit(0))).alias("o"))
    n = F.size("t")
    marks = lambda c: F.length("text") - F.length(F.replace(F.col("text"), F.lit(c), F.lit("")))
    sentence = 1 + 0.15 * F.greatest(marks("."), marks("\n"), F.lit(1))
    score = (F.col("r") / n * sentence * (1 + (1 - F.col("o") / n) * 0.5) + F.least(n / 20.0, F.lit(2.0))) * F.pow(F.lit(decay), F.col("pos"))
    return m.join(parts, ["conv", "pos"], "left").select("conv", "turn", "pos", "text", F.coalesce(F.round(score, 6), F.lit(0.0)).alias("score"))


def best_messages(scored: DataFrame, k: int = 3, keep: int = 5) -> DataFrame:
    """(conv, context, relevance, n): the k best of the `keep` best messages, joined by lines; relevance is their mean by the best."""
    best = top_k(top_k(scored, "conv", "score", "pos", keep), "conv", "score", "pos", k)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "text"))), lambda s: X.strip(s["text"])), "\n")
    relevance = F.coalesce(F.try_divide(F.sum("score"), F.count(F.lit(1)) * F.max("score")), F.lit(0.0))
    return best.groupBy("conv").agg(joined.alias("context"), F.round(relevance, 6).alias("relevance"), F.count(F.lit(1)).alias("n"))


def last_messages(messages: DataFrame, conv: str, turn: str, n: int = 100) -> DataFrame:
    w = Window.partitionBy(conv).orderBy(F.col(turn).desc())
    return messages.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)
