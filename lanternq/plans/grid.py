"""Experiment grids: the product of dimensions and records, scored in batches, with per-record metrics."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternq.functions import records as R
from lanternq.functions import text as X


def cells(df: DataFrame, dimensions: dict[str, Sequence[str]]) -> DataFrame:
    """Each row once for every combination of the dimensions' values; the product is made row by row, without a join."""
    out = df
    for name, values in dimensions.items():
        out = out.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    return out


def run(df: DataFrame, dimensions: dict[str, Sequence[str]], scorer: Callable[[list[str]], list[str]], text: str) -> DataFrame:
    """The grid with the scorer's `output` for the prompt of each cell; a scorer that raises fails the job."""
    from lanternq.operators.classify import score_in_batches

    g = cells(df, dimensions)
    prompt = X.prompt(F.concat(F.lit("Ticket:\n"), X.strip(text)), *(F.concat(F.lit(f"{d}: "), F.col(d)) for d in dimensions))
    return score_in_batches(g.withColumn("prompt", prompt), scorer, "prompt", "output")


def metrics(df: DataFrame, output: str, gold: str, predicted: str, snippets: str, attached: str) -> DataFrame:
    """df with accuracy, groundedness and schema_validity of each record."""
    answer = F.coalesce(F.get_json_object(F.when(R.is_object(output), F.col(output)), "$.final_answer"), F.col(output))
    grounded = F.when(F.coalesce(F.col(attached), F.lit(False)), R.best_support(answer, F.col(snippets))).otherwise(F.lit(0.0))
    return df.select(
        "*", R.exact_match(F.col(predicted), F.col(gold)).alias("accuracy"), F.round(grounded, 6).alias("groundedness"), R.has_keys(output, ("final_answer", "reasoning")).alias("schema_validity")
    )
