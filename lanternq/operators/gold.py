"""Audit of a gold set: normalisation and review rules of nested resolutions, counts of exploded lists, summary and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternq.functions import text as X
from lanternq.functions.records import messages


def texts_of(c: Column) -> Column:
    """The trimmed texts of a list without the blank ones; null becomes the empty list."""
    return F.filter(F.transform(F.coalesce(c, F.expr("cast(array() as array<string>)")), lambda s: X.strip(s)), lambda s: s.isNotNull() & (s != ""))


def normal_resolution(r: str) -> Column:
    g = lambda f: F.col(f"{r}.{f}")
    t = lambda f: F.coalesce(X.strip(g(f)), F.lit(""))
    return F.struct(
        t("summary").alias("summary"), texts_of(g("steps")).alias("steps"), F.coalesce(g("escalation_required"), F.lit(False)).alias("escalation_required"),
        t("escalation_reason").alias("escalation_reason"), texts_of(g("kb_policies")).alias("kb_policies"), texts_of(g("acceptance_criteria")).alias("acceptance_criteria"),
    )


# Phrases of answers that do nothing.
EMPTY_PHRASES = ("i can't access your system", "i cannot access your system", "i can't log in to your system", "as an ai", "as a language model", "cannot perform actions")


def unwrapped(df: DataFrame, resolution: str, nested: str = "gold_resolution") -> DataFrame:
    """df whose resolution column is the one nested in it where there is one."""
    kind = df.schema[resolution].dataType
    return df.withColumn(resolution, F.col(f"{resolution}.{nested}")) if nested in getattr(kind, "names", ()) else df


def snippets(fused: Column | str, plain: Column | str) -> Column:
    """The fused list if there is one (an empty one counts), else the plain one, else none."""
    return F.coalesce(X.col(fused), X.col(plain), F.array())


def validation_reasons(r: str, retrieved: Column, steps: tuple[int, int] = (3, 8), criteria: int = 2) -> Column:
    """Reasons against a normalised resolution, in order: a missing or TODO summary, too few, too many or empty steps, few acceptance criteria, policies
    that are missing or weren't retrieved, an escalation without a reason, and phrases that do nothing. A null resolution has one reason."""
    g = lambda f: F.col(f"{r}.{f}")
    n, odd = F.size(g("steps")), F.array_sort(F.array_distinct(F.array_except(g("kb_policies"), retrieved)))
    outside = (n < steps[0]) | (n > steps[1])
    idle = F.exists(g("steps"), lambda s: ~X.is_actionable(F.lower(s), EMPTY_PHRASES))
    blob = F.lower(F.concat_ws(" ", g("summary"), F.array_join(g("steps"), " "), F.array_join(g("acceptance_criteria"), " ")))
    found = messages(
        ((g("summary") == "") | (F.lower(g("summary")) == "todo"), "summary_missing"),
        (outside, "steps_count_out_of_range"),
        (~outside & idle, "steps_not_actionable"),
        (F.size(g("acceptance_criteria")) < criteria, "empty_acceptance_criteria"),
        (F.size(g("kb_policies")) == 0, "kb_policies_missing"),
        (F.size(odd) > 0, F.concat(F.lit("kb_policy_not_retrieved:"), F.array_join(odd, ","))),
        (g("escalation_required") & (g("escalation_reason") == ""), "escalation_reason_missing"),
        (X.contains_any(blob, EMPTY_PHRASES), "non_actionable_fluff"),
    )
    return F.when(F.col(r).isNull(), F.array(F.lit("empty_resolution"))).otherwise(found)


def audit_text(one: DataFrame) -> DataFrame:
    """(line): the audit's row as lines `name: value`, in the order of its columns."""
    cells = F.array(*(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("n/a"))) for c in one.columns))
    return one.select(F.posexplode(cells).alias("pos", "line"))


def review_reasons(r: str, known_policies: Column, least_steps: int = 3, least_criteria: int = 1, least_summary: int = 8) -> Column:
    """Further reasons why a normalised resolution needs a look by a person, in order; validation_reasons has those that count against it."""
    g = lambda f: F.col(f"{r}.{f}")
    return messages(
        (F.length(g("summary")) < least_summary, "short_summary"),
        (F.size(g("steps")) < least_steps, "few_steps"),
        (F.size(g("acceptance_criteria")) < least_criteria, "no_acceptance_criteria"),
        (F.size(g("kb_policies")) == 0, "no_policies"),
        (F.size(F.array_except(g("kb_policies"), known_policies)) > 0, "unknown_policies"),
        (F.size(F.array_distinct(g("kb_policies"))) < F.size(g("kb_policies")), "repeated_policies"),
        (g("escalation_required") & (g("escalation_reason") == ""), "escalation_without_reason"),
        (~g("escalation_required") & (g("escalation_reason") != ""), "reason_without_escalation"),
    )


def list_counts(df: DataFrame, c: str, top: int | None = None) -> DataFrame:
    """(value, n) of an exploded list column; with top, the most frequent ones, ties by value."""
    out = df.select(F.explode(c).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), "value").limit(top)


def audit(gold: DataFrame, kb: DataFrame) -> DataFrame:
    """One row of totals, averages and percentages over (gold_resolution, needs_human_review), with the use of the articles of kb (id)."""
    r = "gold_resolution"
    none = F.lit(0)
    base = gold.agg(
        F.count(F.lit(1)).alias("total_records"), F.count_if(F.coalesce("needs_human_review", F.lit(False))).alias("review_queue"),
        F.round(F.avg(F.coalesce(F.size(f"{r}.steps"), none)), 6).alias("avg_steps"), F.round(F.avg(F.coalesce(F.size(f"{r}.acceptance_criteria"), none)), 6).alias("avg_criteria"),
        F.round(100 * F.avg(F.coalesce(F.col(f"{r}.escalation_required"), F.lit(False)).cast("int")), 6).alias("escalation_percent"),
        F.round(100 * F.avg((F.length(F.coalesce(X.strip(f"{r}.summary"), F.lit(""))) < 8).cast("int")), 6).alias("short_summary_percent"),
    )
    uses = list_counts(gold, f"{r}.kb_policies").agg(F.coalesce(F.sum("n"), none).alias("policy_refs"), F.count(F.lit(1)).alias("policies_used"), F.coalesce(F.max("n"), none).alias("top_n"))
    size = kb.agg(F.count(F.lit(1)).alias("kb_size"))
    one = base.join(F.broadcast(uses)).join(F.broadcast(size))  # single rows
    ratio = F.round(F.coalesce(F.try_divide("policies_used", "kb_size"), F.lit(0.0)), 6)
    return one.select("*", ratio.alias("unique_policy_ratio"), F.round(F.col("top_n") / F.greatest("policy_refs", F.lit(1)), 6).alias("top_policy_share")).drop("top_n")


def gate(checks: Sequence[tuple[Column, int]]) -> Column:
    """The code of the first check that fails (a null check fails), else 0."""
    return F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for ok, code in checks), F.lit(0))
