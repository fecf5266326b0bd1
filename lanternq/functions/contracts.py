"""Contracts of JSON records: the rules a record must meet, the defaults of what it may leave out, and the split into valid and quarantined.

A record is JSON text, parsed once to a variant; each rule looks at the kind of a path (the first word of the variant's schema) and, where it
has one, at its value. Text that is no object has the one error `Output is not a JSON object`; null text has it as well."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternq.functions import records as R
from lanternq.functions import text as X
from lanternq.functions import vocabulary as V
from lanternq.functions.text import col

NO_OBJECT = "Output is not a JSON object"
# Field names, allowed values and the wording of messages of agent outputs.
TEXT_FIELDS = (
    "original_query", "rewritten_query", "topic_group", "model_name", "router_mode", "base_model_name", "classifier_label", "classifier_confidence_bucket", "classifier_backend", "memory_mode",
    "reasoning", "final_answer",
)
LABEL_FIELDS = ("topic_group", "classifier_label")
BUCKETS = ("high", "low", "medium")
FLAGS = ("needs_human", "needs_llm_escalation", "policy_gap")
METRICS = ("latency_ms", "total_input_tokens", "total_output_tokens", "total_cost_usd")
NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def kind(v: Column, path: str) -> Column:
    """The kind of a path of a variant in capitals (STRING, OBJECT, VOID for a JSON null ...); null where the path is missing."""
    return F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant")), "^[A-Z]+", 0)


def text_at(v: Column, path: str) -> Column:
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, f"$.{path}", "string"))


def is_text_list(v: Column, path: str) -> Column:
    """Whether a path is a list with texts only; the empty list is one."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant")).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~_has_null(v, path), F.lit(False))


def _has_null(v: Column, path: str) -> Column:
    return F.coalesce(F.exists(F.try_variant_get(v, f"$.{path}", "array<string>"), lambda x: x.isNull()), F.lit(False))


def _number_rules(v: Column, path: str, wrong: str, outside: str) -> list[tuple[Column, str]]:
    k, x = kind(v, path), F.try_variant_get(v, f"$.{path}", "double")
    return [(k.isNotNull() & ~k.isin(*NUMBERS), wrong), (k.isin(*NUMBERS) & ~x.between(0.0, 1.0), outside)]


def output_rules(v: Column) -> list[tuple[Column, str | Column]]:
    """The rules of an agent's output in their order."""
    rules: list[tuple[Column, str | Column]] = [(~kind(v, "ticket_id").isin("STRING", "VOID"), "ticket_id must be a string when provided")]
    for f in TEXT_FIELDS:
        k = kind(v, f)
        rules += [(k.isNull(), f"Missing field: {f}"), (k != "STRING", f"Field {f} must be a string"), (X.is_blank(text_at(v, f)) & (k == "STRING"), f"Field {f} is empty")]
    for f in LABEL_FIELDS:
        rules.append((kind(v, f).isNotNull() & X.canonical_label(text_at(v, f)).isNull(), f"Field {f} is not in the allowed label set"))
    bucket, modes = ", ".join(f"'{b}'" for b in BUCKETS), ", ".join(f"'{m}'" for m in sorted(V.MEMORY_MODES))
    b = text_at(v, "classifier_confidence_bucket")
    rules.append(((b != "") & ~b.isin(*BUCKETS), f"classifier_confidence_bucket must be one of [{bucket}]"))
    rules.append((kind(v, "classifier_confidence").isNull(), "Missing field: classifier_confidence"))
    rules += _number_rules(v, "classifier_confidence", "classifier_confidence must be a number", "classifier_confidence must be between 0 and 1")
    rules.append((~text_at(v, "context_mode").isin(*V.MEMORY_MODES), f"context_mode must be one of [{modes}]"))
    known_mode = F.coalesce(text_at(v, "memory_mode").isin(*V.MEMORY_MODES), F.lit(False))
    rules.append(((kind(v, "memory_mode") != "VOID") & ~known_mode, f"memory_mode must be one of [{modes}] or None"))
    inside = kind(v, "classification") == "OBJECT"
    rules.append((kind(v, "classification") != "OBJECT", "classification must be an object"))
    rules.append((inside & kind(v, "classification.label").isNotNull() & X.canonical_label(text_at(v, "classification.label")).isNull(), "classification.label is not in the allowed label set"))
    either = "classification.confidence must be between 0 and 1"
    rules += [(inside & when, m) for when, m in _number_rules(v, "classification.confidence", either, either)]
    known_bucket = F.coalesce(text_at(v, "classification.confidence_bucket").isin(*BUCKETS), F.lit(False))
    rules.append((inside & kind(v, "classification.confidence_bucket").isNotNull() & ~known_bucket, f"classification.confidence_bucket must be one of [{bucket}]"))
    rules += [(kind(v, "resolution_steps").isNull(), "Missing field: resolution_steps"), (kind(v, "resolution_steps").isNotNull() & ~is_text_list(v, "resolution_steps"), "resolution_steps must be a list of strings")]
    flags = kind(v, "escalation_flags")
    rules += [(flags.isNull(), "Missing field: escalation_flags"), (flags != "OBJECT", "escalation_flags must be an object")]
    for f in FLAGS:
        k = kind(v, f"escalation_flags.{f}")
        rules += [((flags == "OBJECT") & k.isNull(), f"escalation_flags missing field: {f}"), (k != "BOOLEAN", f"escalation_flags field {f} must be a bool")]
    rules.append((kind(v, "escalation_flags.reasons").isNotNull() & ~is_text_list(v, "escalation_flags.reasons"), "escalation_flags.reasons must be a list of strings"))
    for f in ("kb_policy_ids", "kb_categories"):
        rules.append((kind(v, f).isNotNull() & ~is_text_list(v, f), f"{f} must be a list of strings"))
    odd = F.filter(F.try_variant_get(v, "$.kb_categories", "array<string>"), lambda c: (c != "") & ~c.isin(*V.LABELS))
    rules.append((is_text_list(v, "kb_categories") & (F.size(odd) > 0), F.array_join(F.transform(odd, lambda c: F.concat(F.lit("kb_categories contains non-canonical label: "), c)), "; ")))
    metrics = kind(v, "metrics")
    rules += [(metrics.isNull(), "Missing field: metrics"), (metrics != "OBJECT", "metrics must be an object")]
    for f in METRICS:
        k = kind(v, f"metrics.{f}")
        rules += [((metrics == "OBJECT") & k.isNull(), f"metrics missing field: {f}"), (~k.isin(*NUMBERS), f"metrics field {f} has wrong type")]
    rules.append((~kind(v, "escalation_model_name").isin("STRING", "VOID"), "escalation_model_name must be a string when provided"))
    return rules


def answer_rules(v: Column) -> list[tuple[Column, str | Column]]:
    """The rules of the short contract: reasoning, final_answer and predicted_category."""
    rules: list[tuple[Column, str | Column]] = []
    for f in ("reasoning", "final_answer", "predicted_category"):
        k = kind(v, f)
        rules += [(k.isNull(), f"Missing field: {f}"), (k != "STRING", f"Field {f} has wrong type"), (X.is_blank(text_at(v, f)) & (k == "STRING"), f"Field {f} is empty")]
    c = text_at(v, "predicted_category")
    rules.append((c.isNotNull() & X.canonical_label(c).isNull(), "Field predicted_category is not in the allowed label set"))
    return rules


def errors(json: Column | str, rules=output_rules) -> Column:
    """The errors of a record in the order of its rules, an empty list if it is valid."""
    checked = X.let(F.try_parse_json(F.when(R.is_object(json), col(json))), lambda v: R.messages(*rules(v)))
    return F.when(R.is_object(json), checked).otherwise(F.array(F.lit(NO_OBJECT)))


#: For a missing field, the paths that stand in for it, the first that is there, and else the text.
STAND_INS: tuple[tuple[str, tuple[str, ...], str], ...] = (
    ("rewritten_query", ("original_query",), '""'),
    ("topic_group", ("category", "classifier_label"), '""'),
    ("model_name", ("model_used",), '""'),
    ("router_mode", ("router_name",), '""'),
    ("base_model_name", ("model_name", "model_used"), '""'),
    ("escalation_model_name", (), "null"),
    ("classifier_label", ("classification.label", "topic_group", "category"), '""'),
    ("classifier_confidence", ("classification.confidence",), "0.0"),
    ("classifier_confidence_bucket", ("classification.confidence_bucket",), '"low"'),
    ("memory_mode", ("context_mode",), '"none"'),
    ("kb_policy_ids", (), "[]"),
    ("kb_categories", (), "[]"),
    ("metrics", (), '{"latency_ms": 0.0, "total_input_tokens": 0, "total_output_tokens": 0, "total_cost_usd": 0.0}'),
)


def with_defaults(json: Column | str) -> Column:
    """The record with its missing fields filled, labels that can be mapped in their canonical form, ticket_id as text, and all escalation
    flags with a list of reasons. Text that is no object stays as it is."""

    def fill(v: Column) -> Column:
        at = lambda p: F.try_variant_get(v, f"$.{p}", "variant")
        some = {f: F.coalesce(*(at(p) for p in (f, *paths)), F.parse_json(F.lit(default))) for f, paths, default in STAND_INS}
        ticket = F.coalesce(F.try_variant_get(v, "$.ticket_id", "string"), F.lit("")).cast("variant")
        for f in LABEL_FIELDS:
            given = F.when(F.schema_of_variant(some[f]) == "STRING", F.try_variant_get(some[f], "$", "string"))
            some[f] = F.coalesce(X.canonical_label(given).cast("variant"), some[f])
        is_flags = F.coalesce(kind(v, "escalation_flags") == "OBJECT", F.lit(False))
        flag = lambda f: F.coalesce(F.when(is_flags, at(f"escalation_flags.{f}")), F.parse_json(F.lit("false")))
        reasons = F.when(is_flags, F.coalesce(F.try_variant_get(v, "$.escalation_flags.reasons", "array<string>"), F.array_compact(F.array(F.try_variant_get(v, "$.escalation_flags.reasons", "string")))))
        flags = F.create_map(*(x for f in FLAGS for x in (F.lit(f), flag(f))), F.lit("reasons"), F.to_variant_object(F.coalesce(reasons, F.expr("cast(array() as array<string>)"))))
        made = F.create_map(F.lit("ticket_id"), ticket, F.lit("escalation_flags"), F.to_variant_object(flags), *(x for f, c in some.items() for x in (F.lit(f), c)))
        own = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, _: ~k.isin("ticket_id", "escalation_flags", *some))
        return F.to_json(F.map_concat(own, made))

    return F.when(R.is_object(json), X.let(F.try_parse_json(F.when(R.is_object(json), col(json))), fill)).otherwise(col(json))


def validated(df: DataFrame, json: str, rules=output_rules) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined): df with defaults filled into json and its list of errors."""
    out = df.withColumn(json, with_defaults(json)).withColumn("errors", errors(json, rules))
    return out.filter(F.size("errors") == 0), out.filter(F.size("errors") > 0)


def normal_output(text: Column | str, fallback: str = "No valid answer produced", fields: Sequence[str] = ("reasoning", "final_answer", "predicted_category")) -> Column:
    """A struct of a model's output, which is an object or holds one: trimmed reasoning and final answer, the category by its keywords in label and
    answer. Text without an object is the answer itself; an empty answer is the fallback."""

    def build(j: Column) -> Column:
        got = lambda f: X.strip(F.coalesce(F.get_json_object(j, f"$.{f}"), F.lit("")))
        answer = F.when(j.isNotNull(), got(fields[1])).otherwise(X.strip(F.coalesce(col(text), F.lit(""))))
        return F.struct(got(fields[0]).alias("reasoning"), X.first_non_empty(answer, F.lit(fallback)).alias("final_answer"), X.category(got(fields[2]), answer).alias("predicted_category"))

    return X.let(R.parsed_object(text), build)
