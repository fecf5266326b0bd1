"""Rules over records: JSON parsing, contracts as lists of rules, triggers, and the helpers of per-record metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternq.functions import text as X
from lanternq.functions.text import col


def json_kind(c: Column | str) -> Column:
    """`object`, `array`, `scalar`, or null for what isn't JSON."""
    schema = F.schema_of_variant(F.try_parse_json(col(c)))
    return F.when(F.startswith(schema, F.lit("OBJECT")), "object").when(F.startswith(schema, F.lit("ARRAY")), "array").when(schema.isNotNull(), "scalar")


def is_object(c: Column | str) -> Column:
    return F.coalesce(json_kind(c) == "object", F.lit(False))


def fragment(c: Column | str) -> Column:
    """From the first `{` to the last `}`; null without both."""
    return X.non_empty(F.regexp_extract(col(c), r"(?s)(\{.*\})", 1))


def parsed_object(c: Column | str) -> Column:
    """The text if it is an object, else its fragment if that is one, else null."""
    return F.coalesce(F.when(is_object(c), col(c)), F.when(is_object(fragment(c)), fragment(c)))


def has_keys(c: Column | str, keys: Sequence[str]) -> Column:
    """1 if the text is an object with all keys, else 0."""
    found = F.json_object_keys(F.when(is_object(c), col(c)))
    return F.coalesce(F.size(F.array_intersect(found, F.array(*(F.lit(k) for k in keys)))) == len(keys), F.lit(False)).cast("int")


def messages(*rules: tuple[Column, str | Column]) -> Column:
    """The messages of the rules that hold, in order; a rule that is null doesn't hold."""
    made = (F.when(when, F.lit(m) if isinstance(m, str) else m) for when, m in rules)
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def text_field_rules(fields: dict[str, Column]) -> list[tuple[Column, str]]:
    """Missing and empty rules of required text fields."""
    out: list[tuple[Column, str]] = []
    for name, c in fields.items():
        out += [(c.isNull(), f"Missing field: {name}"), (c.isNotNull() & X.is_blank(c), f"Field {name} is empty")]
    return out


def label_rule(name: str, c: Column) -> tuple[Column, str]:
    return c.isNotNull() & X.canonical_label(c).isNull(), f"Field {name} is not in the allowed label set"


def range_rule(name: str, c: Column, low: float, high: float) -> tuple[Column, str]:
    return c.isNull() | F.isnan(c) | (c < low) | (c > high), f"{name} must be between {low:g} and {high:g}"


def triggers(rules: dict[str, Column], none: str, joined_by: str = " + ") -> Column:
    """The names of the rules that hold, joined, or `none`."""
    return F.coalesce(X.non_empty(F.array_join(messages(*((c, n) for n, c in rules.items())), joined_by)), F.lit(none))


def band(c: Column, edges: Sequence[tuple[float, str]], below: str) -> Column:
    """The name of the first edge (in descending order) that the value reaches, else `below`; null stays null."""
    out = F.lit(below)
    for low, name in sorted(edges):
        out = F.when(c >= low, F.lit(name)).otherwise(out)
    return F.when(c.isNotNull(), out)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def number(c: Column | str) -> Column:
    """The value as a double: NaN, and text that is no number, are null."""
    d = col(c).try_cast("double")
    return F.when(~F.isnan(d), d)


def rate_value(c: Column | str) -> Column:
    """0 or 1 of booleans and their names, else the number."""
    s = col(c).cast("string")
    return F.coalesce(s.try_cast("boolean").cast("int").cast("double"), number(s))


def overlap_share(a: Column, b: Column) -> Column:
    """The share of the distinct tokens of b that are in a; 0 if b has none."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(b))), F.lit(0.0))


def best_support(answer: Column, snippets: Column) -> Column:
    """The best overlap_share of an answer with an array of snippets: lower-cased white-space tokens; 0 without snippets."""
    best = lambda a: F.array_max(F.transform(snippets, lambda s: overlap_share(a, X.tokens(F.lower(s)))))
    return F.coalesce(X.let(X.tokens(F.lower(answer)), best), F.lit(0.0))


def top_mean(scores: Column, k: int = 3) -> Column:
    """Mean of the k largest of an array of cosines mapped to [0, 1]; 0 for none."""
    top = F.slice(F.sort_array(F.transform(scores, lambda s: (clamp(s, -1.0, 1.0) + 1) / 2), asc=False), 1, k)
    return F.coalesce(F.try_divide(F.aggregate(top, F.lit(0.0), lambda x, y: x + y), F.size(top)), F.lit(0.0))


def exact_match(predicted: Column, gold: Column) -> Column:
    """1 where both labels agree after canonicalisation and the prediction is neither blank, unknown nor other."""
    p, g = X.label_or_text(predicted), X.label_or_text(gold)
    return F.coalesce((p == g) & (p != "") & ~p.isin("unknown", "other"), F.lit(False)).cast("double")
