"""String functions as Column builders; all stay inside code generation, none is a Python UDF. Null stays null unless said."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternq.functions import vocabulary as V

#: White space as Python's strip() and split() see it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once per row, however often body uses it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def is_blank(c: Column | str) -> Column:
    """True for null, empty and white-space texts."""
    return F.coalesce(strip(c), F.lit("")) == ""


def non_empty(c: Column | str) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(col(c), F.lit(""))


def first_non_empty(*cs: Column | str) -> Column:
    return F.coalesce(*(non_empty(c) for c in cs), F.lit(""))


def tokens(c: Column | str) -> Column:
    """White-space separated tokens; the empty text and null have none."""
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), f"{SPACE}+"), lambda x: x != "")


def words(c: Column | str) -> Column:
    """Runs of ASCII letters, digits and underscores, lower-cased after they are cut."""
    return F.transform(F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower)


def squeeze(c: Column | str) -> Column:
    """Lower case, `_` as a space, single spaces, trimmed."""
    return F.array_join(tokens(F.regexp_replace(F.lower(col(c)), "_", " ")), " ")


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def contains_any(c: Column, words_: Sequence[str]) -> Column:
    hit = F.lit(False)
    for w in words_:
        hit = hit | F.contains(c, F.lit(w))
    return hit


def first_group(c: Column, groups: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The name of the first group with a word in the text, else null."""
    return let(c, lambda t: F.coalesce(*(F.when(contains_any(t, ws), F.lit(name)) for name, ws in groups)))


def canonical_label(c: Column | str) -> Column:
    """One of the labels: exact synonym, exact label, else the first synonym in order that the text contains; null if none."""
    pairs: dict[str, str] = dict(V.SYNONYMS)
    for label in V.LABELS:
        pairs.setdefault(label.lower(), label)
    table = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))

    def find(norm: Column) -> Column:
        inside = F.coalesce(*(F.when(F.contains(norm, F.lit(k)), F.lit(v)) for k, v in V.SYNONYMS))
        return F.when(norm != "", F.coalesce(F.try_element_at(table, norm), inside))

    return let(squeeze(c), find)


def strict_label(c: Column | str) -> Column:
    """canonical_label, raising for what it can't map."""
    return F.coalesce(canonical_label(c), F.raise_error(F.concat(F.lit("unexpected label: "), F.coalesce(col(c), F.lit("null")))))


def label_or_fallback(c: Column | str) -> Column:
    return F.coalesce(canonical_label(c), F.lit(V.FALLBACK))


def label_or_text(c: Column | str) -> Column:
    return F.coalesce(canonical_label(c), strip(c))


def category(label: Column | str, context: Column | str) -> Column:
    """Category of a raw label with its context: keyword groups over both, then the label alone, else the fallback."""
    text = strip(F.regexp_replace(F.lower(F.coalesce(col(label), F.lit(""))), r"[^a-z0-9\s_-]", " "))
    both = strip(F.concat_ws(" ", text, F.lower(F.coalesce(col(context), F.lit("")))))
    return F.coalesce(first_group(both, V.CATEGORY_GROUPS), canonical_label(text), F.lit(V.FALLBACK))


def category_of_text(c: Column | str) -> Column:
    return F.coalesce(first_group(F.lower(F.coalesce(col(c), F.lit(""))), V.TEXT_GROUPS), F.lit(V.FALLBACK))


def short_category(c: Column | str, default: str = "miscellaneous") -> Column:
    return F.coalesce(first_group(F.lower(F.coalesce(col(c), F.lit(""))), V.SHORT_GROUPS), F.lit(default))


def mode(c: Column | str) -> Column:
    """Trimmed lower case; null and blank become `unknown`."""
    return F.coalesce(non_empty(F.lower(strip(c))), F.lit("unknown"))


def current_mode(c: Column | str) -> Column:
    """mode with older names replaced."""
    m = mode(c)
    out = m
    for old, new in V.LEGACY_MODES.items():
        out = F.when(m == old, F.lit(new)).otherwise(out)
    return out


def excerpt(c: Column | str, most: int = 300) -> Column:
    return F.when(F.length(col(c)) > most, F.concat(F.substring(col(c), 1, most), F.lit("..."))).otherwise(col(c))


def unique_ratio(c: Column | str) -> Column:
    """Distinct share of the white-space tokens, case-sensitive; 0 without tokens."""
    t = tokens(c)
    return F.least(F.coalesce(F.try_divide(F.size(F.array_distinct(t)), F.size(t)), F.lit(0.0)), F.lit(1.0))


def mentions(c: Column | str, phrases: Sequence[str]) -> Column:
    """True if the lower-cased text holds one of the phrases; false for null."""
    return F.coalesce(contains_any(F.lower(col(c)), phrases), F.lit(False))


def is_short(c: Column | str, tokens_below: int = 10) -> Column:
    return F.size(tokens(c)) < tokens_below


def is_actionable(c: Column | str, empty_phrases: Sequence[str], least_words: int = 2) -> Column:
    return ~mentions(c, empty_phrases) & (F.size(words(c)) >= least_words)


def one_line(c: Column | str) -> Column:
    """Line ends become spaces; null becomes the empty text."""
    return F.coalesce(F.regexp_replace(col(c), r"[\r\n]", " "), F.lit(""))


def flat_map(c: Column | str) -> Column:
    """`k:v;k:v` of a map in the order of its keys, with commas of the parts replaced."""
    entries = F.array_sort(F.map_entries(col(c)))
    return F.array_join(F.transform(entries, lambda e: F.regexp_replace(F.concat(e["key"], F.lit(":"), F.coalesce(e["value"], F.lit(""))), "[,;\r\n]", " ")), ";")


def token_estimate(*cs: Column | str, per_char: float = 0.25, least: int = 0) -> Column:
    """Tokens estimated from the characters of all texts, rounded down, at least `least`."""
    chars = sum((F.coalesce(F.length(col(c)), F.lit(0)) for c in cs), F.lit(0))
    return F.greatest(F.floor(chars * F.lit(per_char)).cast("bigint"), F.lit(least).cast("bigint"))


def prompt(*parts: Column) -> Column:
    """The parts that aren't empty, parted by blank lines."""
    return F.concat_ws("\n\n", *(non_empty(p) for p in parts))
