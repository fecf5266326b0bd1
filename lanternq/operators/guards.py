"""Checks that raise on the driver before or after a cheap query, and schema conformance."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def tidy_names(df: DataFrame) -> DataFrame:
    """Column names trimmed, in lower case, spaces as underscores; names that clash then are refused."""
    names = [c.strip().lower().replace(" ", "_") for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names clash: {sorted(n for n in set(names) if names.count(n) > 1)}")
    return df.toDF(*names)


def rename_aliases(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Each canonical column that is absent takes the first alias that is there."""
    for name, options in aliases.items():
        if name not in df.columns:
            found = next((o for o in options if o in df.columns), None)
            if found:
                df = df.withColumnRenamed(found, name)
    return df


def conform(df: DataFrame, schema: Sequence[tuple[str, str]], defaults: dict[str, object] | None = None) -> DataFrame:
    """df with exactly the columns of schema (name, type) in order; absent ones and nulls take the default, else null. Values that
    can't be read as the type become null."""
    defaults = defaults or {}
    out = []
    for name, kind in schema:
        c = F.col(name).try_cast(kind) if name in df.columns else F.lit(None).cast(kind)
        out.append((F.coalesce(c, F.lit(defaults[name]).cast(kind)) if name in defaults else c).alias(name))
    return df.select(*out)


def unexpected(df: DataFrame, column: str, allowed: DataFrame, name: str) -> DataFrame:
    """Distinct values of a column that aren't in allowed."""
    return df.select(F.col(column).alias(name)).distinct().join(allowed.select(name), name, "left_anti")


def refuse_rows(bad: DataFrame, what: str, show: int = 5) -> None:
    """Raise if there are rows; only a few of them reach the driver."""
    rows = bad.limit(show).collect()
    if rows:
        raise ValueError(f"{what}: {[tuple(r) for r in rows]}")


def refuse_duplicates(df: DataFrame, key: str) -> DataFrame:
    refuse_rows(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), f"repeated {key}")
    return df


def quarantine(df: DataFrame, errors: str) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows by an array column of errors."""
    bad = F.coalesce(F.size(errors), F.lit(0)) > 0
    return df.filter(~bad).drop(errors), df.filter(bad)


def coerced_record(json: Column) -> Column:
    """A record as it is if it is a JSON object; anything else becomes `{"result":"error","raw_record":...}`."""
    from lanternq.functions.records import is_object

    return F.when(is_object(json), json).otherwise(F.to_json(F.struct(F.lit("error").alias("result"), F.coalesce(json, F.lit("null")).alias("raw_record"))))


def sane_registry(models: DataFrame, kinds: Sequence[str] = ("slm", "llm"), only: Sequence[str] | None = None, force: str | None = None) -> DataFrame:
    """Models (name, kind) of a registry, of a subset of names, or of one kind that is forced. A kind without a model raises, unless one is forced."""
    out = models if only is None else models.filter(F.col("name").isin(*only))
    out = out if force is None else out.filter(F.lower("kind") == force)
    have = {r[0] for r in out.select(F.lower("kind")).distinct().limit(100).collect()}
    lacking = sorted(set([force] if force else kinds) - have)
    if lacking:
        raise ValueError(f"no model of kind {lacking}")
    return out


def union_strict(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts, whose columns must be the same in the same order."""
    if not parts:
        raise ValueError("nothing to unite")
    out = parts[0]
    for p in parts[1:]:
        if p.columns != out.columns:
            raise ValueError(f"columns differ: {out.columns} and {p.columns}")
        out = out.unionByName(p)
    return out
