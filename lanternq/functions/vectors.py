"""Vector functions on array<double> columns, as higher-order built-ins. Null vectors give null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanternq.functions.text import col, let


def doubles(c: Column | str) -> Column:
    return F.transform(col(c), lambda x: x.cast("double"))


def total(c: Column | str) -> Column:
    return F.aggregate(col(c), F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product over the shorter length."""
    return total(F.transform(F.zip_with(col(a), col(b), lambda x, y: x * y), lambda v: F.coalesce(v, F.lit(0.0))))


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str, epsilon: float = 1e-9) -> Column:
    """Cosine similarity with epsilon added to either norm, so that zero vectors give 0."""
    return dot(a, b) / ((norm(a) + epsilon) * (norm(b) + epsilon))


def unit(a: Column | str, epsilon: float = 1e-9) -> Column:
    return let(norm(a) + epsilon, lambda n: F.transform(col(a), lambda x: x / n))


def softmax(a: Column | str) -> Column:
    shifted = lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda x: F.exp(x - top)))
    return let(let(col(a), shifted), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def normalized(a: Column | str) -> Column:
    """Shares of a score array: below zero counts as 0, without mass all are equal."""
    positive = F.transform(col(a), lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))
    return let(positive, lambda p: let(total(p), lambda s: F.transform(p, lambda x: F.when(s > 0, x / s).otherwise(F.lit(1.0) / F.greatest(F.size(p), F.lit(1))))))


def letter_vector(c: Column | str, size: int = 16) -> Column:
    """Unit vector of letter counts by (place + code point) modulo size, over the letters of the lower-cased text."""
    letters = F.filter(
        F.transform(F.split(F.lower(F.coalesce(col(c), F.lit(""))), ""), lambda x, i: F.struct(x.alias("c"), i.alias("i"))), lambda s: s["c"].rlike(r"^\p{L}$")
    )
    slots = F.transform(letters, lambda s: F.pmod(s["i"] + F.ascii(s["c"]), F.lit(size)))
    count = lambda ss: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.size(F.filter(ss, lambda s: s == k)).cast("double"))
    return let(let(slots, count), lambda c_: let(norm(c_), lambda n: F.transform(c_, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0)))))


def affine(weights: Sequence[Sequence[float]], bias: Sequence[float], x: Column | str, relu: bool = False) -> Column:
    """W x + b with W given by rows, with an optional ReLU: one layer of a small head."""
    rows = [dot(F.array(*(F.lit(float(w)) for w in r)), x) + F.lit(float(b)) for r, b in zip(weights, bias)]
    return F.array(*(F.greatest(r, F.lit(0.0)) if relu else r for r in rows))
