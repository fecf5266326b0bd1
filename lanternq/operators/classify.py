"""Transparent classifiers: keyword priors and scores, centroids, TF-IDF with logistic regression, and a registry of them.

Probabilities are long tables (id, label, p) or arrays in label order; every argmax takes the first label in order on ties."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanternq.functions import text as X
from lanternq.functions import vectors as V
from lanternq.functions import vocabulary as W
from lanternq.session import broadcast_if_small

#: Labels whose centroids may be broadcast; more are refused.
MAX_LABELS = 10_000
#: Labels of a trained model; more are refused.
MAX_MODEL_LABELS = 1000
REGISTRY: dict[str, Callable] = {}


def register(name: str) -> Callable:
    def put(f: Callable) -> Callable:
        REGISTRY[name] = f
        return f

    return put


def hits(text: Column, words: Sequence[str]) -> Column:
    """How many of the words the lower-cased text contains as substrings."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(text, F.lit(w)).cast("int")
    return out


def prior_hits(text: Column | str, labels: Sequence[str] = W.LABELS, weighted: bool = True) -> Column:
    low = F.lower(F.coalesce(X.col(text), F.lit("")))
    return X.let(low, lambda t: F.array(*((hits(t, W.PRIOR_KEYWORDS.get(k, ())) * F.lit(W.PRIOR_WEIGHTS.get(k, 1.0) if weighted else 1.0)).cast("double") for k in labels)))


def with_prior(text: Column | str, probs: Column, alpha: float = 0.75, beta: float = 0.25, labels: Sequence[str] = W.LABELS) -> Column:
    """Probabilities (array in label order) blended with the keyword prior; unchanged for texts without keywords."""
    damp = F.array(*(F.lit(0.5 if k == W.FALLBACK else 1.0) for k in labels))

    def blend(h: Column, p0: Column) -> Column:
        raw = F.zip_with(h, damp, lambda x, d: (x + 1e-6) * d)
        mixed = X.let(raw, lambda r0: X.let(V.total(r0), lambda mass: F.zip_with(p0, r0, lambda p, r: F.greatest(alpha * p + beta * r / mass, F.lit(0.0)))))
        return F.when(V.total(h) > 0, V.normalized(mixed)).otherwise(p0)

    return X.let(prior_hits(text, labels), lambda h: X.let(probs, lambda p0: blend(h, p0)))


def uniform(labels: Sequence[str] = W.LABELS) -> Column:
    return F.array(*(F.lit(1.0 / len(labels)) for _ in labels))


def best_label(probs: Column, labels: Sequence[str] = W.LABELS) -> Column:
    """The label of the largest value, the first one on ties."""
    return X.let(probs, lambda p: F.element_at(F.array(*(F.lit(k) for k in labels)), F.array_position(p, F.array_max(p)).cast("int")))


@register("prior")
def prior(text: Column | str) -> Column:
    """The keyword prior alone, over equal shares."""
    return with_prior(text, uniform(), alpha=0.0, beta=1.0)


@register("heuristic")
def heuristic(text: Column | str, labels: Sequence[str] = W.LABELS) -> Column:
    """Keyword scores as shares, blended with the prior."""
    def scores(low: Column) -> Column:
        out = []
        for k in labels:
            s = F.lit(0.05) + hits(low, W.SCORE_KEYWORDS.get(k, ())) * F.lit(1.8 if k in W.PRIOR_WEIGHTS else 1.5)
            out.append(s + F.when(F.size(X.tokens(low)) < 5, F.lit(0.2)).otherwise(F.lit(0.0)) if k == W.FALLBACK else s)
        return F.array(*out)

    return with_prior(text, V.normalized(X.let(F.lower(F.coalesce(X.col(text), F.lit(""))), scores)))


def override_fallback(text: Column | str, label: Column, least: float = 0.65, labels: Sequence[str] = W.LABELS) -> Column:
    """A fallback label gives way to the label that holds at least this share of all keyword hits."""

    def decide(h: Column) -> Column:
        others = F.transform(h, lambda x, i: F.when(i == labels.index(W.FALLBACK), F.lit(-1.0)).otherwise(x))
        strong = F.coalesce(F.try_divide(F.array_max(others), V.total(h)) >= least, F.lit(False))
        return F.when((label == W.FALLBACK) & strong, best_label(others, labels)).otherwise(label)

    return X.let(prior_hits(text, labels, weighted=False), decide)


def centroids(df: DataFrame, label: str, vector: str, epsilon: float = 1e-9) -> DataFrame:
    """(label, n, centroid): the element-wise mean of each label's vectors, scaled to length 1. Sums are made per position, so no
    task gathers the vectors of a label."""
    long = df.select(F.col(label).alias("label"), F.posexplode(V.doubles(vector)).alias("pos", "x"))
    per = long.groupBy("label", "pos").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n"))
    whole = per.groupBy("label").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("c"))
    return whole.select("label", "n", V.unit("c", epsilon).alias("centroid"))


def classify_by_centroid(df: DataFrame, key: str, vector: str, cents: DataFrame, digits: int = 6) -> DataFrame:
    """(key, label, p) for every label: softmax of the cosines with the centroids, cosines below 0 as they are. Centroids are one row per
    label, at most MAX_LABELS, and are broadcast."""
    if cents.limit(MAX_LABELS + 1).count() > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    c = cents.agg(F.array_sort(F.collect_list(F.struct("label", "centroid"))).alias("cs"))
    d = df.select(F.col(key), V.doubles(vector).alias("v")).join(F.broadcast(c))
    cos = X.let(V.unit("v"), lambda u: F.transform("cs", lambda s: V.dot(u, s["centroid"])))
    p = d.select(key, F.transform("cs", lambda s: s["label"]).alias("ls"), V.softmax(cos).alias("p"))
    return p.select(key, F.explode(F.arrays_zip("ls", "p")).alias("z")).select(key, F.col("z.ls").alias("label"), F.round("z.p", digits).alias("p"))


def argmax(probs: DataFrame, key: str) -> DataFrame:
    """(key, predicted, confidence): the label with the largest p, the least label on ties."""
    first = F.min(F.struct((-F.col("p")).alias("d"), F.col("label").alias("predicted"), F.col("p").alias("confidence")))
    return probs.filter(F.col("p").isNotNull()).groupBy(key).agg(first.alias("m")).select(key, "m.predicted", "m.confidence")


def centroid_similarity(cents: DataFrame, digits: int = 6) -> DataFrame:
    """(a, b, cosine) of all ordered pairs of different labels."""
    a = cents.select(F.col("label").alias("a"), F.col("centroid").alias("va"))
    b = cents.select(F.col("label").alias("b"), F.col("centroid").alias("vb"))
    return a.join(broadcast_if_small(b, MAX_LABELS), F.col("a") != F.col("b")).select("a", "b", F.round(V.cosine("va", "vb"), digits).alias("cosine"))


def standardised(df: DataFrame, key: str, vector: str, floor: float = 1e-6, digits: int = 6) -> DataFrame:
    """(key, pos, z): population-standardised features; a deviation up to the floor counts as 1."""
    long = df.select(F.col(key), F.posexplode(V.doubles(vector)).alias("pos", "x"))
    s = long.groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("d"))
    return long.join(s, "pos").select(key, "pos", F.round((F.col("x") - F.col("m")) / F.when(F.col("d") > floor, F.col("d")).otherwise(F.lit(1.0)), digits).alias("z"))


def choose(candidates: DataFrame, order: Sequence[Column]) -> DataFrame:
    """The single best candidate under an explicit order."""
    return candidates.orderBy(*order).limit(1)


def _accents() -> tuple[str, str]:
    """Arguments of translate: letters and digits that decompose to a single one once combining marks are gone, and that one; then the marks,
    which are dropped. Characters that decompose to several (ligatures, syllables) stay."""
    plain, marks = {}, []
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x30000)]):
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not d:
            marks.append(c)
        elif d != c and len(d) == 1 and (d.isalnum() or d == "_"):
            plain[c] = d
    return "".join(plain) + "".join(marks), "".join(plain.values())


def tfidf_model(train: DataFrame, text: str, label: str, features: int = 20000, max_df: float = 0.9, min_df: float = 2.0):
    """(pipeline model, label names): counts of 1- to 3-grams, log-scaled (1 + ln), times smoothed inverse document frequency, scaled to length 1,
    into a class-balanced multinomial logistic regression. Words are lower-cased, without accents, of two characters at least, and none of
    Spark's English stop words (whose list is not scikit-learn's). More than MAX_MODEL_LABELS labels are refused."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, SQLTransformer, StopWordsRemover, StringIndexer
    from pyspark.ml.linalg import SparseVector, VectorUDT

    sizes = train.groupBy(F.col(label).alias("y__")).agg(F.count(F.lit(1)).alias("n__")).orderBy("y__").limit(MAX_MODEL_LABELS + 1).collect()
    if len(sizes) > MAX_MODEL_LABELS:
        raise ValueError(f"more than {MAX_MODEL_LABELS} labels")
    names, n = [r["y__"] for r in sizes], sum(r["n__"] for r in sizes)
    weights = train.sparkSession.createDataFrame([(r["y__"], n / (len(sizes) * r["n__"])) for r in sizes], f"y__ {train.schema[label].dataType.simpleString()}, weight double")
    weighted = train.join(F.broadcast(weights), F.col(label).eqNullSafe(F.col("y__"))).drop("y__")

    def sublinear(v):
        return SparseVector(v.size, v.indices, 1 + np.log(v.values))

    train.sparkSession.udf.register("lanternq_sublinear", F.udf(sublinear, VectorUDT(), useArrow=False))
    accented, plain = _accents()
    words = SQLTransformer(statement=f"SELECT *, regexp_extract_all(translate(lower(coalesce({text}, '')), '{accented}', '{plain}'), '[\\\\p{{L}}\\\\p{{N}}_]{{2,}}', 0) AS words FROM __THIS__")
    stop = sorted({x for s in StopWordsRemover.loadDefaultStopWords("english") for x in s.split("'")})
    grams = SQLTransformer(
        statement="SELECT *, concat(ws, CASE WHEN size(ws) > 1 THEN transform(sequence(1, size(ws) - 1), i -> concat_ws(' ', slice(ws, i, 2))) ELSE array() END, "
        "CASE WHEN size(ws) > 2 THEN transform(sequence(1, size(ws) - 2), i -> concat_ws(' ', slice(ws, i, 3))) ELSE array() END) AS grams FROM __THIS__"
    )
    stages = [
        words, StopWordsRemover(inputCol="words", outputCol="ws", stopWords=stop), grams, CountVectorizer(inputCol="grams", outputCol="tf", vocabSize=features, minDF=min_df, maxDF=max_df),
        SQLTransformer(statement="SELECT *, lanternq_sublinear(tf) AS logtf FROM __THIS__"), IDF(inputCol="logtf", outputCol="idf"), Normalizer(inputCol="idf", outputCol="features"),
        StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc", handleInvalid="keep"), LogisticRegression(featuresCol="features", labelCol="y", weightCol="weight", maxIter=2000, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(weighted), names


def blended(probs: Column, text: Column | str, order: Sequence[str], alpha: float = 0.7, beta: float = 0.3, labels: Sequence[str] = W.LABELS) -> Column:
    """Probabilities of a trained model in the order of its own labels, put into the order of `labels` (0 for those it doesn't know), scaled to a
    sum of 1 (equal shares without mass), and blended with the keyword prior."""
    place = {k: i + 1 for i, k in enumerate(order)}
    aligned = X.let(probs, lambda p: F.array(*(F.element_at(p, place[k]) if k in place else F.lit(0.0) for k in labels)))
    return with_prior(text, V.normalized(aligned), alpha, beta, labels)


def sweep_heads(train: DataFrame, validation: DataFrame, features: str, label: str, penalties: Sequence[float] = (1e-4, 1e-3, 1e-2), weightings: Sequence[str] = ("none", "balanced"), hidden: Sequence[int] = ()):
    """(best model, candidates): a softmax head, or a perceptron with hidden layers, for each penalty and weighting of classes, chosen by validation
    accuracy, then macro F1, then the order of weightings and penalties. candidates: one dict each. label holds 0, 1, ... as doubles."""
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    from lanternq.operators.analytics import macro_f1

    sizes = {r[0]: r[1] for r in train.groupBy(label).count().orderBy(label).limit(MAX_MODEL_LABELS + 1).collect()}
    if len(sizes) > MAX_MODEL_LABELS:
        raise ValueError(f"more than {MAX_MODEL_LABELS} labels")
    total = sum(sizes.values())
    spark = train.sparkSession
    weights = spark.createDataFrame([(float(k), total / (len(sizes) * n)) for k, n in sizes.items()], "y__ double, weight__ double")
    found = []
    for i, mode in enumerate(weightings):
        data = train.join(F.broadcast(weights), F.col(label) == F.col("y__")).withColumn("weight__", F.col("weight__") if mode == "balanced" else F.lit(1.0))
        for j, penalty in enumerate(penalties):
            if hidden:  # this learner knows neither weights nor penalties: rows of rare classes can't count more
                width = len(train.select(features).first()[0])
                model = MultilayerPerceptronClassifier(featuresCol=features, labelCol=label, layers=[width, *hidden, len(sizes)], seed=13, stepSize=max(penalty, 1e-4)).fit(data)
            else:
                model = LogisticRegression(featuresCol=features, labelCol=label, weightCol="weight__", regParam=penalty, maxIter=200, family="multinomial").fit(data)
            scored = model.transform(validation)
            accuracy = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy").evaluate(scored)
            f1 = macro_f1(scored, label, "prediction").first()["macro_f1"]
            found.append(({"weighting": mode, "penalty": penalty, "accuracy": accuracy, "macro_f1": f1, "order": (i, j)}, model))
    best = min(found, key=lambda c: (-c[0]["accuracy"], -(c[0]["macro_f1"] or 0.0), c[0]["order"]))
    return best[1], [c for c, _ in found]


def joined_features(*vectors: Column | str) -> Column:
    """One array of the values of several vectors, end to end; a null vector makes it null."""
    return F.concat(*(V.doubles(v) for v in vectors))


def check_labels(df: DataFrame, column: str, allowed: Sequence[str] = W.LABELS) -> DataFrame:
    """df, if its labels are exactly the allowed ones; otherwise it raises and names what lacks and what is too much."""
    found = {r[0] for r in df.select(column).distinct().limit(MAX_LABELS + 1).collect()}
    lacking, extra = sorted(set(allowed) - found), sorted(map(str, found - set(allowed)))
    if lacking or extra:
        raise ValueError(f"labels lack {lacking} and hold {extra}")
    return df


def score_in_batches(df: DataFrame, scorer: Callable[[list[str]], list[str]], text: str, out: str) -> DataFrame:
    """A pluggable model over a text column: scorer maps a list of texts to a list of outputs, one Arrow batch at a time."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**{out: scorer(f[text].tolist())})

    return df.mapInPandas(run, f"{fields}, `{out}` string")


def with_repair(scorer: Callable[[list[str]], list[str]], valid: Callable[[str], bool], tries: int = 3, fallback: str = "") -> Callable[[list[str]], list[str]]:
    """The scorer, asked again for outputs that aren't valid, at most `tries` times, then the fallback."""

    def run(texts: list[str]) -> list[str]:
        out = list(scorer(texts))
        for _ in range(tries - 1):
            bad = [i for i, o in enumerate(out) if not valid(o)]
            if not bad:
                break
            for i, o in zip(bad, scorer([texts[i] for i in bad])):
                out[i] = o
        return [o if valid(o) else fallback for o in out]

    return run
