"""Writers: canonical CSV, partitioned JSON lines, append-only run metadata, snapshots, and the plan of a folder sync."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanternq.functions import text as X
from lanternq.functions import vocabulary as V
from lanternq.operators import guards


def clean_for_csv(df: DataFrame) -> DataFrame:
    """Text on one line, null and NaN as empty text, maps as k:v;k:v."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind == "map":
            c = X.flat_map(c)
        elif kind in ("double", "float"):
            c = F.when(~F.isnan(c), c.cast("string"))
        else:
            c = c.cast("string")
        out.append(X.one_line(c).alias(f.name))
    return df.select(*out)


def write_results(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The canonical columns in their order; a table that lacks one raises."""
    guards.require_columns(df, (n for n, _ in V.RESULT_COLUMNS))
    clean_for_csv(df.select(*(n for n, _ in V.RESULT_COLUMNS))).write.mode(mode).csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_raw(df: DataFrame, path: str, by: Sequence[str] = ("router", "model", "memory", "classifier_mode"), mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*by).json(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def output_path(n: int, small: str, large: str, override: str | None = None, limit: int = 50) -> str:
    return override or (small if n <= limit else large)


def append_run(spark, record: dict, path: str) -> None:
    """One row of run metadata, appended; fields are text, so that later runs may add some."""
    row = {k: None if v is None else str(v) for k, v in record.items()}
    spark.createDataFrame([row], ", ".join(f"`{k}` string" for k in row)).write.mode("append").option("mergeSchema", True).parquet(path)


def write_by(df: DataFrame, path: str, by: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(by).csv(path, header=True)


def write_summaries(summaries: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """One CSV folder `summary_by_<name>` for each summary."""
    for name, df in summaries.items():
        df.write.mode(mode).csv(f"{folder}/summary_by_{name}", header=True)


def write_anova(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The table of an analysis of variance; one without rows gives a file with the header only."""
    df.coalesce(1).write.mode(mode).csv(path, header=True)  # a row for each term


def write_outputs(outputs: DataFrame, gold: DataFrame, key: str, label: str, path: str, mode: str = "errorifexists") -> None:
    """Outputs as JSON lines with the gold label of their key appended, null where there is none."""
    outputs.join(gold.select(key, F.col(label).alias("gold_label")).dropDuplicates([key]), key, "left").write.mode(mode).json(path)


def reproject(spark, paths: Sequence[str], columns: Sequence[tuple[str, str]] = V.RESULT_COLUMNS) -> list[str]:
    """Rewrites CSV folders in the canonical columns, those they lack empty: written beside, then swapped; absent ones are skipped. The paths done."""
    done = []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            continue
        beside, old = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{x}") for x in ("new", "old"))
        df = spark.read.csv(path, header=True, multiLine=True, escape='"')
        known = {c.strip().lower(): c for c in df.columns}
        df.select(*(F.coalesce(F.col(f"`{known[n]}`"), F.lit("")).alias(n) if n in known else F.lit("").alias(n) for n, _ in columns)).write.csv(f"{path}.new", header=True, escape='"')
        fs.rename(p, old)
        fs.rename(beside, p)
        fs.delete(old, True)
        done.append(path)
    return done


def write_vectors(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """An artefact of (label, vector) rows, such as centroids or the rows of a head."""
    df.select("label", F.transform(F.col(df.columns[-1]), lambda x: x.cast("double")).alias("vector")).write.mode(mode).parquet(path)


def sync_plan(expected: DataFrame, present: DataFrame, key: str = "path") -> DataFrame:
    """(key, action): write for what is expected, delete for what is present only."""
    stale = present.select(key).join(expected.select(key), key, "left_anti")
    return expected.select(key, F.lit("write").alias("action")).unionByName(stale.select(key, F.lit("delete").alias("action")))


def freeze(df: DataFrame, path: str, metadata: dict) -> None:
    """A snapshot and a row of metadata beside it."""
    df.write.mode("errorifexists").parquet(f"{path}/data")
    append_run(df.sparkSession, metadata, f"{path}/metadata")
