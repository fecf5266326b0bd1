"""Readers: tickets, results, JSON lines, markdown articles, article indexes, marked dumps. All are lazy unless they must check."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lanternq.functions import text as X
from lanternq.functions import vocabulary as V
from lanternq.operators import guards
from lanternq.operators.sampling import cut

TICKET_ALIASES = {"text": ("document", "ticket_text", "body"), "label": ("topic_group", "category")}
ARTICLE_SCHEMA = "id string, category string, title string, summary string, content string, escalation_notes string, tags array<string>, path string"


def clean_tickets(df: DataFrame, strict: bool = True) -> DataFrame:
    """Rows with a text and a label, the label canonical. strict raises for labels that can't be mapped, else they become the fallback."""
    df = guards.require_columns(guards.rename_aliases(guards.tidy_names(df), TICKET_ALIASES), ("text", "label"))
    df = df.filter(~X.is_blank("text") & ~X.is_blank("label"))
    return df.withColumn("label", X.strict_label("label") if strict else X.label_or_fallback("label"))


def read_tickets(spark: SparkSession, path: str, start: int = 0, n: int | None = None, order: str | None = None, strict: bool = True) -> DataFrame:
    """A ticket CSV, cleaned, then sliced in the order of `order` (the whole file order without one is not defined in a cluster, so a slice needs it)."""
    out = clean_tickets(spark.read.csv(path, header=True, multiLine=True, escape='"'), strict)
    if start or n is not None:
        if order is None:
            raise ValueError("a slice needs an order")
        out = cut(out, [F.col(order)], start, n)
    return out


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A results CSV in the canonical columns; an absent file gives an empty table."""
    schema = ", ".join(f"{n} {t}" for n, t in V.RESULT_COLUMNS)
    if "://" not in path and not Path(path).exists():
        return spark.createDataFrame([], schema)
    return guards.conform(spark.read.csv(path, header=True, multiLine=True, escape='"'), V.RESULT_COLUMNS)


def read_json_lines(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON lines; bad lines and lines that are no object are skipped."""
    lines = spark.read.text(path)
    from lanternq.functions.records import is_object

    parsed = lines.filter(is_object("value")).select(F.from_json("value", schema).alias("r"))
    return parsed.filter("r is not null").select("r.*")


def read_chunks(spark: SparkSession, paths: Sequence[str], schema: Sequence[tuple[str, str]] = V.RESULT_COLUMNS) -> DataFrame:
    """CSV chunks with one header, in order of their names; chunks without a line are skipped, another header raises."""
    parts = []
    for p in sorted(paths):
        part = spark.read.csv(p, header=True, multiLine=True, escape='"')
        if part.columns:
            parts.append(part)
    return guards.conform(guards.union_strict(parts), schema)


def infer_columns(columns: Sequence[str], candidates: dict[str, Sequence[str]]) -> dict[str, str]:
    """For each role the first candidate that is there, whatever its case."""
    known = {c.strip().lower(): c for c in columns}
    out = {}
    for role, options in candidates.items():
        found = next((known[o] for o in options if o in known), None)
        if found is None:
            raise ValueError(f"no column for {role}")
        out[role] = found
    return out


def find_dataset(folders: Sequence[str], names: Sequence[str]) -> str:
    """The first existing file by folder, then by name."""
    for f in folders:
        for n in names:
            if Path(f, n).exists():
                return str(Path(f, n))
    raise FileNotFoundError(f"none of {list(names)} in {list(folders)}")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of all markdown files below a folder, hidden and cache folders left out."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    out = raw.select(F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^file:/+", "/").alias("path"), F.col("value").alias("text"))
    return out.filter(~F.col("path").rlike(r"/(\.|__pycache__)"))


def markdown_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line, is_title, heading, section): lines with the number and name of their section; a `# ` line ends a section."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = docs.select(F.col(key), F.posexplode(F.split(text, "\r?\n")).alias("pos", "line"))
    title, head = F.startswith("line", F.lit("# ")), F.startswith("line", F.lit("## "))
    mark = F.when(head, X.strip(F.substring("line", 4, 1_000_000))).when(title, F.lit(""))
    lines = lines.withColumn("is_title", title).withColumn("is_head", head).withColumn("heading", F.last(mark, ignorenulls=True).over(w))
    return lines.withColumn("section", F.count_if(title | head).over(w))


def markdown_sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, heading, body): the sections of each text in order."""
    body = markdown_lines(docs, key, text).filter("heading <> '' and not is_head")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda s: s["line"]), "\n")
    return body.groupBy(key, "section", "heading").agg(X.strip(joined).alias("body"))


def find_section(sections: DataFrame, key: str, wanted: str, name: str) -> DataFrame:
    """(key, name): the body of the first section whose lower-cased heading is or contains the wanted text."""
    return sections.filter(F.contains(F.lower("heading"), F.lit(wanted))).groupBy(key).agg(F.min_by("body", "section").alias(name))


def parse_articles(files: DataFrame, root: str) -> DataFrame:
    """Articles of markdown files (path, text): title, summary, escalation notes, id, tags, and the canonical category of the folder."""
    parts = F.split(F.regexp_replace("path", r"\.md$", ""), "/")
    base = files.select("path", "text", F.element_at(parts, -1).alias("stem"), F.element_at(parts, -2).alias("dir"))
    lines = markdown_lines(files, "path", "text")
    titles = lines.filter("is_title").groupBy("path").agg(F.max_by(X.strip(F.substring("line", 3, 1_000_000)), "pos").alias("t"))
    sections = markdown_sections(files, "path", "text")
    out = base.join(titles, "path", "left").join(find_section(sections, "path", "description", "summary"), "path", "left").join(find_section(sections, "path", "when to escalate", "notes"), "path", "left")
    slug = X.slug("stem")
    tags = F.slice(F.array_distinct(F.filter(F.concat(F.array("dir"), F.split(slug, "_")), lambda x: x != "")), 1, 8)
    return out.select(
        F.concat_ws(".", "dir", slug).alias("id"), X.strict_label("dir").alias("category"), X.first_non_empty("t", "stem").alias("title"), F.coalesce("summary", F.lit("")).alias("summary"),
        F.col("text").alias("content"), F.coalesce("notes", F.lit("")).alias("escalation_notes"), tags.alias("tags"), F.regexp_replace("path", f"^\\Q{root.rstrip('/')}/\\E", "").alias("path"),
    )


def build_index(spark: SparkSession, folder: str) -> DataFrame:
    """The articles of a folder; repeated ids raise."""
    return guards.refuse_duplicates(parse_articles(read_markdown(spark, folder), str(Path(folder).resolve())), "id")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A JSON index of articles; entries without an id or content raise, other gaps are filled with empty values."""
    raw = spark.read.schema(ARTICLE_SCHEMA).option("multiLine", True).json(path)
    guards.refuse_rows(raw.filter("id is null or content is null").select("id", "title"), "index entries without id or content")
    return raw.fillna("").withColumn("tags", F.coalesce("tags", F.expr("cast(array() as array<string>)")))


def split_dump(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): the blocks of a dump in which `<!-- file: path -->` lines start a block; a dump without markers raises."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    marker = X.non_empty(F.regexp_extract("line", r"^\s*<!--\s*file:\s*(.+?)\s*-->\s*$", 1))
    w = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)  # a single file
    rows = lines.withColumn("marker", marker).withColumn("block", F.count("marker").over(w)).filter("block > 0")
    if not rows.limit(1).count():
        raise ValueError("no file markers")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("marker").isNull(), F.struct("pos", "line")))), lambda s: s["line"]), "\n")
    return rows.groupBy("block").agg(F.max("marker").alias("path"), text.alias("text")).select("path", "text")


def read_vectors(spark: SparkSession, path: str, labels: Sequence[str] | None = None) -> DataFrame:
    """(label, vector) of an artefact. Vectors of different lengths, repeated labels and, if they are given, other labels raise."""
    df = spark.read.parquet(path).select("label", "vector")
    guards.refuse_duplicates(df, "label")
    sizes = df.agg(F.min(F.size("vector")).alias("lo"), F.max(F.size("vector")).alias("hi")).first()
    if sizes["lo"] != sizes["hi"]:
        raise ValueError(f"vectors of {sizes['lo']} to {sizes['hi']} values")
    if labels is not None:
        from lanternq.operators.classify import check_labels

        check_labels(df, "label", labels)
    return df


def read_config(path: str, defaults: dict | None = None) -> dict:
    """A JSON configuration over defaults, nested objects merged; an absent file gives the defaults."""
    import json

    def merged(a: dict, b: dict) -> dict:
        return a | {k: merged(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    p = Path(path)
    own = json.loads(p.read_text()) if p.exists() else {}
    if not isinstance(own, dict):
        raise ValueError("a configuration is an object")
    return merged(defaults or {}, own)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, n_bytes) of the files at a path."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"))


def tickets_frame(spark: SparkSession, tickets) -> DataFrame:
    """(id, text) of a DataFrame with such columns, of a list of dicts, or of a list of texts, which are numbered from 0."""
    if isinstance(tickets, DataFrame):
        return guards.require_columns(guards.rename_aliases(guards.tidy_names(tickets), TICKET_ALIASES | {"id": ("ticket_id", "ticket_index")}), ("id", "text")).select("id", "text")
    rows = [(i, None if t is None else str(t.get("text", t.get("document")) or "") if isinstance(t, dict) else str(t)) if not isinstance(t, dict) or t.get("id") is None else (t["id"], str(t.get("text", t.get("document")) or "")) for i, t in enumerate(tickets)]
    return spark.createDataFrame([(str(i), t) for i, t in rows], "id string, text string")


def content_hash(df: DataFrame, order: str, text: str) -> DataFrame:
    """One row: SHA-256 over all texts in order. It reads a whole index into one task, which a hash of this form requires."""
    return df.agg(F.sha2(F.expr(f"listagg(coalesce({text}, ''), '') within group (order by {order})").cast("binary"), 256).alias("sha256"), F.count(F.lit(1)).alias("n"))


def row_hashes(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sha256) of each text: the distributed form, from which changed rows follow by a join."""
    return df.select(key, F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("sha256"))
