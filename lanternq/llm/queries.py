"""The pN_ queries on the test tables, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternq.llm import encoding, neardup, overlap, packing, pii, quantiles, sampling, spans, texts

QS = (0.5, 0.9, 0.95, 0.99)
BY = ("router", "memory", "model_used")


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _near_duplicates(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = _t(spark, sf, "tickets").select("ticket_id", "document", "received_at")
    return neardup.near_duplicates(t, "ticket_id", "document", "received_at", similarity=0.5, min_words=30)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return texts.expand_links(*_near_duplicates(spark, sf))


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each ticket of at least 30 words: its group and the number of classes of other texts it is linked to."""
    return neardup.components(*_near_duplicates(spark, sf)).withColumnRenamed("k0", "ticket_id")


def _overlaps(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = _t(spark, sf, "tickets").select("ticket_id", "document", "split_name", "received_at")
    return overlap.contained_pairs(t, "ticket_id", "document", "split_name", order="received_at")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    pair = overlap.expand(*_overlaps(spark, sf))
    return pair.select(F.least("other_key", "train_key").alias("id_a"), F.greatest("other_key", "train_key").alias("id_b"))


def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Per split and source: tickets, those that lie in a train ticket, and pairs."""
    t = _t(spark, sf, "tickets").filter("ticket_id is not null and split_name <> 'train'")
    t = t.groupBy("ticket_id").agg(F.min_by(F.struct("split_name", "source"), "received_at").alias("s")).select("ticket_id", "s.*")
    n = overlap.pair_counts(*_overlaps(spark, sf)).withColumnRenamed("other_key", "ticket_id")
    return t.join(n, "ticket_id", "left").groupBy("split_name", "source").agg(F.count(F.lit(1)).alias("tickets"), F.count("pairs").alias("overlapping"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    links, _, members = spans.shared_spans(_t(spark, sf, "documents").select("doc_id", "text"))
    return spans.expand(links, members).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p8_coverage(spark: SparkSession, sf: str) -> DataFrame:
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    _, places, members = spans.shared_spans(docs)
    return spans.coverage(docs, "doc_id", places, members)


def _private_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Both text columns as (field_name, row_key, text)."""
    t = _t(spark, sf, "tickets").select(F.lit("document").alias("field_name"), F.col("ticket_id").alias("row_key"), F.col("document").alias("text"))
    r = _t(spark, sf, "results").select(F.lit("memory_context_used").alias("field_name"), F.col("result_id").alias("row_key"), F.col("memory_context_used").alias("text"))
    return t.unionByName(r)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_pii(_private_texts(spark, sf), ["field_name", "row_key"], "text", _t(spark, sf, "name_list"))


def p5_redacted(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of both text columns with typed placeholders."""
    return pii.redact_column(_private_texts(spark, sf), ["field_name", "row_key"], "text", _t(spark, sf, "name_list"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoding.encode_corpus(_t(spark, sf, "documents").select("doc_id", "text"))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    sizes = encoding.encode_corpus(_t(spark, sf, "documents").select("doc_id", "text"), counts_only=True)
    return packing.pack(sizes, _t(spark, sf, "context_windows"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p7_containers(spark, sf))


def _first_results(spark: SparkSession, sf: str) -> DataFrame:
    """Each result_id once, as first sent; group columns in lower case, `-` and spaces as `_`, blank as null."""
    r = _t(spark, sf, "results")
    name = lambda c: F.nullif(F.lower(F.regexp_replace(F.trim(c), "[ -]+", "_")), F.lit(""))
    row = F.struct(*(name(c).alias(c) for c in BY), "latency_ms", "chunk_no", "logged_at")
    return r.filter("result_id is not null").groupBy("result_id").agg(F.min_by(row, F.struct("chunk_no", "logged_at")).alias("r")).select("r.*")


def p3_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return quantiles.radix_percentiles(_first_results(spark, sf), BY, "latency_ms", QS)


def p3_merged_days(spark: SparkSession, sf: str) -> DataFrame:
    """The same from histograms of single days, added up; low and high enclose the exact value."""
    days = quantiles.histogram(_first_results(spark, sf).withColumn("day", F.to_date("logged_at")), [*BY, "day"], "latency_ms")
    return quantiles.percentiles_from_histogram(quantiles.merge_histograms(days, BY), BY, QS)


def _labelled_tickets(spark: SparkSession, sf: str) -> DataFrame:
    """(ticket_id, topic_group) of tickets with text and a label that label_variants knows, as first received."""
    t = _t(spark, sf, "tickets").filter(F.col("document").isNotNull() & F.col("document").rlike(r"(?U)\S"))
    first = t.withColumn("v0", sampling.normal_label(F.col("topic_group"))).filter("ticket_id is not null").groupBy("ticket_id").agg(F.min_by("v0", "received_at").alias("variant_text"))
    return first.join(_t(spark, sf, "label_variants"), "variant_text").select("ticket_id", "topic_group")


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.balanced_sample(_labelled_tickets(spark, sf), _t(spark, sf, "sample_plans"), "ticket_id", "topic_group")[1]


def p4_sample(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.balanced_sample(_labelled_tickets(spark, sf), _t(spark, sf, "sample_plans"), "ticket_id", "topic_group")[0]


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_report(spark, sf).filter("shortfall > 0").select("plan_id", "topic_group")


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_counts, p3_percentiles, p3_merged_days, p4_found, p4_report, p4_sample, p5_found, p5_redacted, p6_ids, p7_containers, p7_fill, p8_found, p8_coverage)}


_FIRST = """
with f as (select *, row_number() over (partition by result_id order by chunk_no, logged_at) as k from results where result_id is not null),
g as (select nullif(lower(regexp_replace(trim(router), '[ -]+', '_', 'g')), '') as router, nullif(lower(regexp_replace(trim(memory), '[ -]+', '_', 'g')), '') as memory,
 nullif(lower(regexp_replace(trim(model_used), '[ -]+', '_', 'g')), '') as model_used, latency_ms as x from f where k = 1),
s as (select router, memory, model_used, count(x) filter (where not isnan(x)) as n, count(*) - count(x) filter (where not isnan(x)) as n_missing from g group by 1, 2, 3),
v as (select router, memory, model_used, x, row_number() over (partition by router, memory, model_used order by x) as rk from g where x is not null and not isnan(x)),
q as (select s.*, u.q, greatest(ceil(u.q * n), 1) as want from s, (select unnest([0.5e0, 0.9e0, 0.95e0, 0.99e0]) as q) u)
"""


def oracle_sql() -> dict[str, str]:
    same = "v.router is not distinct from q.router and v.memory is not distinct from q.memory and v.model_used is not distinct from q.model_used"
    label = "trim(regexp_replace(lower(translate(topic_group, '_-', '  ')), '\\s+', ' ', 'g'))"
    return {
        "p3_percentiles": f"{_FIRST} select q.router, q.memory, q.model_used, q.q, q.n, q.n_missing, v.x as value, case when v.x is not null then 0e0 end as error_bound from q left join v on {same} and v.rk = q.want",
        "p4_found": f"""with t as (select ticket_id, arg_min({label}, received_at) as v from tickets where document is not null and regexp_matches(document, '\\S') group by 1),
h as (select l.topic_group, count(*) as n from t join label_variants l on l.variant_text = t.v group by 1)
select plan_id, p.topic_group from sample_plans p left join h on h.topic_group = p.topic_group
where coalesce(n, 0) < coalesce(target_permille, 0) * coalesce(sample_rows, 0) / 1000e0 or coalesce(n, 0) < coalesce(min_rows, 0)""",
    }
