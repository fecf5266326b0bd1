"""Queries of the composed operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternq.functions import records as R
from lanternq.functions import text as X
from lanternq.operators import gold
from lanternq.plans import pipeline
from lanternq.plans.registry import query, table
from lanternq.plans.retrieval_queries import _BM, TQ, kb, sql_top, tickets
from lanternq.plans.text_queries import sql_strip


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return kb(spark, sf).select(F.col("id").alias("doc"), F.col("content").alias("text"))


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return tickets(spark, sf).select(F.col("ticket_id").alias("q"), F.col("document").alias("text"))


_ALL_Q = "(select ticket_id, arg_min_null(document, received_at) as document from tickets where ticket_id % 100 = 0 group by 1)"


@query(f"""select t.ticket_id as q, coalesce(string_agg('### rag_bm25 ' || rk || ' [' || doc || '] (score=' || printf('%.2f', score) || '):' || chr(10) || '> ' || {sql_strip("coalesce(k.content, 'null')")}, chr(10) || chr(10) order by rk), '') as context,
coalesce(max(score), 0e0) as relevance, count(h.doc)::bigint as hits from {_ALL_Q} t left join {sql_top(_BM)} h on h.q = t.ticket_id left join kb_articles k on k.id = h.doc group by 1""")
def retrieve_payload(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.retrieve(asked(spark, sf), corpus(spark, sf), "rag_bm25").select("q", "context", "relevance", "hits")


@query(f"select ticket_id as q, '' as context, 0e0 as relevance, 0::bigint as hits, floor(coalesce(length(document), 0) * 0.25e0)::bigint as cost_tokens from {_ALL_Q}")
def retrieve_none(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.retrieve(asked(spark, sf), corpus(spark, sf), "none")


@query(f"""select doc, length(text)::int as n from (select id as doc, content as text from kb_articles union all
select 'dynamic:' || (k + row_number() over (order by ticket_id) - 1), {sql_strip('document')} from (select ticket_id, arg_min(document, received_at) as document from tickets where document is not null group by 1), (select count(*) as k from kb_articles) where {sql_strip('document')} <> '')""")
def index_append(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "tickets").filter("document is not null")  # a ticket that arrives again is one document, with its first text
    new = t.groupBy(F.col("ticket_id").alias("at")).agg(F.min_by("document", "received_at").alias("document"))
    return pipeline.append_documents(corpus(spark, sf), new, "document").select("doc", F.length("text").alias("n"))


@query(f"select result_id, chunk_no, coalesce(nullif({sql_strip('classifier_label')}, ''), nullif({sql_strip('llm_category')}, ''), 'unknown') as final_label from results")
def prediction_precedence(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "results").select("result_id", "chunk_no", pipeline.first_prediction("classifier_label", "llm_category").alias("final_label"))


@query("select model, capacity_tokens from context_windows where model in ('no_such_model') union all select model, capacity_tokens from context_windows where not exists (select 1 from context_windows where model in ('no_such_model'))")
def filter_or_all(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.filter_or_all(table(spark, sf, "context_windows"), F.col("model") == "no_such_model")


@query("select ticket_index, topic_group, ticket_text, 'TODO' as summary, 0 as steps, false as escalation_required from gold_audit")
def gold_template(spark: SparkSession, sf: str) -> DataFrame:
    none = F.expr("cast(array() as array<string>)")
    g = table(spark, sf, "gold_audit")
    made = F.struct(F.lit("TODO").alias("summary"), none.alias("steps"), F.lit(False).alias("escalation_required"), F.lit("").alias("escalation_reason"), none.alias("kb_policies"), none.alias("acceptance_criteria"))
    out = g.select("ticket_index", "topic_group", "ticket_text", made.alias("r")).withColumn("r", gold.normal_resolution("r"))
    return out.select("ticket_index", "topic_group", "ticket_text", "r.summary", F.size("r.steps").alias("steps"), "r.escalation_required")


@query("""select event_id, coalesce(nullif(trim(json_extract_string(j, '$.final_answer')), ''), 'No valid answer produced') as final_answer, coalesce(json_extract_string(j, '$.k'), '') as reasoning from (select event_id, case when json_valid(props) then props end as j from events)""")
def output_defaults(spark: SparkSession, sf: str) -> DataFrame:
    j = R.parsed_object("props")
    answer = X.first_non_empty(F.trim(F.get_json_object(j, "$.final_answer")), F.lit("No valid answer produced"))
    return table(spark, sf, "events").select("event_id", answer.alias("final_answer"), F.coalesce(F.get_json_object(j, "$.k"), F.lit("")).alias("reasoning"))


@query("""select ticket_index, case when len(coalesce(review_reasons, [])) = 0 then 'reviewer' when not coalesce(needs_human_review, false) then 'annotator' else 'failed' end as decision from gold_audit""")
def review_decision(spark: SparkSession, sf: str) -> DataFrame:
    none = F.expr("cast(array() as array<string>)")
    held = R.messages((F.coalesce("needs_human_review", F.lit(False)), "needs_human_review"))
    return table(spark, sf, "gold_audit").select("ticket_index", pipeline.review_decision(F.coalesce("review_reasons", none), held).alias("decision"))
