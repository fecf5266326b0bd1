"""Queries of record contracts, gold validation, slices of accuracy, dense retrieval, and of tables written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternq.functions import contracts as C
from lanternq.functions import records as R
from lanternq.functions import text as X
from lanternq.functions import vectors
from lanternq.functions import vocabulary as V
from lanternq.operators import analytics as A
from lanternq.operators import gold, guards
from lanternq.plans import pipeline
from lanternq.plans.analytics_queries import _SIM, _g, _l, centroid_similarity, num
from lanternq.plans.pipeline_queries import _ALL_Q, asked, corpus
from lanternq.plans.registry import query, quoted, table
from lanternq.plans.retrieval_queries import _BM, sql_top
from lanternq.plans.text_queries import sql_labels, sql_strip
from lanternq.session import shared_dir
from lanternq.sources import readers, writers

#: field of an agent's output -> column of the results log it is made of here
OUTPUT = {
    "original_query": "result", "topic_group": "gold_category", "model_name": "model_used", "router_mode": "router", "base_model_name": "model", "classifier_label": "classifier_label",
    "classifier_confidence_bucket": "classifier_mode", "classifier_backend": "classifier_backend", "memory_mode": "memory_mode", "reasoning": "router_decision_reason", "final_answer": "memory_context_used",
}


def outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Agent outputs as JSON text: fields that are null in the log are missing, ids are numbers, and much is left out."""
    flags = F.struct(F.col("json_valid").alias("needs_human"), F.col("kb_attached").alias("needs_llm_escalation"))
    metrics = F.struct(F.when(~F.isnan("latency_ms"), F.col("latency_ms")).alias("latency_ms"), F.col("memory_cost_tokens").alias("total_input_tokens"), F.col("model").alias("total_output_tokens"))
    fields = [F.col(c).alias(f) for f, c in OUTPUT.items()]
    made = F.struct("ticket_id", *fields, F.when(~F.isnan("classifier_confidence"), F.col("classifier_confidence")).alias("classifier_confidence"), F.array("router", "memory").alias("resolution_steps"), flags.alias("escalation_flags"), metrics.alias("metrics"))
    return table(spark, sf, "results").select("result_id", "chunk_no", F.to_json(made).alias("json"))


def _canon(c: str) -> str:
    return f"{c} in (select raw from ({sql_labels('results', c)}) where label is not null)"


def _texts() -> str:
    out = []
    for f in C.TEXT_FIELDS:
        c = OUTPUT.get(f)
        out.append(f"case when {c} is null then 'Missing field: {f}' when {sql_strip(c)} = '' then 'Field {f} is empty' end" if c else f"'Missing field: {f}'")
    return ", ".join(out)


_BUCKETS, _MODES = "[''high'', ''low'', ''medium'']", "[" + ", ".join(f"''{m}''" for m in sorted(V.MEMORY_MODES)) + "]"
_CONF = num("classifier_confidence")
_RULES = f"""concat_ws('; ', case when ticket_id is not null then 'ticket_id must be a string when provided' end, {_texts()},
 case when gold_category is not null and not {_canon('gold_category')} then 'Field topic_group is not in the allowed label set' end,
 case when classifier_label is not null and not {_canon('classifier_label')} then 'Field classifier_label is not in the allowed label set' end,
 case when classifier_mode <> '' and classifier_mode not in ('high', 'low', 'medium') then 'classifier_confidence_bucket must be one of {_BUCKETS}' end,
 case when {_CONF} is null then 'Missing field: classifier_confidence' when isinf({_CONF}) then 'classifier_confidence must be a number' when not {_CONF} between 0 and 1 then 'classifier_confidence must be between 0 and 1' end,
 case when memory_mode is not null and memory_mode not in ({quoted(V.MEMORY_MODES)}) then 'memory_mode must be one of {_MODES} or None' end,
 case when router is null or memory is null then 'resolution_steps must be a list of strings' end,
 case when json_valid is null then 'escalation_flags missing field: needs_human' end, case when kb_attached is null then 'escalation_flags missing field: needs_llm_escalation' end, 'escalation_flags missing field: policy_gap',
 case when latency_ms is null or isnan(latency_ms) then 'metrics missing field: latency_ms' when isinf(latency_ms) then 'metrics field latency_ms has wrong type' end, case when memory_cost_tokens is null then 'metrics missing field: total_input_tokens' end,
 case when model is null then 'metrics missing field: total_output_tokens' else 'metrics field total_output_tokens has wrong type' end, 'metrics missing field: total_cost_usd')"""


@query(f"select result_id, chunk_no, {_RULES} as errors from results")
def output_contract(spark: SparkSession, sf: str) -> DataFrame:
    return outputs(spark, sf).select("result_id", "chunk_no", F.array_join(C.errors("json"), "; ").alias("errors"))


@query(f"""select result_id, chunk_no, coalesce(ticket_id::varchar, '') as ticket_id, coalesce(result, '') as rewritten_query, coalesce(memory_mode, 'none') as memory_mode, false as policy_gap,
 coalesce((select any_value(label) from ({sql_labels('results', 'gold_category')}) where raw = gold_category), gold_category, (select any_value(label) from ({sql_labels('results', 'classifier_label')}) where raw = classifier_label), classifier_label, '') as topic_group from results""")
def output_contract_defaults(spark: SparkSession, sf: str) -> DataFrame:
    def parts(j):
        at = lambda p: F.get_json_object(j, f"$.{p}").alias(p.rsplit(".", 1)[-1])
        return F.struct(at("ticket_id"), at("rewritten_query"), at("memory_mode"), at("escalation_flags.policy_gap").cast("boolean").alias("policy_gap"), at("topic_group"))

    return outputs(spark, sf).select("result_id", "chunk_no", X.let(C.with_defaults("json"), parts).alias("o")).select("result_id", "chunk_no", "o.*")


@query("""with j as (select event_id, case when json_valid(props) and json_type(props) = 'OBJECT' then props end as j, props from events)
select event_id, '' as reasoning, case when j is null then coalesce(nullif(trim(props), ''), 'No valid answer produced') else 'No valid answer produced' end as final_answer from j""")
def normal_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", C.normal_output("props").alias("o")).select("event_id", "o.reasoning", "o.final_answer")


@query("""select event_id, case when json_valid(props) and json_type(props) = 'OBJECT' then 'record' else 'error' end as kind from events""")
def record_coercion(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", guards.coerced_record(F.col("props")).alias("j"))
    return e.select("event_id", F.when(F.get_json_object("j", "$.result") == "error", "error").otherwise("record").alias("kind"))


_IDLE = " or ".join(f"contains(lower(s), '{p.replace(chr(39), chr(39) * 2)}')" for p in gold.EMPTY_PHRASES)
_BLOB = " or ".join(f"contains(blob, '{p.replace(chr(39), chr(39) * 2)}')" for p in gold.EMPTY_PHRASES)


@query(f"""with g as (select ticket_index, {_g('summary')} as s, {_g('escalation_reason')} as r, coalesce(gold_resolution.escalation_required, false) as e, {_l('steps')} as steps, {_l('kb_policies')} as pol, {_l('acceptance_criteria')} as acc, gold_resolution is null as no, (select list(id) from kb_articles) as ids from gold_audit),
h as (select *, lower(concat_ws(' ', s, array_to_string(steps, ' '), array_to_string(acc, ' '))) as blob, list_sort(list_distinct(list_filter(pol, lambda x: not list_contains(ids, x)))) as odd,
 len(list_filter(steps, lambda s: ({_IDLE}) or len(regexp_extract_all(s, '[A-Za-z0-9_]+')) < 2)) as idle from g)
select ticket_index, case when no then 'empty_resolution' else concat_ws(',', case when s = '' or lower(s) = 'todo' then 'summary_missing' end, case when len(steps) < 3 or len(steps) > 8 then 'steps_count_out_of_range' when idle > 0 then 'steps_not_actionable' end,
 case when len(acc) < 2 then 'empty_acceptance_criteria' end, case when len(pol) = 0 then 'kb_policies_missing' end, case when len(odd) > 0 then 'kb_policy_not_retrieved:' || array_to_string(odd, ',') end,
 case when e and r = '' then 'escalation_reason_missing' end, case when {_BLOB} then 'non_actionable_fluff' end) end as reasons from h""")
def gold_reasons(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "kb_articles").agg(F.collect_set("id").alias("ids"))  # the articles are a table that doesn't grow
    r = "gold_resolution"
    g = table(spark, sf, "gold_audit").select("ticket_index", F.when(F.col(r).isNotNull(), gold.normal_resolution(r)).alias("g")).join(F.broadcast(ids))
    return g.select("ticket_index", F.array_join(gold.validation_reasons("g", F.col("ids")), ",").alias("reasons"))


_BUCKET = f"case when {_CONF} >= 0.8 then 'high' when {_CONF} >= 0.5 then 'medium' when {_CONF} is not null then 'low' end"
_SLICE = f"""(select coalesce(a.label, 'Miscellaneous') as gold, coalesce(b.label, {sql_strip('predicted_category')}) as p, {_BUCKET} as bucket from results
 left join ({sql_labels('results', 'gold_category')}) a on a.raw = gold_category left join ({sql_labels('results', 'predicted_category')}) b on b.raw = predicted_category)"""


@query(f"""with r as {_SLICE}, s as (select 'overall' as level, null as value, count(*) as total, count(*) filter (where gold = p) as correct from r union all select 'label', gold, count(*), count(*) filter (where gold = p) from r group by gold
 union all select 'bucket', bucket, count(*), count(*) filter (where gold = p) from r group by bucket union all select 'label', v, 0, 0 from (select unnest([{quoted(V.LABELS)}]) as v))
select level, value, sum(total)::bigint as total, sum(correct)::bigint as correct, round(coalesce(sum(correct) / nullif(sum(total), 0), 0e0), 6) as accuracy from s group by 1, 2""")
def slice_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "results").withColumn("bucket", R.band(R.number("classifier_confidence"), ((0.8, "high"), (0.5, "medium")), "low"))
    return A.slice_accuracy(r, "gold_category", "predicted_category", "bucket", spark.createDataFrame([(x,) for x in V.LABELS], "gold string"))


@query(f"with s as (select * from {_SIM}) select round(avg(cosine), 5) as mean, min(cosine) as low, max(cosine) as high, (select a from s order by cosine, a, b limit 1) as low_a, (select b from s order by cosine, a, b limit 1) as low_b, (select a from s order by cosine desc, a, b limit 1) as high_a, (select b from s order by cosine desc, a, b limit 1) as high_b from s")
def centroid_extremes(spark: SparkSession, sf: str) -> DataFrame:
    return A.extremes(centroid_similarity(spark, sf), "cosine").withColumn("mean", F.round("mean", 5))


def sql_letters(rows: str, key: str, text: str, size: int = 16) -> str:
    """(key, pos, x): unit vectors of letter counts, without those of texts without letters."""
    return f"""(with c as (select {key}, (i - 1 + unicode(ch)) % {size} as pos from (select {key}, unnest(string_split(lower({text}), '')) as ch, generate_subscripts(string_split(lower({text}), ''), 1) as i from {rows} where {text} <> '') where regexp_matches(ch, '^\\p{{L}}$')),
 n as (select {key}, pos, count(*) as k from c group by 1, 2) select {key}, pos, k / sqrt(sum(k * k) over (partition by {key})) as x from n)"""


@query(f"""select id, p.pos::int as pos, round(coalesce(x, 0e0), 6) as x from kb_articles cross join (select unnest(range(16)) as pos) p left join {sql_letters('kb_articles', 'id', 'title')} l using (id, pos) where id is not null""")
def title_vectors(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "kb_articles").filter("id is not null").select("id", vectors.letter_vector("title").alias("v"))
    return t.select("id", F.posexplode("v").alias("pos", "x")).select("id", "pos", F.round("x", 6).alias("x"))


_COSINES = f"(select q.ticket_id as q, d.id as doc, sum(q.x * d.x) as s from {sql_letters(_ALL_Q, 'ticket_id', 'document')} q join {sql_letters('kb_articles', 'id', 'content')} d using (pos) group by 1, 2)"


@query(f"select t.ticket_id as q, round(coalesce(max(s), 0e0), 4) as relevance, least(count(s), 3)::bigint as hits from {_ALL_Q} t left join {_COSINES} c on c.q = t.ticket_id group by 1")
def retrieve_dense(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.retrieve(asked(spark, sf), corpus(spark, sf).filter("doc is not null"), "rag_dense").select("q", F.round("relevance", 4).alias("relevance"), "hits")


@query()
def retrieve_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.retrieve(asked(spark, sf), corpus(spark, sf).filter("doc is not null"), "rag_hybrid")


@query(f"select t.ticket_id as q, coalesce(max(score), 0e0) as relevance, count(h.doc)::bigint as hits from {_ALL_Q} t left join (select b.* from {sql_top(_BM)} b join (select id from kb_articles where category is not null) k on k.id = b.doc) h on h.q = t.ticket_id group by 1")
def retrieve_known(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "kb_articles").filter("category is not null").select(F.col("id").alias("doc"))
    return pipeline.retrieve(asked(spark, sf), corpus(spark, sf), "rag_bm25", known_ids=known).select("q", "relevance", "hits")


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(f"""select router, count(*)::bigint as n, count({num('latency_ms')})::bigint as n_latency, round(avg({num('accuracy')}), 6) as accuracy, sum(length(coalesce(memory_context_used, '')))::bigint as context_chars, count_if(json_valid)::bigint as n_valid from results group by 1""")
def results_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The log written as CSV and read again; empty text comes back as null."""
    path = _place(spark, "results-csv")
    writers.write_results(table(spark, sf, "results"), path)
    back = readers.read_results(spark, path)
    return back.groupBy("router").agg(F.count(F.lit(1)).alias("n"), F.count(R.number("latency_ms")).alias("n_latency"), F.round(F.avg(R.number("accuracy")), 6).alias("accuracy"), F.sum(F.length(F.coalesce("memory_context_used", F.lit("")))).alias("context_chars"), F.count_if("json_valid").alias("n_valid"))


@query(f"""with l as ({sql_labels('tickets', 'topic_group')}) select ticket_id, coalesce(l.label, 'Miscellaneous') as label, count(*)::bigint as n from tickets t left join l on l.raw = t.topic_group where {sql_strip('coalesce(document, $$$$)')} <> '' and {sql_strip('coalesce(topic_group, $$$$)')} <> '' group by 1, 2""")
def tickets_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = _place(spark, "tickets-csv")
    table(spark, sf, "tickets").select("ticket_id", F.col("document").alias(" Document"), F.col("topic_group").alias("Topic Group")).write.csv(path, header=True, escape='"')
    t = readers.read_tickets(spark, path, strict=False)
    return t.groupBy(F.col("ticket_id").cast("bigint").alias("ticket_id"), "label").agg(F.count(F.lit(1)).alias("n"))


@query("select router, memory, count(*)::bigint as n, count(accuracy)::bigint as n_accuracy from results group by 1, 2")
def records_json(spark: SparkSession, sf: str) -> DataFrame:
    """Raw records as JSON lines, one folder for each router and memory, read again with their partition columns; bad lines beside them are skipped."""
    path = _place(spark, "records-json")
    r = table(spark, sf, "results").select("result_id", F.col("router").alias("r"), F.col("memory").alias("m"), "accuracy", "router", "memory")
    writers.write_raw(r, path, ("r", "m"))
    spark.createDataFrame([("no json",), ("[1]",)], "value string").write.mode("append").text(f"{path}/r=x/m=y")
    back = readers.read_json_lines(spark, f"{path}/*/*", "result_id bigint, router string, memory string, accuracy double")
    return back.groupBy("router", "memory").agg(F.count(F.lit(1)).alias("n"), F.count("accuracy").alias("n_accuracy"))


@query("select id, coalesce(title, '') as title, coalesce(summary, '') as summary, len(coalesce(tags, []))::int as tags, length(content)::int as chars from kb_articles where id is not null and content is not null")
def index_json(spark: SparkSession, sf: str) -> DataFrame:
    """The index of articles written as one JSON file and read again."""
    path = _place(spark, "index-json")
    kb = table(spark, sf, "kb_articles").filter("id is not null and content is not null")
    kb.agg(F.to_json(F.collect_list(F.struct(*kb.columns)))).coalesce(1).write.text(path)  # the articles are a table that doesn't grow
    return readers.read_index(spark, path).select("id", "title", "summary", F.size("tags").alias("tags"), F.length("content").alias("chars"))


_DIR = "replace(lower(l.label), ' ', '_')"


@query(f"""with l as ({sql_labels('kb_articles', 'category')}) select {_DIR} || '.' || trim(regexp_replace(lower(id), '[^a-z0-9]+', '_', 'g'), '_') as id, l.label as category, coalesce(nullif({sql_strip('regexp_replace(title, $$[\\r\\n]$$, $$ $$, $$g$$)')}, ''), id) as title
from kb_articles join l on l.raw = category where l.label is not null and id is not null""")
def articles_parsed(spark: SparkSession, sf: str) -> DataFrame:
    """Articles made into markdown files (path, text) and parsed."""
    k = table(spark, sf, "kb_articles").select("id", "title", "summary", "escalation_notes", X.canonical_label("category").alias("label")).filter("label is not null and id is not null")
    text = F.concat(F.lit("# "), X.one_line("title"), F.lit("\n## Description\n"), F.coalesce("summary", F.lit("")), F.lit("\n## When to escalate\n"), F.coalesce("escalation_notes", F.lit("")))
    files = k.select(F.concat(F.lit("/kb/"), F.replace(F.lower("label"), F.lit(" "), F.lit("_")), F.lit("/"), "id", F.lit(".md")).alias("path"), text.alias("text"))
    return readers.parse_articles(files, "/kb").select("id", "category", "title")


@query(f"with s as (select chunk_no % 2 as part, result_id from results) select part::int as part, count(*)::bigint as n, count(distinct result_id)::bigint as ids from s group by 1")
def chunks_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The log in two CSV chunks of one header, united again."""
    path = _place(spark, "chunks")
    r = table(spark, sf, "results").withColumn("router_decision_reason", F.pmod("chunk_no", F.lit(2)).cast("string")).withColumn("model", F.col("result_id").cast("string"))
    for i in (0, 1):
        writers.write_results(r.filter(F.col("router_decision_reason") == str(i)), f"{path}/part{i}")
    u = readers.read_chunks(spark, [f"{path}/part0", f"{path}/part1"])
    return u.groupBy(F.col("router_decision_reason").cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("model").alias("ids"))


@query("select 'kb/' || id || '.md' as path, length(coalesce(content, ''))::int as chars from kb_articles where id is not null")
def dump_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A dump of all articles with a marker line for each, split into its files again."""
    path = _place(spark, "dump")
    kb = table(spark, sf, "kb_articles").select("id", F.coalesce(X.one_line("content"), F.lit("")).alias("c")).filter("id is not null")
    kb.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "c"))), lambda s: F.concat(F.lit("<!-- file: kb/"), s["id"], F.lit(".md -->\n"), s["c"])), "\n")).coalesce(1).write.text(path)
    return readers.split_dump(spark, path).select("path", F.length(F.regexp_replace("text", "\n$", "")).alias("chars"))  # the written file ends with a line end
