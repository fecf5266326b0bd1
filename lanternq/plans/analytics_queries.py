"""Queries of the aggregates over the results log, the classifier family and the gold set."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanternq.functions import records as R
from lanternq.functions import text as X
from lanternq.functions import vectors
from lanternq.functions import vocabulary as V
from lanternq.operators import analytics as A
from lanternq.operators import classify, gold, guards, sampling
from lanternq.plans import grid
from lanternq.plans.registry import query, quoted, table
from lanternq.plans.text_queries import sql_labels, sql_strip, sql_tokens

METRICS = ("accuracy", "groundedness", "schema_validity", "latency_ms", "cost_usd")


def num(c: str) -> str:
    return f"(case when isnan({c}::double) then null else {c}::double end)"


def avg(c: str, name: str | None = None) -> str:
    return f"round(avg({num(c)}), 6) as {name or c}"


def results(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "results")


_MODE = f"coalesce(nullif(lower({sql_strip('memory')}), ''), 'unknown')"
_CUR = f"case {_MODE} when 'rag' then 'rag_dense' when 'salience' then 'rag_hybrid' else {_MODE} end"


@query(f"select count(*)::bigint as n, {', '.join(avg(c) for c in METRICS)} from results")
def agg_global_means(spark: SparkSession, sf: str) -> DataFrame:
    return A.means(results(spark, sf), [], METRICS)


@query(f"select router, round(avg((coalesce(model_used <> 'llm', false))::int), 6) as conversion, {avg('latency_ms')}, {avg('cost_usd')} from results group by 1")
def agg_conversion(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).groupBy("router").agg(A.share(F.col("model_used") != "llm").alias("conversion"), A.mean("latency_ms").alias("latency_ms"), A.mean("cost_usd").alias("cost_usd"))


@query(f"select router, memory, model, count(*)::bigint as n, {', '.join(avg(c) for c in METRICS)} from results group by 1, 2, 3")
def agg_group_means(spark: SparkSession, sf: str) -> DataFrame:
    return A.means(results(spark, sf), ["router", "memory", "model"], METRICS)


@query(f"select router, {', '.join(f'round(avg({num('accuracy')}) filter (where mode = $${m}$$), 6) as {m}' for m in V.MEMORY_MODES)} from (select *, {_CUR} as mode from results) group by 1")
def pivot_mean(spark: SparkSession, sf: str) -> DataFrame:
    return A.pivot_mean(results(spark, sf).withColumn("mode", X.current_mode("memory")), "router", "mode", V.MEMORY_MODES, "accuracy")


_QUAL = ("memory_relevance_score", "retrieval_latency_ms", "retrieved_context_length")


@query(f"select mode, metric, count(v)::bigint as n, round(avg(v), 6) as mean, round(median(v), 6) as median, min(v) as low, max(v) as high from (select {_CUR} as mode, unnest([{', '.join(f'{{metric: $${c}$$, v: {num(c)}}}' for c in _QUAL)}], recursive := true) from results) group by 1, 2")
def memory_quality_stats(spark: SparkSession, sf: str) -> DataFrame:
    return A.describe_by(results(spark, sf).withColumn("mode", X.current_mode("memory")), ["mode"], _QUAL)


@query("select router, model_used, n, round(n / sum(n) over (partition by router), 6) as share from (select router, model_used, count(*)::bigint as n from results where model_used is not null group by 1, 2)")
def value_share(spark: SparkSession, sf: str) -> DataFrame:
    return A.value_share(results(spark, sf), "router", "model_used")


_RATES = "count(*)::bigint as n, round(avg(json_valid::int::double), 6) as json_rate, round(avg(schema_valid::int::double), 6) as schema_rate, round(avg(coalesce(lower(predicted_category) = 'miscellaneous', false)::int::double), 6) as fallback_rate"


@query(f"""select null::varchar as model, null::varchar as router, 'all' as "grouping", {_RATES} from results union all select model, null, 'model', {_RATES} from results group by 1 union all select null, router, 'router', {_RATES} from results group by router""")
def compliance_grouping_sets(spark: SparkSession, sf: str) -> DataFrame:
    return A.compliance(results(spark, sf))


def _summary_sql(by: str) -> str:
    return f"""select {by}, count(*)::bigint as n, {avg('accuracy')}, {avg('groundedness')}, {avg('latency_ms')}, {avg('cost_usd')}, round(avg(coalesce(lower(model_used) = 'slm', false)::int), 6) as slm_share,
round(avg(coalesce(kb_attached, false)::int), 6) as kb_rate, count(distinct ticket_id)::bigint as tickets from results group by 1"""


def _summary(spark: SparkSession, sf: str, by: str) -> DataFrame:
    return results(spark, sf).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), *(A.mean(c).alias(c) for c in ("accuracy", "groundedness", "latency_ms", "cost_usd")), A.share(F.lower("model_used") == "slm").alias("slm_share"),
        A.share(F.col("kb_attached")).alias("kb_rate"), F.countDistinct("ticket_id").alias("tickets"),
    )


@query(_summary_sql("router"))
def summary_by_router(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, sf, "router")


@query(_summary_sql("memory"))
def summary_by_memory(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, sf, "memory")


@query(_summary_sql("model_used"))
def summary_by_model_used(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(spark, sf, "model_used")


@query(f"select model, router, {avg('accuracy')}, round(avg(case when router is not null then {num('router_confidence_score')} end), 6) as confidence from results group by 1, 2")
def model_router_means(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).groupBy("model", "router").agg(A.mean("accuracy").alias("accuracy"), F.round(F.avg(F.when(F.col("router").isNotNull(), R.number("router_confidence_score"))), 6).alias("confidence"))


@query("select 'results' as name, count(distinct ticket_id)::bigint as n from results")
def distinct_count(spark: SparkSession, sf: str) -> DataFrame:
    return results(spark, sf).agg(F.countDistinct("ticket_id").alias("n")).select(F.lit("results").alias("name"), "n")


_PAIR = f"{sql_strip('coalesce(gold_category, $$$$)')} <> '' and {sql_strip('coalesce(predicted_category, $$$$)')} <> ''"


@query(f"select classifier_mode, gold, predicted, n, round(n / sum(n) over (partition by classifier_mode, gold), 6) as row_share from (select classifier_mode, lower(gold_category) as gold, lower(predicted_category) as predicted, count(*)::bigint as n from results where {_PAIR} group by 1, 2, 3)")
def confusion_long(spark: SparkSession, sf: str) -> DataFrame:
    r = results(spark, sf).withColumn("g", F.lower("gold_category")).withColumn("p", F.lower("predicted_category"))
    return A.confusion(r, "g", "p", ["classifier_mode"])


_LABELS = "(values " + ", ".join(f"('{x.lower()}')" for x in V.LABELS) + ") lab(gold)"


@query(f"""with c as (select lower(gold_category) as gold, count(*)::bigint as total, coalesce(sum((lower(gold_category) = lower(predicted_category))::int), 0)::bigint as correct from results group by 1)
select gold, coalesce(total, 0) as total, coalesce(correct, 0) as correct, round(coalesce(correct / nullif(total, 0), 0e0), 6) as accuracy from {_LABELS} left join c using (gold)""")
def per_class_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    r = results(spark, sf).withColumn("g", F.lower("gold_category")).withColumn("p", F.lower("predicted_category"))
    labels = spark.createDataFrame([(x.lower(),) for x in V.LABELS], "gold string")
    return A.class_accuracy(r, "g", "p", labels=labels)


@query("""with m as (select classifier_mode, avg(coalesce(lower(gold_category) = lower(predicted_category), false)::int) as a from results where gold_category is not null and predicted_category is not null group by 1)
select 'mode' as level, classifier_mode, round(a, 6) as accuracy from m union all select 'mean', null, round(avg(a), 6) from m""")
def accuracy_across_modes(spark: SparkSession, sf: str) -> DataFrame:
    r = results(spark, sf).filter("gold_category is not null and predicted_category is not null")
    m = r.groupBy("classifier_mode").agg(F.avg((F.lower("gold_category") == F.lower("predicted_category")).cast("int")).alias("a"))
    mean = m.agg(F.round(F.avg("a"), 6).alias("accuracy")).select(F.lit("mean").alias("level"), F.lit(None).cast("string").alias("classifier_mode"), "accuracy")
    return m.select(F.lit("mode").alias("level"), "classifier_mode", F.round("a", 6).alias("accuracy")).unionByName(mean)


_EDGES = list(zip(V.CALIBRATION_EDGES, V.CALIBRATION_EDGES[1:]))


@query(f"""with b(low, high) as (values {', '.join(f'({a}e0, {z}e0)' for a, z in _EDGES)}), g as (select distinct classifier_mode from results)
select g.classifier_mode, low, high, count(c)::bigint as n, round(avg(c), 6) as mean_confidence, round(avg(y), 6) as accuracy from g cross join b left join (select classifier_mode, {num('classifier_confidence')} as c, {num('classifier_accuracy')} as y from results) r
on r.classifier_mode is not distinct from g.classifier_mode and c >= low and c < high group by 1, 2, 3""")
def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    return A.calibration(results(spark, sf), "classifier_mode", "classifier_confidence", "classifier_accuracy", V.CALIBRATION_EDGES)


@query(f"""with r as (select {num('classifier_confidence')} as c, {num('classifier_accuracy')} as y from results), t(threshold) as (values {', '.join(f'({x}e0)' for x in V.COVERAGE_THRESHOLDS)})
select threshold, count(*) filter (where c >= threshold)::bigint as n, round(count(*) filter (where c >= threshold) / count(*)::double, 6) as coverage, round(avg(y) filter (where c >= threshold), 6) as accuracy from r, t where c is not null group by 1""")
def coverage_curve(spark: SparkSession, sf: str) -> DataFrame:
    return A.coverage(results(spark, sf), "classifier_confidence", "classifier_accuracy", V.COVERAGE_THRESHOLDS)


@query("""with p as (select lower(gold_category) as g, lower(predicted_category) as p from results where gold_category is not null and predicted_category is not null),
l as (select g as label from p union select p from p), s as (select label, (select count(*) from p where g = label) as gold, (select count(*) from p where p.p = label) as pred, (select count(*) from p where g = label and p.p = label) as tp from l)
select round(sum(tp) / sum(gold), 6) as accuracy, round(avg(2 * tp / (gold + pred)::double), 6) as macro_f1 from s""")
def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return A.macro_f1(results(spark, sf).withColumn("g", F.lower("gold_category")).withColumn("p", F.lower("predicted_category")), "g", "p")


@query(f"""with c as (select label, count(*) as n from tickets join ({sql_labels('tickets', 'topic_group')}) on raw = topic_group where label is not null group by 1), t as (select sum(n) as total, count(*) as k from c)
select l.label, coalesce(n, 0)::bigint as n, round(coalesce(total / (k * n)::double * case l.label when 'HR Support' then 1.3e0 when 'Purchase' then 1.1e0 when 'Administrative rights' then 1.1e0 else 1e0 end, 1e0), 6) as weight from (select column0 as label from (values {', '.join(f'($${x}$$)' for x in V.LABELS)}) v(column0)) l left join c on c.label = l.label, t""")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    labels = spark.createDataFrame([(x,) for x in V.LABELS], "label string")
    known = table(spark, sf, "tickets").select(X.canonical_label("topic_group").alias("topic_group"))  # what maps to no label is null and counts nowhere
    return A.class_weights(known, "topic_group", labels, {"HR Support": 1.3, "Purchase": 1.1, "Administrative rights": 1.1})


def _hist_sql(c: str, bins: int) -> str:
    return f"""with v as (select {num(c)} as v from results where {num(c)} is not null), r as (select min(v) as lo, (max(v) - min(v)) / {bins} as w from v)
select bin, round(lo + bin * w, 6) as low, round(lo + (bin + 1) * w, 6) as high, n from (select least(coalesce(floor((v - lo) / nullif(w, 0)), 0), {bins - 1})::int as bin, lo, w, count(*)::bigint as n from v, r group by 1, 2, 3)"""


@query(_hist_sql("groundedness", 10))
def histogram_groundedness(spark: SparkSession, sf: str) -> DataFrame:
    return A.histogram(results(spark, sf), "groundedness", 10)


@query(_hist_sql("latency_ms", 20))
def histogram_latency(spark: SparkSession, sf: str) -> DataFrame:
    return A.histogram(results(spark, sf), "latency_ms", 20)


@query(f"select router, round(quantile_cont({num('groundedness')}, 0.25), 6) as q1, round(quantile_cont({num('groundedness')}, 0.5), 6) as median, round(quantile_cont({num('groundedness')}, 0.75), 6) as q3, round(avg({num('groundedness')}), 6) as mean from results group by 1")
def quartiles(spark: SparkSession, sf: str) -> DataFrame:
    return A.quartiles(results(spark, sf), "router", "groundedness")


@query()
def anova_two_way(spark: SparkSession, sf: str) -> DataFrame:
    return A.anova(results(spark, sf), "router", "model_used", "groundedness")


_UNIT = "(select label, list(m / (sqrt(ss) + 1e-9) order by pos) as centroid, max(n)::bigint as n from (select *, sum(m * m) over (partition by label) as ss from (select label, pos, avg(x) as m, count(*) as n from (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings) group by 1, 2)) group by 1)"


@query(f"select label, n, pos::int as pos, round(x, 6) as x from (select label, n, unnest(centroid) as x, generate_subscripts(centroid, 1) - 1 as pos from {_UNIT})")
def centroids(spark: SparkSession, sf: str) -> DataFrame:
    c = classify.centroids(table(spark, sf, "embeddings"), "label", "embedding")
    return c.select("label", "n", F.posexplode("centroid").alias("pos", "x")).withColumn("x", F.round("x", 6))


_PROBS = f"""(with c as {_UNIT}, e as (select vec_id, label as gold, list_transform(embedding, lambda x: x::double) as v from embeddings),
s as (select vec_id, gold, c.label, list_dot_product(v, centroid) / (sqrt(list_dot_product(v, v)) + 1e-9) as cos from e, c)
select vec_id, gold, label, round(exp(cos - mx) / sum(exp(cos - mx)) over (partition by vec_id), 6) as p from (select *, max(cos) over (partition by vec_id) as mx from s))"""


@query(f"select vec_id, label, p from {_PROBS}")
def softmax_probs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return classify.classify_by_centroid(e, "vec_id", "embedding", classify.centroids(e, "label", "embedding"))


@query(f"with p as {_PROBS} select vec_id, label as predicted, p as confidence from p qualify row_number() over (partition by vec_id order by p desc, label) = 1")
def centroid_classify(spark: SparkSession, sf: str) -> DataFrame:
    return classify.argmax(softmax_probs(spark, sf), "vec_id")


@query(f"with p as {_PROBS}, b as (select vec_id, gold, label as predicted from p qualify row_number() over (partition by vec_id order by p desc, label) = 1) select gold, count(*)::bigint as total, sum((gold = predicted)::int)::bigint as correct, round(avg((gold = predicted)::int), 6) as accuracy from b group by 1")
def centroid_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return A.class_accuracy(centroid_classify(spark, sf).join(e.select("vec_id", F.col("label").alias("g")), "vec_id"), "g", "predicted")


_SIM = f"(with c as {_UNIT} select a.label as a, b.label as b, round(list_dot_product(a.centroid, b.centroid) / ((sqrt(list_dot_product(a.centroid, a.centroid)) + 1e-9) * (sqrt(list_dot_product(b.centroid, b.centroid)) + 1e-9)), 6) as cosine from c a, c b where a.label <> b.label)"


@query(f"select * from {_SIM}")
def centroid_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return classify.centroid_similarity(classify.centroids(table(spark, sf, "embeddings"), "label", "embedding"))


@query(f"select round(avg(cosine), 5) as mean_cosine, min(cosine) as low, max(cosine) as high from {_SIM}")
def centroid_spread(spark: SparkSession, sf: str) -> DataFrame:
    return centroid_similarity(spark, sf).agg(F.round(F.avg("cosine"), 5).alias("mean_cosine"), F.min("cosine").alias("low"), F.max("cosine").alias("high"))


@query("""with l as (select vec_id, (generate_subscripts(embedding, 1) - 1)::int as pos, unnest(embedding)::double as x from embeddings), s as (select pos, avg(x) as m, stddev_pop(x) as d from l group by 1)
select vec_id, pos, round((x - m) / case when d > 1e-6 then d else 1e0 end, 4) as z from l join s using (pos)""")
def feature_standardise(spark: SparkSession, sf: str) -> DataFrame:
    return classify.standardised(table(spark, sf, "embeddings"), "vec_id", "embedding", digits=4)


@query()
def tfidf_classify(spark: SparkSession, sf: str) -> DataFrame:
    """The TF-IDF model, trained on the labelled gold set (a table that doesn't grow), on all documents."""
    train = table(spark, sf, "gold_audit").filter("ticket_text is not null and topic_group is not null").select(F.col("ticket_text").alias("text"), F.col("topic_group").alias("label"))
    model, names = classify.tfidf_model(train, "text", "label")
    shown = F.element_at(F.array(*(F.lit(n) for n in names), F.lit(None).cast("string")), F.col("prediction").cast("int") + 1)
    return model.transform(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", shown.alias("predicted"))


_JSON = "case json_type(case when json_valid(props) then props end) when 'OBJECT' then 'object' when 'ARRAY' then 'array' else case when json_valid(props) then 'scalar' end end"


@query(f"select event_id, {_JSON} as kind, coalesce({_JSON} = 'object' and json_exists(case when json_valid(props) then props end, '$.k'), false)::int as has_key, try_cast(json_extract_string(case when json_valid(props) then props end, '$.k') as bigint) as k from events")
def json_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", R.json_kind("props").alias("kind"), R.has_keys("props", ["k"]).alias("has_key"), F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))


@query("""select event_id, fragment, case when json_valid(fragment) and json_type(fragment) = 'OBJECT' then try_cast(json_extract_string(fragment, '$.k') as bigint) end as k
from (select event_id, nullif(regexp_extract('noise ' || props || ' tail', '(?s)(\\{.*\\})', 1), '') as fragment from events)""")
def json_fragment(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("raw", F.concat(F.lit("noise "), "props", F.lit(" tail")))
    return e.select("event_id", R.fragment("raw").alias("fragment"), F.get_json_object(R.parsed_object("raw"), "$.k").try_cast("bigint").alias("k"))


@query(f"""with r as (select result_id, chunk_no, router, {sql_strip('router')} as rs, predicted_category as p, {num('classifier_confidence')} as c, latency_ms from results)
select result_id, chunk_no, concat_ws('; ', case when router is null then 'Missing field: router' end, case when rs = '' then 'Field router is empty' end, case when p is null then 'Missing field: predicted_category' end,
case when c is null or c < 0 or c > 1 then 'confidence must be between 0 and 1' end) as errors from r""")
def contract_errors(spark: SparkSession, sf: str) -> DataFrame:
    fields = {"router": F.col("router"), "predicted_category": F.col("predicted_category")}
    rules = [r for r in R.text_field_rules(fields) if r[1] != "Field predicted_category is empty"] + [R.range_rule("confidence", R.number("classifier_confidence"), 0.0, 1.0)]
    return results(spark, sf).select("result_id", "chunk_no", F.array_join(R.messages(*rules), "; ").alias("errors"))


@query(f"select case when {num('classifier_confidence')} between 0 and 1 then 'valid' else 'quarantine' end as part, count(*)::bigint as n from results group by 1")
def quarantine_split(spark: SparkSession, sf: str) -> DataFrame:
    r = results(spark, sf).select("result_id", R.messages(R.range_rule("confidence", R.number("classifier_confidence"), 0.0, 1.0)).alias("errors"))
    good, bad = guards.quarantine(r, "errors")
    count = lambda d, name: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return count(good, "valid").unionByName(count(bad, "quarantine"))


_LEN, _CONF = "length(coalesce(document, ''))", "(case when document is null then 0.2e0 else 0.6e0 end)"


@query(f"""select ticket_id, received_at, coalesce(nullif(concat_ws(' + ', case when {_LEN} >= 512 then 'long_text' end, case when lower(trim(topic_group)) in ('security', 'compliance', 'hardware') then 'listed_category' end, case when {_CONF} < 0.3 then 'low_confidence' end), ''), 'none') as reasons,
round(least(greatest(1 - {_CONF} + case when lower(trim(topic_group)) in ('security', 'compliance', 'hardware') then 0.2e0 else 0e0 end + case when {_LEN} > 512 then 0.1e0 else 0e0 end, 0), 1), 6) as risk from tickets""")
def rule_triggers(spark: SparkSession, sf: str) -> DataFrame:
    size, conf = F.length(F.coalesce("document", F.lit(""))), F.when(F.col("document").isNull(), F.lit(0.2)).otherwise(F.lit(0.6))
    listed = F.coalesce(F.lower(F.trim("topic_group")).isin("security", "compliance", "hardware"), F.lit(False))
    risk = R.clamp(1 - conf + F.when(listed, F.lit(0.2)).otherwise(F.lit(0.0)) + F.when(size > 512, F.lit(0.1)).otherwise(F.lit(0.0)))
    reasons = R.triggers({"long_text": size >= 512, "listed_category": listed, "low_confidence": conf < 0.3}, "none")
    return table(spark, sf, "tickets").select("ticket_id", "received_at", reasons.alias("reasons"), F.round(risk, 6).alias("risk"))


def _g(f: str) -> str:
    return sql_strip(f"coalesce(gold_resolution.{f}, $$$$)")


def _l(f: str) -> str:
    return f"list_filter(list_transform(coalesce(gold_resolution.{f}, []), lambda s: {sql_strip('s')}), lambda s: s is not null and s <> '')"


@query(f"""with g as (select ticket_index, {_g('summary')} as s, {_g('escalation_reason')} as r, coalesce(gold_resolution.escalation_required, false) as e, {_l('steps')} as steps, {_l('kb_policies')} as pol, {_l('acceptance_criteria')} as acc, (select list(id) from kb_articles) as ids from gold_audit)
select ticket_index, concat_ws(',', case when length(s) < 8 then 'short_summary' end, case when len(steps) < 3 then 'few_steps' end, case when len(acc) < 1 then 'no_acceptance_criteria' end, case when len(pol) = 0 then 'no_policies' end,
case when len(list_filter(pol, lambda x: not list_contains(ids, x))) > 0 then 'unknown_policies' end, case when len(list_distinct(pol)) < len(pol) then 'repeated_policies' end,
case when e and r = '' then 'escalation_without_reason' end, case when not e and r <> '' then 'reason_without_escalation' end) as reasons from g""")
def gold_validate(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "kb_articles").agg(F.collect_set("id").alias("ids"))  # the articles are a table that doesn't grow
    g = table(spark, sf, "gold_audit").select("ticket_index", gold.normal_resolution("gold_resolution").alias("g")).join(F.broadcast(ids))
    return g.select("ticket_index", F.array_join(gold.review_reasons("g", F.col("ids")), ",").alias("reasons"))


@query(f"""with b as (select count(*)::bigint as total_records, sum(coalesce(needs_human_review, false)::int)::bigint as review_queue, round(avg(coalesce(len(gold_resolution.steps), 0)), 6) as avg_steps, round(avg(coalesce(len(gold_resolution.acceptance_criteria), 0)), 6) as avg_criteria,
round(100 * avg(coalesce(gold_resolution.escalation_required, false)::int), 6) as escalation_percent, round(100 * avg((length({_g('summary')}) < 8)::int), 6) as short_summary_percent from gold_audit),
p as (select v, count(*) as n from (select unnest(gold_resolution.kb_policies) as v from gold_audit) group by 1), u as (select coalesce(sum(n), 0)::bigint as policy_refs, count(*)::bigint as policies_used, coalesce(max(n), 0) as top_n from p), k as (select count(*)::bigint as kb_size from kb_articles)
select b.*, policy_refs, policies_used, kb_size, round(policies_used / kb_size::double, 6) as unique_policy_ratio, round(top_n / greatest(policy_refs, 1)::double, 6) as top_policy_share from b, u, k""")
def gold_audit(spark: SparkSession, sf: str) -> DataFrame:
    return gold.audit(table(spark, sf, "gold_audit"), table(spark, sf, "kb_articles"))


@query("select v as value, count(*)::bigint as n from (select unnest(gold_resolution.kb_policies) as v from gold_audit) group by 1 order by 2 desc, 1 limit 10")
def top_policies(spark: SparkSession, sf: str) -> DataFrame:
    return gold.list_counts(table(spark, sf, "gold_audit"), "gold_resolution.kb_policies", 10)


@query("select v as value, count(*)::bigint as n from (select unnest(review_reasons) as v from gold_audit) group by 1")
def review_reason_counts(spark: SparkSession, sf: str) -> DataFrame:
    return gold.list_counts(table(spark, sf, "gold_audit"), "review_reasons")


@query(f"""with a as (select count(*) as n, avg(coalesce(len(gold_resolution.steps), 0)) as s, avg((length({_g('summary')}) < 8)::int) as p from gold_audit) select case when not coalesce(n >= 100, false) then 2 when not coalesce(s >= 1, false) then 3 when not coalesce(p * 100 <= 5, false) then 4 else 0 end as code from a""")
def threshold_gate(spark: SparkSession, sf: str) -> DataFrame:
    a = gold.audit(table(spark, sf, "gold_audit"), table(spark, sf, "kb_articles"))
    return a.select(gold.gate([(F.col("total_records") >= 100, 2), (F.col("avg_steps") >= 1, 3), (F.col("short_summary_percent") <= 5, 4)]).alias("code"))


@query("select topic_group, count(*)::bigint as n from tickets group by 1")
def label_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tickets").groupBy("topic_group").agg(F.count(F.lit(1)).alias("n"))


@query("select topic_group, ticket_id, received_at, rk::int as rk from (select *, row_number() over (partition by topic_group order by received_at, ticket_id) as rk from tickets) where rk <= 3")
def first_n_per_label(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.first_per_group(table(spark, sf, "tickets"), "topic_group", [F.col("received_at"), F.col("ticket_id")], 3).select("topic_group", "ticket_id", "received_at", "rk")


_ORDER = "md5('s|' || doc_id::varchar), doc_id"


@query(f"select source, doc_id, rk::int as rk from (select source, doc_id, row_number() over (partition by source order by {_ORDER}) as rk, 10 + length(source) as target from documents where source is not null) where rk <= target")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter("source is not null")
    targets = d.select("source").distinct().withColumn("target", F.lit(10) + F.length("source"))
    return sampling.stratified(d.select("source", "doc_id"), "source", "doc_id", targets)


@query(f"select doc_id, case when row_number() over (partition by source order by {_ORDER}) <= floor(count(*) over (partition by source) * 0.8e0) then 'train' else 'validation' end as part from documents")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.train_split(table(spark, sf, "documents"), "source", "doc_id").select("doc_id", "part")


@query("""select ticket_index, router, mode, model from gold_audit, (select unnest(['hybrid', 'llm_first', 'slm_dominant']) as router), (select unnest(['none', 'rag_dense', 'rag_bm25', 'rag_hybrid']) as mode), (select unnest(['slm1', 'slm2', 'llm1', 'llm2']) as model)""")
def grid_cross(spark: SparkSession, sf: str) -> DataFrame:
    dims = {"router": ("hybrid", "llm_first", "slm_dominant"), "mode": V.MEMORY_MODES, "model": ("slm1", "slm2", "llm1", "llm2")}
    return grid.cells(table(spark, sf, "gold_audit").select("ticket_index"), dims)


_TOK = lambda c: f"list_distinct({sql_tokens(f'lower({c})')})"


@query(f"""select ticket_index, (topic_group = topic_group and topic_group not in ('unknown', 'other'))::int::double as accuracy,
round(case when needs_human_review then coalesce(list_max(list_transform(gold_resolution.steps, lambda s: case when len({_TOK('s')}) = 0 then 0e0 else len(list_intersect({_TOK('ticket_text')}, {_TOK('s')})) / len({_TOK('s')})::double end)), 0e0) else 0e0 end, 6) as groundedness, 0 as schema_validity from gold_audit where topic_group is not null""")
def grid_metrics(spark: SparkSession, sf: str) -> DataFrame:
    g = table(spark, sf, "gold_audit").filter("topic_group is not null").withColumn("steps", F.col("gold_resolution.steps"))
    return grid.metrics(g, "ticket_text", "topic_group", "topic_group", "steps", "needs_human_review").select("ticket_index", "accuracy", "groundedness", "schema_validity")


@query("select case when chunk_no % 2 = 1 then 'a' else 'b' end as part, result_id from results")
def union_strict(spark: SparkSession, sf: str) -> DataFrame:
    """All chunks: those of odd chunk_no as part a, all others (even or null) as part b."""
    odd = F.coalesce(F.col("chunk_no") % 2 == 1, F.lit(False))
    return guards.union_strict([results(spark, sf).filter(c).select(F.lit(p).alias("part"), "result_id") for c, p in ((odd, "a"), (~odd, "b"))])


@query("select distinct topic_group as raw from tickets where topic_group is not null and lower(topic_group) not in (select variant_text from label_variants)")
def unexpected_labels(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "tickets").select(F.lower("topic_group").alias("v"), F.col("topic_group").alias("raw")).filter("raw is not null")
    known = table(spark, sf, "label_variants").select(F.col("variant_text").alias("v"))
    return t.distinct().join(known, "v", "left_anti").select("raw")


@query("select router, 0 as retries, coalesce(nullif(predicted_category, ''), llm_category, 'unknown') as final_category, count(*)::bigint as n from results group by 1, 2, 3")
def conform_and_defaults(spark: SparkSession, sf: str) -> DataFrame:
    r = guards.conform(results(spark, sf), [*V.RESULT_COLUMNS, ("retries", "int")], {"retries": 0})
    return r.groupBy("router", "retries", X.first_non_empty("predicted_category", F.coalesce("llm_category", F.lit("unknown"))).alias("final_category")).agg(F.count(F.lit(1)).alias("n"))
