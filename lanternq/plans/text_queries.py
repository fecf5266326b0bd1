"""Queries of the text functions, labels, filters and article parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternq.functions import records as R
from lanternq.functions import text as X
from lanternq.functions import vocabulary as V
from lanternq.operators import classify, guards, sampling
from lanternq.plans.registry import query, quoted, table
from lanternq.sources import readers

WS = "[\\s\\x1c-\\x1f\\x85\\p{Z}]"  # as functions.text.SPACE


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def sql_tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({c}, ''), '{WS}+'), lambda x: x <> '')"


def sql_words(c: str) -> str:
    return f"list_transform(regexp_extract_all(coalesce({c}, ''), '[A-Za-z0-9_]+'), lambda x: lower(x))"


def sql_squeeze(c: str) -> str:
    return f"array_to_string({sql_tokens(f'replace(lower({c}), $$_$$, $$ $$)')}, ' ')"


def sql_groups(c: str, groups, default: str) -> str:
    whens = " ".join("when " + " or ".join(f"contains({c}, '{w}')" for w in ws) + f" then '{name}'" for name, ws in groups)
    return f"case {whens} else {default} end"


SYN = "(values " + ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(V.SYNONYMS)) + ") syn(ord, word, label)"
LABEL_VALUES = "(values " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(V.LABELS)) + ") lab(ord, label)"


def sql_labels(table_: str, column: str, where: str = "true") -> str:
    """Distinct raw values with their canonical label (null if none), in join form."""
    return f"""select r.raw, case when r.norm = '' then null else coalesce(
  (select min(label) from {SYN} where word = r.norm), (select min(label) from {LABEL_VALUES} where lower(label) = r.norm),
  (select arg_min(label, ord) from {SYN} where contains(r.norm, word))) end as label
from (select distinct {column} as raw, {sql_squeeze(column)} as norm from {table_} where {where} and {column} is not null) r"""


@query(sql_labels("tickets", "topic_group"))
def label_canon(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "tickets").select(F.col("topic_group").alias("raw")).filter("raw is not null").distinct()
    return raw.select("raw", X.canonical_label("raw").alias("label"))


@query(f"with l as ({sql_labels('tickets', 'topic_group')}) select coalesce(l.label, 'Miscellaneous') as label, count(*)::bigint as n from tickets t left join l on l.raw = t.topic_group group by 1")
def label_or_fallback_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tickets").groupBy(X.label_or_fallback("topic_group").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with l as ({sql_labels('results', 'llm_category')}) select raw, coalesce(label, {sql_strip('raw')}) as label from l")
def label_or_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "results").select(F.col("llm_category").alias("raw")).filter("raw is not null").distinct().select("raw", X.label_or_text("raw").alias("label"))


_CTX = f"{sql_strip('''regexp_replace(lower(coalesce(topic_group, '')), '[^a-z0-9\\s_-]', ' ', 'g')''')}"


@query(f"""with b as (select ticket_id, received_at, {_CTX} as t, {sql_strip(f"concat_ws(' ', {_CTX}, lower(coalesce(document, '')))")} as c from tickets),
g as (select *, {sql_groups('c', V.CATEGORY_GROUPS, 'null')} as k from b), l as ({sql_labels('b', 't')})
select ticket_id, received_at, coalesce(k, l.label, 'Miscellaneous') as category from g left join l on l.raw = g.t""")
def category_of_ticket(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "tickets").select("ticket_id", "received_at", X.category("topic_group", "document").alias("category"))


@query(f"select doc_id, {sql_groups('lower(coalesce(text, $$$$))', V.TEXT_GROUPS, '$$Miscellaneous$$')} as category, {sql_groups('lower(coalesce(text, $$$$))', V.SHORT_GROUPS, '$$miscellaneous$$')} as short from documents")
def category_of_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.category_of_text("text").alias("category"), X.short_category("text").alias("short"))


@query("select id, trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_') as slug from kb_articles")
def slugs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "kb_articles").select("id", X.slug("title").alias("slug"))


@query(f"""select doc_id, len({sql_words('text')})::int as words, len({sql_tokens('text')})::int as tokens,
round(case when len({sql_tokens('text')}) = 0 then 0e0 else len(list_distinct({sql_tokens('text')})) / len({sql_tokens('text')})::double end, 6) as unique_ratio,
len({sql_tokens('text')}) < 10 as is_short from documents""")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(X.words("text")).alias("words"), F.size(X.tokens("text")).alias("tokens"), F.round(X.unique_ratio("text"), 6).alias("unique_ratio"), X.is_short("text").alias("is_short"))


_MODE = f"coalesce(nullif(lower({sql_strip('memory')}), ''), 'unknown')"


@query(f"select memory, {_MODE} as mode, case {_MODE} when 'rag' then 'rag_dense' when 'salience' then 'rag_hybrid' else {_MODE} end as current_mode, count(*)::bigint as n from results group by memory")
def memory_modes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "results").groupBy("memory").agg(F.count(F.lit(1)).alias("n")).select("memory", X.mode("memory").alias("mode"), X.current_mode("memory").alias("current_mode"), "n")


@query("select doc_id, case when length(text) > 300 then left(text, 300) || '...' else text end as excerpt from documents")
def excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.excerpt("text").alias("excerpt"))


PHRASES = ("as an ai", "cannot help", "contact support", "thank you")


@query(f"select doc_id, {' or '.join(f'contains(lower(coalesce(text, $$$$)), $${p}$$)' for p in PHRASES)} as mentions from documents")
def phrase_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", X.mentions("text", PHRASES).alias("mentions"))


@query(f"""select ticket_index, s.step, not ({' or '.join(f'contains(lower(s.step), $${p}$$)' for p in PHRASES)}) and len({sql_words('s.step')}) >= 2 as actionable
from gold_audit, unnest(gold_resolution.steps) as s(step) where s.step is not null""")
def actionable_steps(spark: SparkSession, sf: str) -> DataFrame:
    steps = table(spark, sf, "gold_audit").select("ticket_index", F.explode("gold_resolution.steps").alias("step")).filter("step is not null")
    return steps.select("ticket_index", "step", X.is_actionable("step", PHRASES).alias("actionable"))


@query("""select result_id, chunk_no, greatest(floor(coalesce(length(memory_context_used), 0) * 0.25e0)::bigint, 0) as context_tokens,
greatest(floor((coalesce(length(memory_context_used), 0) + coalesce(length(result), 0)) * 0.25e0)::bigint, 1) as call_tokens from results""")
def token_estimates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "results").select("result_id", "chunk_no", X.token_estimate("memory_context_used").alias("context_tokens"), X.token_estimate("memory_context_used", "result", least=1).alias("call_tokens"))


@query("""select result_id, chunk_no, case when c is null then null when c >= 0.8e0 then 'high' when c >= 0.5e0 then 'medium' else 'low' end as bucket,
round(case when classifier_token_cost <= 0 then 1e0 else classifier_accuracy / classifier_token_cost end, 6) as efficiency
from (select *, case when isnan(classifier_confidence) then null else classifier_confidence end as c from results)""")
def confidence_buckets(spark: SparkSession, sf: str) -> DataFrame:
    cost = F.col("classifier_token_cost")
    return table(spark, sf, "results").select(
        "result_id", "chunk_no", R.band(R.number("classifier_confidence"), ((0.8, "high"), (0.5, "medium")), "low").alias("bucket"),
        F.round(F.when(cost <= 0, F.lit(1.0)).otherwise(F.try_divide("classifier_accuracy", cost)), 6).alias("efficiency"),
    )


_HITS = ", ".join(f"({' + '.join(f'contains(t, $${w}$$)::int' for w in V.PRIOR_KEYWORDS[k])}) * {V.PRIOR_WEIGHTS.get(k, 1.0)}e0 as h{i}" for i, k in enumerate(V.LABELS))
_SUM = " + ".join(f"h{i}" for i in range(len(V.LABELS)))
_DAMP = [0.5 if k == V.FALLBACK else 1.0 for k in V.LABELS]


@query(f"""with h as (select doc_id, {_HITS} from (select doc_id, lower(coalesce(text, '')) as t from documents)),
r as (select doc_id, {_SUM} as total, unnest([{', '.join(f'{{label: $${k}$$, raw: (h{i} + 1e-6) * {d}e0}}' for i, (k, d) in enumerate(zip(V.LABELS, _DAMP)))}], recursive := true) from h)
select doc_id, label, round(case when total > 0 then raw / sum(raw) over (partition by doc_id) else 0.125e0 end, 6) as p from r""")
def keyword_prior(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "documents").select("doc_id", classify.prior("text").alias("p"))
    names = F.array(*(F.lit(k) for k in V.LABELS))
    return p.select("doc_id", F.explode(F.arrays_zip(names.alias("label"), "p")).alias("z")).select("doc_id", F.col("z.label").alias("label"), F.round("z.p", 6).alias("p"))


@query()
def heuristic_labels(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", classify.heuristic("text").alias("p"))
    best = classify.best_label(F.col("p"))
    return d.select("doc_id", best.alias("first"), classify.override_fallback("text", best).alias("label"), F.round(F.array_max("p"), 6).alias("confidence"))


@query(f"select ticket_id, received_at, document as text, topic_group as label from tickets where {sql_strip('coalesce(document, $$$$)')} <> '' and {sql_strip('coalesce(topic_group, $$$$)')} <> ''")
def clean_filter(spark: SparkSession, sf: str) -> DataFrame:
    t = guards.rename_aliases(guards.tidy_names(table(spark, sf, "tickets")), readers.TICKET_ALIASES)
    return t.filter(~X.is_blank("text") & ~X.is_blank("label")).select("ticket_id", "received_at", "text", "label")


@query("select doc_id, n_chars from documents order by doc_id limit 50 offset 20")
def slice_offset_limit(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.cut(table(spark, sf, "documents").select("doc_id", "n_chars"), [F.col("doc_id")], 20, 50)


@query("select id, coalesce(nullif(summary, ''), nullif(content, ''), nullif(title, ''), '') as text, coalesce(nullif(path, ''), nullif(id, ''), '') as source from kb_articles")
def hit_coercion(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "kb_articles").select("id", X.first_non_empty("summary", "content", "title").alias("text"), X.first_non_empty("path", "id").alias("source"))


_ERR = "select result_id, chunk_no, router, memory, model, model_used, accuracy, latency_ms"


@query("select result_id, chunk_no, model from results where lower(trim(router)) in ('slm_dominant', 'llm_first') and model in ('slm1', 'llm1')")
def config_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "results").filter(F.lower(F.trim("router")).isin("slm_dominant", "llm_first") & F.col("model").isin("slm1", "llm1")).select("result_id", "chunk_no", "model")


@query("""with l as (select id, unnest(string_split_regex(content, '\\r?\\n')) as line, generate_subscripts(string_split_regex(content, '\\r?\\n'), 1) - 1 as pos from kb_articles where content is not null),
m as (select *, starts_with(line, '# ') as is_title, starts_with(line, '## ') as is_head from l),
s as (select *, sum((is_title or is_head)::int) over (partition by id order by pos rows unbounded preceding) as section,
 last_value(case when is_head then trim(substr(line, 4)) when is_title then '' end ignore nulls) over (partition by id order by pos rows unbounded preceding) as heading from m)
select id, section::bigint as section, heading, trim(string_agg(line, chr(10) order by pos), chr(10) || ' ') as body from s where heading <> '' and not is_head group by 1, 2, 3""")
def article_sections(spark: SparkSession, sf: str) -> DataFrame:
    return readers.markdown_sections(table(spark, sf, "kb_articles").select("id", "content").filter("content is not null"), "id", "content")


@query("""with l as (select id, unnest(string_split_regex(content, '\\r?\\n')) as line, generate_subscripts(string_split_regex(content, '\\r?\\n'), 1) - 1 as pos from kb_articles where content is not null),
m as (select *, starts_with(line, '# ') as is_title, starts_with(line, '## ') as is_head from l),
s as (select *, sum((is_title or is_head)::int) over (partition by id order by pos rows unbounded preceding) as section,
 last_value(case when is_head then trim(substr(line, 4)) when is_title then '' end ignore nulls) over (partition by id order by pos rows unbounded preceding) as heading from m),
b as (select id, section, heading, trim(string_agg(line, chr(10) order by pos), chr(10) || ' ') as body from s where heading <> '' and not is_head group by 1, 2, 3)
select id, arg_min(body, section) as notes from b where contains(lower(heading), 'when to escalate') group by 1""")
def section_lookup(spark: SparkSession, sf: str) -> DataFrame:
    s = readers.markdown_sections(table(spark, sf, "kb_articles").select("id", "content").filter("content is not null"), "id", "content")
    return readers.find_section(s, "id", "when to escalate", "notes")


@query("select id, count(*)::bigint as n from kb_articles group by 1 having count(*) > 1")
def duplicate_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "kb_articles").groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("select sha256(string_agg(coalesce(content, ''), '' order by id)) as sha256, count(*)::bigint as n from kb_articles")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return readers.content_hash(table(spark, sf, "kb_articles"), "id", "content")


@query("select doc_id, sha256(coalesce(text, '')) as sha256 from documents")
def row_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return readers.row_hashes(table(spark, sf, "documents"), "doc_id", "text")


@query("select id, list_slice(list_distinct_ordered, 1, 8) as tags from (select id, list_reduce([[]::varchar[]] || list_transform(list_filter(['kb'] || string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '_'), '_'), lambda x: x <> ''), lambda x: [x]), lambda a, x: case when list_contains(a, x[1]) then a else a || x end) as list_distinct_ordered from kb_articles where title is not null)")
def ordered_tags(spark: SparkSession, sf: str) -> DataFrame:
    parts = F.filter(F.concat(F.array(F.lit("kb")), F.split(X.slug("title"), "_")), lambda x: x != "")
    return table(spark, sf, "kb_articles").filter("title is not null").select("id", F.slice(F.array_distinct(parts), 1, 8).alias("tags"))


@query(f"""select ticket_id, received_at, concat_ws(chr(10) || chr(10), nullif('Ticket:' || chr(10) || {sql_strip('document')}, ''), nullif('Source: ' || source, ''), nullif('Split: ' || split_name, '')) as prompt from tickets""")
def prompts(spark: SparkSession, sf: str) -> DataFrame:
    p = X.prompt(F.concat(F.lit("Ticket:\n"), X.strip("document")), F.concat(F.lit("Source: "), F.col("source")), F.concat(F.lit("Split: "), F.col("split_name")))
    return table(spark, sf, "tickets").select("ticket_id", "received_at", p.alias("prompt"))


@query("""select result_id, chunk_no, coalesce(regexp_replace(memory_context_used, '[\\r\\n]', ' ', 'g'), '') as context, coalesce(case when isnan(latency_ms) then null else latency_ms end, -1e0) as latency from results""")
def csv_values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "results").select("result_id", "chunk_no", X.one_line("memory_context_used").alias("context"), F.coalesce(R.number("latency_ms"), F.lit(-1.0)).alias("latency"))


@query()
def letter_vectors(spark: SparkSession, sf: str) -> DataFrame:
    from lanternq.functions import vectors

    t = table(spark, sf, "kb_articles").select("id", vectors.letter_vector("title").alias("v"))
    return t.select("id", F.posexplode("v").alias("pos", "x")).select("id", "pos", F.round("x", 6).alias("x"))
