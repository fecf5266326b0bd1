"""Queries of retrieval and of the ordered memories. Documents are the stated queries where their id is divisible by 100."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternq.functions import text as X
from lanternq.functions import vectors
from lanternq.operators import memory, retrieval
from lanternq.plans.registry import query, table
from lanternq.plans.text_queries import sql_strip, sql_tokens, sql_words


def tickets(spark: SparkSession, sf: str) -> DataFrame:
    """The stated queries: each ticket_id divisible by 100 with its first text."""
    t = table(spark, sf, "tickets").filter(F.col("ticket_id") % 100 == 0)
    return t.groupBy("ticket_id").agg(F.min_by("document", "received_at").alias("document"))


TQ = "(select ticket_id, arg_min(document, received_at) as document from tickets where ticket_id % 100 = 0 and document is not null group by 1)"


def kb(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "kb_articles")


def sql_bm25(queries: str, key: str, text: str, docs: str, doc: str, doc_text: str) -> str:
    return f"""(with d as (select {doc} as doc, {sql_words(doc_text)} as t from {docs}), st as (select count(*) as n, avg(len(t)) as avgdl from d),
tf as (select doc, len(t) as dl, tok, count(*) as tf from (select doc, t, unnest(t) as tok from d) group by 1, 2, 3), df as (select tok, count(*) as df from tf group by 1),
qf as (select q, tok, count(*) as qf from (select {key} as q, unnest({sql_words(text)}) as tok from {queries}) group by 1, 2)
select q, doc, round(sum(qf * ln((n - df + 0.5e0) / (df + 0.5e0) + 1e0) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / greatest(avgdl, 1e-9)))), 6) as score from qf join tf using (tok) join df using (tok), st group by 1, 2)"""


def sql_top(scores: str, k: int = 3) -> str:
    return f"(select q, doc, score, rk::int as rk from (select *, row_number() over (partition by q order by score desc, doc) as rk from {scores} where score > 0) where rk <= {k})"


_BM = sql_bm25(TQ, "ticket_id", "document", "kb_articles", "id", "content")


@query(f"select * from {sql_top(_BM)}")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.bm25_top(tickets(spark, sf), "ticket_id", "document", kb(spark, sf), "id", "content")


@query(f"select * from {sql_top(sql_bm25('(select * from documents where doc_id % 100 = 0)', 'doc_id', 'text', 'documents', 'doc_id', 'text'), 4)}")
def bm25_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return retrieval.bm25_top(d.filter(F.col("doc_id") % 100 == 0), "doc_id", "text", d, "doc_id", "text", k=4)


@query(f"select tok, count(*)::bigint as df from (select distinct doc_id, unnest({sql_words('text')}) as tok from documents) group by 1")
def document_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.document_frequency(table(spark, sf, "documents"), "doc_id", "text")


@query(f"select count(*)::bigint as n_docs, round(avg(len({sql_words('text')})), 6) as avgdl from documents")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.corpus_stats(table(spark, sf, "documents"), "doc_id", "text").select("n_docs", F.round("avgdl", 6).alias("avgdl"))


_LEX = f"""(select q, doc, count(*)::bigint as shared, round(count(*) / n::double, 6) as score from (select ticket_id as q, unnest(list_distinct({sql_tokens('lower(document)')})) as tok from {TQ}) join
(select id as doc, len(t) as n, unnest(t) as tok from (select id, list_distinct({sql_tokens('lower(content)')}) as t from kb_articles)) using (tok) group by q, doc, n)"""


def _lexical(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.lexical_scores(tickets(spark, sf), "ticket_id", "document", kb(spark, sf), "id", "content").withColumn("score", F.round("score", 6))


@query(f"select q, doc, shared, score, rk::int as rk from (select *, row_number() over (partition by q order by score desc, doc) as rk from {_LEX}) where rk <= 3")
def lexical_topk(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.top_k(_lexical(spark, sf), "q", "score", "doc", 3).select("q", "doc", "shared", "score", "rk")


@query(f"select q, doc, shared, rk::int as rk from (select *, row_number() over (partition by q order by shared desc, doc) as rk from {_LEX}) where rk <= 3")
def overlap_rank(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.top_k(_lexical(spark, sf), "q", "shared", "doc", 3).select("q", "doc", "shared", "rk")


_COS = """(with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings)
select a.vec_id as q, b.vec_id as doc, round(list_dot_product(a.v, b.v) / ((sqrt(list_dot_product(a.v, a.v)) + 1e-9) * (sqrt(list_dot_product(b.v, b.v)) + 1e-9)), 6) as score from e a, e b where a.vec_id % 100 = 0)"""


@query(f"select q, doc, score, rk::int as rk from (select *, row_number() over (partition by q order by score desc, doc) as rk from {_COS}) where rk <= 5")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return retrieval.dense_top(e.filter(F.col("vec_id") % 100 == 0), "vec_id", "embedding", e, "vec_id", "embedding", k=5)


_UR = f"(case when len({sql_tokens('text')}) = 0 then 0e0 else len(list_distinct({sql_tokens('text')})) / len({sql_tokens('text')})::double end)"


def _side(s: str, name: str) -> str:
    return f"(select q, text, min(doc) as {name}_doc, max(norm) as {name} from (select s.q, s.doc, k.content as text, case when max(score) over (partition by q) > 0 then score / max(score) over (partition by q) else 0e0 end as norm from {s} s join kb_articles k on k.id = s.doc where {sql_strip('coalesce(k.content, $$$$)')} <> '') group by 1, 2)"


_FUSED = f"""(select q, coalesce(a_doc, b_doc) as doc, round((0.6e0 * coalesce(a, 0e0) + 0.4e0 * coalesce(b, 0e0)) * (1 + 0.1e0 * {_UR}), 6) as score from {_side(sql_top(_BM), 'a')} x full join {_side('(select q, doc, score from (select *, row_number() over (partition by q order by score desc, doc) as rk from ' + _LEX + ') where rk <= 3)', 'b')} y using (q, text))"""


@query(f"select q, doc, score, rk::int as rk from (select *, row_number() over (partition by q order by score desc, doc) as rk from {_FUSED}) where rk <= 3")
def hybrid_fusion(spark: SparkSession, sf: str) -> DataFrame:
    texts = kb(spark, sf).select(F.col("id").alias("doc"), F.col("content").alias("text"))
    return retrieval.fuse(bm25_topk(spark, sf), lexical_topk(spark, sf), texts)


@query(f"""select q, string_agg('### KB (BM25) ' || rk || ' [' || doc || '] (score=' || printf('%.2f', score) || '):' || chr(10) || '> ' || {sql_strip("coalesce(k.content, 'null')")}, chr(10) || chr(10) order by rk) as context from {sql_top(_BM)} h join kb_articles k on k.id = h.doc group by 1""")
def context_blocks(spark: SparkSession, sf: str) -> DataFrame:
    texts = kb(spark, sf).select(F.col("id").alias("doc"), F.col("content").alias("text"))
    return retrieval.context_block(bm25_topk(spark, sf), texts)


@query(f"select ticket_id, id, rk::int as rk from {TQ}, (select id, row_number() over (order by path, id) as rk from kb_articles where path is not null order by path, id limit 3)")
def kb_head(spark: SparkSession, sf: str) -> DataFrame:
    a = kb(spark, sf).filter("path is not null").select("id", F.struct("path", "id").alias("o"))
    return retrieval.head_articles(tickets(spark, sf).filter("document is not null").select("ticket_id"), a, "o").select("ticket_id", "id", "rk")


_POL = "(select ticket_index, unnest(gold_resolution.kb_policies) as policy, topic_group from gold_audit)"


def policies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "gold_audit").select("ticket_index", "topic_group", F.explode("gold_resolution.kb_policies").alias("policy"))


@query(f"select ticket_index, policy, coalesce(nullif(category, ''), nullif(topic_group, ''), '') as category, coalesce(nullif(title, ''), '') as title from {_POL} p left join kb_articles k on k.id = p.policy")
def kb_lookup_left(spark: SparkSession, sf: str) -> DataFrame:
    k = kb(spark, sf)
    j = policies(spark, sf).join(k.select(F.col("id").alias("policy"), "category", "title"), "policy", "left")
    return j.select("ticket_index", "policy", retrieval.prefer(F.col("topic_group"), F.col("category")).alias("category"), X.first_non_empty("title").alias("title"))


@query(f"select ticket_index, policy from {_POL} where policy in (select id from kb_articles)")
def kb_semi(spark: SparkSession, sf: str) -> DataFrame:
    return policies(spark, sf).select("ticket_index", "policy").join(kb(spark, sf).select(F.col("id").alias("policy")), "policy", "left_semi").select("ticket_index", "policy")


@query(f"select ticket_index, policy from {_POL} where policy not in (select id from kb_articles where id is not null)")
def kb_anti(spark: SparkSession, sf: str) -> DataFrame:
    return policies(spark, sf).select("ticket_index", "policy").join(kb(spark, sf).select(F.col("id").alias("policy")), "policy", "left_anti").select("ticket_index", "policy")


@query("""with a as (select id, category from kb_articles where category is not null), q as (select ticket_index, topic_group as category from gold_audit where topic_group is not null)
select ticket_index, id from q join a using (category) union all select ticket_index, id from q, a where q.category not in (select category from a)""")
def category_fallback(spark: SparkSession, sf: str) -> DataFrame:
    a = kb(spark, sf).filter("category is not null").select("id", "category")
    q = table(spark, sf, "gold_audit").filter("topic_group is not null").select("ticket_index", F.col("topic_group").alias("category"))
    return retrieval.within_category(q, a, "category").select("ticket_index", "id")


_MSG = "(select id as conv, pos as turn, line as text from (select id, unnest(string_split(content, chr(10))) as line, generate_subscripts(string_split(content, chr(10)), 1) - 1 as pos from kb_articles where content is not null))"
_SAL = f"""(with m as (select conv, turn, text, row_number() over (partition by conv order by turn) as pos from {_MSG} where text <> ''), t as (select *, list_transform({sql_tokens('text')}, lambda x: lower(x)) as t from m),
c as (select conv, pos, tok, count(*) as c from (select conv, pos, unnest(t) as tok from t) group by 1, 2, 3),
s as (select conv, pos, c, coalesce(sum(c) over (partition by conv, tok order by pos rows between unbounded preceding and 1 preceding), 0) as b, coalesce((lag(pos) over (partition by conv, tok order by pos) = pos - 1)::int, 0) as again from c),
p as (select conv, pos, sum(c / (1e0 + b)) as r, sum(again) as o from s group by 1, 2)
select conv, turn, pos, text, coalesce(round((r / len(t) * (1 + 0.15e0 * greatest(length(text) - length(replace(text, '.', '')), length(text) - length(replace(text, chr(10), '')), 1)) * (1 + (1 - o / len(t)::double) * 0.5e0) + least(len(t) / 20e0, 2e0)) * pow(0.9e0, pos), 6), 0e0) as score from t left join p using (conv, pos))"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return kb(spark, sf).filter("content is not null").select(F.col("id").alias("conv"), F.posexplode(F.split("content", "\n")).alias("turn", "text"))


@query(f"select conv, turn::int as turn, pos::int as pos, score from {_SAL}")
def salience_scores(spark: SparkSession, sf: str) -> DataFrame:
    return memory.salience(messages(spark, sf), "conv", "turn", "text").select("conv", "turn", "pos", "score")


@query(f"""with k as (select *, row_number() over (partition by conv order by score desc, pos) as rk from {_SAL}) select conv, string_agg({sql_strip('text')}, chr(10) order by rk) as context, round(coalesce(sum(score) / nullif(count(*) * max(score), 0), 0e0), 6) as relevance, count(*)::bigint as n from k where rk <= 3 group by 1""")
def salience_topk(spark: SparkSession, sf: str) -> DataFrame:
    return memory.best_messages(memory.salience(messages(spark, sf), "conv", "turn", "text"))


@query("select source, doc_id, back::int as back from (select source, doc_id, row_number() over (partition by source order by doc_id desc) as back from documents) where back <= 100")
def last_n_window(spark: SparkSession, sf: str) -> DataFrame:
    return memory.last_messages(table(spark, sf, "documents"), "source", "doc_id", 100).select("source", "doc_id", "back")


_E = "list_transform(embedding, lambda x: x::double)"


@query(f"select vec_id, round(sqrt(list_dot_product({_E}, {_E})), 6) as norm, round(list_dot_product({_E}, list_transform(range(64), lambda i: 1e0 / (i + 1))), 6) as projected from embeddings")
def vector_norms(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings").select("vec_id", vectors.doubles("embedding").alias("v"))
    w = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.lit(1.0) / (i + 1))
    return v.select("vec_id", F.round(vectors.norm("v"), 6).alias("norm"), F.round(vectors.dot("v", w), 6).alias("projected"))
