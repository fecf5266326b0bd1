"""Queries that must take whole tables: each is compared with DuckDB over all rows, apart from the twin."""

from __future__ import annotations

import glob
import math

import pytest

from lanternq import catalog
from lanternq.functions import vocabulary as V
from lanternq.operators import classify
from lanternq.plans import pipeline
from lanternq.plans.text_queries import sql_labels, sql_strip

duckdb = pytest.importorskip("duckdb")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def sql(data, text):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.sql(f"create view {f.rsplit('/', 1)[1][:-8]} as select * from '{f}'")
    return sorted(c.sql(text).fetchall())


def test_union_strict_takes_every_chunk(spark, data):
    want = sql(data, "select case when chunk_no % 2 = 1 then 'a' else 'b' end, result_id from results")
    assert rows(catalog.queries()["union_strict"](spark, data)) == want


def test_class_weights_count_canonical_labels(spark, data):
    labels = sql_labels("tickets", "topic_group")
    want = sql(data, f"""with c as (select label, count(*) as n from tickets join ({labels}) on raw = topic_group where label is not null group by 1), t as (select sum(n) as total, count(*) as k from c)
        select label, n, round(total / (k * n) * case label when 'HR Support' then 1.3e0 when 'Purchase' then 1.1e0 when 'Administrative rights' then 1.1e0 else 1e0 end, 6) from c, t""")
    got = [r for r in rows(catalog.queries()["class_weights"](spark, data)) if r[1]]
    assert len(got) > 4 and {r[0] for r in got} <= set(V.LABELS)
    assert [r[:2] for r in got] == [r[:2] for r in want] and [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-6)


def test_index_append_takes_every_ticket(spark, data):
    want = sql(data, f"""with t as (select ticket_id, arg_min(document, received_at) as document from tickets where document is not null group by 1)
        select id, length(content)::int from kb_articles union all select 'dynamic:' || (k + row_number() over (order by ticket_id) - 1), length({sql_strip('document')})::int from t, (select count(*) as k from kb_articles) where {sql_strip('document')} <> ''""")
    assert rows(catalog.queries()["index_append"](spark, data)) == want


@pytest.mark.parametrize("at", [[None, None, *([5] * 20), *range(40)], [None, None, None]])
@pytest.mark.parametrize("parts", [1, 3, 256])
def test_appended_texts_are_numbered_in_parts(spark, parts, at):
    new = spark.createDataFrame([(a, f"t{i:03}") for i, a in enumerate(at)], "at int, t string")
    corpus = spark.createDataFrame([], "doc string, text string")
    got = {r["doc"]: r["text"] for r in pipeline.append_documents(corpus, new, "t", parts).collect()}
    want = sorted(((a is not None, a or 0, f"t{i:03}") for i, a in enumerate(at)))
    assert got == {f"dynamic:{i}": w[2] for i, w in enumerate(want)}


def test_tfidf_scales_counts_and_cleans_words(spark):
    train = spark.createDataFrame([("red blue", "x"), ("red blue", "y"), ("green", "x"), ("cafe", "y"), ("cafe", "x")], "text string, label string")
    model, names = classify.tfidf_model(train, "text", "label")
    made = lambda *texts: [r["features"] for r in model.transform(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)).orderBy("i").collect()]
    repeated, accented, plain, marks, stopped = made("red red red zzz blue", "Café", "cafe", "cafe\u0301", "red the blue")
    assert names == ["x", "y"] and sorted(repeated.values)[1] / sorted(repeated.values)[0] == pytest.approx(1 + math.log(3))
    assert accented == plain == marks and plain.numNonzeros() == 1
    assert stopped.numNonzeros() == 3  # red, blue and "red blue"


def test_tfidf_refuses_more_labels_than_it_names(spark):
    train = spark.range(1001).selectExpr("'red' as text", "cast(id as string) as label")
    with pytest.raises(ValueError, match="more than 1000"):
        classify.tfidf_model(train, "text", "label")


def test_gold_template_takes_every_row(spark, data):
    want = sql(data, "select ticket_index, topic_group, ticket_text, 'TODO', 0, false from gold_audit")
    assert sorted(map(str, rows(catalog.queries()["gold_template"](spark, data)))) == sorted(map(str, want))


def test_contexts_quote_the_content_of_hits(spark, tmp_path):
    spark.sql("select 100L as ticket_id, 'printer jams' as document, timestamp'2026-01-01' as received_at").write.parquet(f"{tmp_path}/tickets.parquet")
    kb = [("a", "Short", "The printer jams when paper is damp."), ("b", None, " Clean the printer. "), ("c", "Printer jams", "Nothing.")]
    spark.createDataFrame(kb, "id string, title string, content string").coalesce(1).write.parquet(f"{tmp_path}/kb_articles.parquet")
    block = catalog.queries()["context_blocks"](spark, str(tmp_path)).first()["context"]
    payload = catalog.queries()["retrieve_payload"](spark, str(tmp_path)).first()["context"]
    for context in (block, payload):
        assert [line for line in context.split("\n") if line.startswith("> ")] == ["> The printer jams when paper is damp.", "> Clean the printer."]
