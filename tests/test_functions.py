"""Small exact cases of functions, guards, readers, writers, grids and the stream."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from lanternq.functions import records as R
from lanternq.functions import text as X
from lanternq.functions import vectors as V
from lanternq.functions import vocabulary as W
from lanternq.operators import analytics, classify, gold, guards, memory, retrieval
from lanternq.plans import grid, pipeline
from lanternq.sources import readers, writers


def values(spark, column, rows, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(column).collect()]


def test_labels(spark):
    raw = ["HR Support", "hr_support", "  Admin Rights ", "vpn access issue", "Internal Project Work", "storage quota increase", "benefits question", "zzz", "", " ", None]
    want = ["HR Support", "HR Support", "Administrative rights", "Access", "Internal Project", "Storage", "HR Support", None, None, None, None]
    assert values(spark, X.canonical_label("t"), raw) == want
    assert values(spark, X.label_or_fallback("t"), ["zzz", None]) == [W.FALLBACK, W.FALLBACK]
    with pytest.raises(Exception, match="unexpected label"):
        values(spark, X.strict_label("t"), ["zzz"])


def test_text(spark):
    assert values(spark, X.strip("t"), ["\t a \n", " ", None]) == ["a", "", None]
    assert values(spark, X.tokens("t"), [" a  b\n", "", None]) == [["a", "b"], [], []]
    assert values(spark, X.words("t"), ["It's A_1!", None]) == [["it", "s", "a_1"], []]
    assert values(spark, X.current_mode("t"), [" RAG ", "salience", "none", "", None]) == ["rag_dense", "rag_hybrid", "none", "unknown", "unknown"]
    assert values(spark, X.excerpt("t"), ["x" * 301, "x" * 300, None]) == ["x" * 300 + "...", "x" * 300, None]
    assert values(spark, X.unique_ratio("t"), ["a a b", "", None]) == [pytest.approx(2 / 3), 0.0, 0.0]
    assert values(spark, X.token_estimate("t", least=1), ["x" * 9, "", None]) == [2, 1, 1]
    assert values(spark, X.slug("t"), ["__A b-C!!", None]) == ["a_b_c", None]
    assert values(spark, X.short_category("t"), ["three people", "VPN", "xyz", None]) == ["hr support" if "hr" in "three people" else "", "access", "miscellaneous", "miscellaneous"]
    m = spark.sql("select map('b', '1,2', 'a', cast(null as string)) as m, cast(null as map<string,string>) as e")
    assert m.select(X.flat_map("m"), X.flat_map("e")).first()[:] == ("a:;b:1 2", None)


def test_vectors(spark):
    df = spark.sql("select array(3D, 4D) as a, array(0D, 0D) as z, array(1D, -1D, 0D) as s, cast(null as array<double>) as n")
    r = df.select(V.norm("a").alias("norm"), V.unit("a").alias("u"), V.cosine("a", "z").alias("c0"), V.softmax("s").alias("p"), V.normalized("s").alias("q"), V.normalized("z").alias("e"), V.softmax("n").alias("none")).first()
    assert r["norm"] == 5 and r["u"][0] == pytest.approx(0.6) and r["c0"] == 0 and sum(r["p"]) == pytest.approx(1) and r["q"] == [1, 0, 0] and r["e"] == [0.5, 0.5] and r["none"] is None
    assert df.select(V.affine([[1, 0], [0, -1]], [0, 1], F.col("a"), relu=True)).first()[0] == [3, 0]


def test_records(spark):
    rows = ['{"final_answer": 1, "reasoning": 2}', "x {\"a\": 1} y", "[1]", "3", "nope", "", None]
    assert values(spark, R.json_kind("t"), rows) == ["object", None, "array", "scalar", None, None, None]
    assert values(spark, R.has_keys("t", ("final_answer", "reasoning")), rows) == [1, 0, 0, 0, 0, 0, 0]
    assert values(spark, R.parsed_object("t"), rows)[1] == '{"a": 1}'
    assert values(spark, R.rate_value("t"), ["true", "0", "0.5", "x", None]) == [1.0, 0.0, 0.5, None, None]
    assert values(spark, R.band(F.col("t"), ((0.8, "high"), (0.5, "medium")), "low"), [0.8, 0.79, 0.5, 0.0, None], "t double") == ["high", "medium", "medium", "low", None]
    assert values(spark, R.triggers({"a": F.col("t") > 1, "b": F.col("t") > 2}, "none"), [3, 2, 1, None], "t int") == ["a + b", "a", "none", "none"]
    ok = spark.sql("select 'a b c' as ans, array('a b', 'c d', '') as s, cast(array() as array<string>) as e")
    assert ok.select(R.best_support(F.col("ans"), F.col("s")), R.best_support(F.col("ans"), F.col("e"))).first()[:] == (1.0, 0.0)


def test_fixtures_of_aggregates(spark):
    c = spark.createDataFrame([("tfidf", 0.2, 0), ("tfidf", 0.8, 1), ("encoder", 0.6, 0), ("encoder", 0.95, 1), ("encoder", float("nan"), 1), ("encoder", 1.0, 1)], "m string, c double, y int")
    bins = {(r["m"], r["low"]): (r["n"], r["accuracy"]) for r in analytics.calibration(c, "m", "c", "y", W.CALIBRATION_EDGES).collect()}
    assert bins["tfidf", 0.0] == (1, 0) and bins["tfidf", 0.7] == (1, 1) and bins["encoder", 0.9] == (2, 1) and bins["tfidf", 0.3] == (0, None) and len(bins) == 10
    p = spark.createDataFrame([(0.7, 1), (0.6, 0), (0.9, 1)], "c double, y int")
    cov = {r["threshold"]: (r["coverage"], r["accuracy"]) for r in analytics.coverage(p, "c", "y", (0.5, 0.8)).collect()}
    assert cov[0.5] == (1, pytest.approx(2 / 3, abs=1e-6)) and cov[0.8] == (pytest.approx(1 / 3, abs=1e-6), 1)
    m = spark.createDataFrame([("slm",), ("llm",), ("slm",)], "model_used string")
    assert m.agg(analytics.share(F.col("model_used") != "llm")).first()[0] == pytest.approx(2 / 3, abs=1e-6)
    assert m.limit(0).agg(analytics.share(F.col("model_used") != "llm")).first()[0] == 0
    best = classify.choose(spark.createDataFrame([(1.0, 0.7, 0.6), (0.5, 0.7, 0.65), (2.0, 0.68, 0.7)], "c double, acc double, f1 double"), [F.desc("acc"), F.desc("f1")]).first()
    assert best["c"] == 0.5


def test_anova_of_a_known_table(spark):
    rows = [(a, b, v) for a, b, vs in (("x", "p", (4.0, 5, 6)), ("x", "q", (7.0, 8, 9)), ("y", "p", (5.0, 6, 7)), ("y", "q", (12.0, 13, 14))) for v in map(float, vs)]
    out = {r["term"]: r for r in analytics.anova(spark.createDataFrame(rows, "a string, b string, v double"), "a", "b", "v").collect()}
    assert out["a"]["sum_sq"] == pytest.approx(27) and out["b"]["sum_sq"] == pytest.approx(75) and out["a:b"]["sum_sq"] == pytest.approx(12) and out["Residual"]["sum_sq"] == pytest.approx(8)
    assert out["a"]["f"] == pytest.approx(27) and analytics.f_tail(5.317655, 1, 8) == pytest.approx(0.05, abs=1e-5)
    assert analytics.anova(spark.createDataFrame([], "a string, b string, v double"), "a", "b", "v").count() == 0


def test_guards(spark):
    df = spark.createDataFrame([(1, "x")], "` Doc Ument ` int, b string")
    assert guards.tidy_names(df).columns == ["doc_ument", "b"]
    with pytest.raises(ValueError):
        guards.require_columns(df, ["zz"])
    with pytest.raises(ValueError):
        guards.tidy_names(spark.createDataFrame([(1, 2)], "`a b` int, a_b int"))
    with pytest.raises(ValueError):
        guards.union_strict([df, df.select("b")])
    with pytest.raises(ValueError):
        guards.refuse_duplicates(df.union(df), "b")
    got = guards.conform(df, [("b", "string"), ("n", "int"), ("c", "double")], {"n": 7}).first()
    assert got[:] == ("x", 7, None)
    good, bad = guards.quarantine(spark.sql("select array('e') as errors, 1 as i union all select cast(array() as array<string>), 2"), "errors")
    assert [r["i"] for r in good.collect()] == [2] and [r["i"] for r in bad.collect()] == [1]


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Document,Topic_group\n"a, ""b""\nc",hr\n,access\nx,\ny,vpn\n')
    got = readers.read_tickets(spark, str(tmp_path / "t.csv")).orderBy("text").collect()
    assert [(r["text"], r["label"]) for r in got] == [('a, "b"\nc', "HR Support"), ("y", "Access")]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_tickets(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "l.jsonl").write_text('{"a": 1}\nnope\n[1]\n{"a": null}\n')
    assert [r["a"] for r in readers.read_json_lines(spark, str(tmp_path / "l.jsonl"), "a int").collect()] == [1, None]
    assert readers.read_results(spark, str(tmp_path / "none.csv")).count() == 0
    kb = tmp_path / "kb" / "hr"
    kb.mkdir(parents=True)
    (kb / "Leave Rules.md").write_text("# Leave\nintro\n## Description\nd1\nd2\n\n## When to Escalate now\ne\n# Other title\nlost\n")
    a = readers.build_index(spark, str(tmp_path / "kb")).first()
    assert (a["id"], a["category"], a["title"], a["summary"], a["escalation_notes"], a["tags"]) == ("hr.leave_rules", "HR Support", "Other title", "d1\nd2", "e", ["hr", "leave", "rules"])
    (tmp_path / "d.txt").write_text("head\n<!-- file: a/b.md -->\nx\ny\n<!-- file: c.md -->\nz\n")
    assert {r["path"]: r["text"] for r in readers.split_dump(spark, str(tmp_path / "d.txt")).collect()} == {"a/b.md": "x\ny", "c.md": "z\n"}
    for n, body in (("c1.csv", "router,accuracy\na,1\n"), ("c2.csv", "router,accuracy\nb,0.5\n")):
        (tmp_path / n).write_text(body)
    parts = [str(tmp_path / n) for n in ("c2.csv", "c1.csv")]
    assert sorted((r["router"], r["accuracy"]) for r in readers.read_chunks(spark, parts).collect()) == [("a", 1.0), ("b", 0.5)]
    (tmp_path / "c3.csv").write_text("router\na\n")
    with pytest.raises(ValueError):
        readers.read_chunks(spark, [*parts, str(tmp_path / "c3.csv")])
    assert readers.infer_columns(["Text ", "y"], {"t": ("body", "text")}) == {"t": "Text "}
    row = guards.conform(spark.sql("select 'a\nb' as router, double('nan') as accuracy"), W.RESULT_COLUMNS)
    writers.write_results(row, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True).first()
    assert back["router"] == "a b" and back["accuracy"] is None and len(back) == len(W.RESULT_COLUMNS)
    writers.append_run(spark, {"n": 1, "at": None}, str(tmp_path / "runs"))
    writers.append_run(spark, {"n": 2, "more": "x"}, str(tmp_path / "runs"))
    assert spark.read.option("mergeSchema", True).parquet(str(tmp_path / "runs")).count() == 2
    plan = writers.sync_plan(spark.createDataFrame([("a",)], "path string"), spark.createDataFrame([("a",), ("b",)], "path string"))
    assert sorted(map(tuple, plan.collect())) == [("a", "write"), ("b", "delete")]
    assert writers.output_path(50, "s", "l") == "s" and writers.output_path(51, "s", "l") == "l" and writers.output_path(1, "s", "l", "o") == "o"


def test_retrieval_edges(spark):
    d = spark.createDataFrame([(1, "alpha beta"), (2, "alpha alpha"), (3, ""), (4, None), (5, "beta alpha")], "doc int, text string")
    q = spark.createDataFrame([(1, "alpha"), (2, "zzz"), (3, None)], "q int, text string")
    top = retrieval.bm25_top(q, "q", "text", d, "doc", "text").collect()
    assert [(r["q"], r["doc"]) for r in sorted(top, key=lambda r: r["rk"])] == [(1, 2), (1, 1), (1, 5)]
    assert retrieval.bm25_top(q.limit(0), "q", "text", d, "doc", "text").count() == 0 and retrieval.bm25_top(q, "q", "text", d.limit(0), "doc", "text").count() == 0
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 0.0]), (4, None)], "id int, v array<double>")
    got = retrieval.dense_top(v, "id", "v", v, "id", "v", k=2, block=1).collect()
    assert sorted((r["q"], r["rk"], r["doc"]) for r in got)[:2] == [(1, 1, 1), (1, 2, 3)] and {r["q"] for r in got} == {1, 2, 3}
    assert retrieval.dense_top(v.limit(0), "id", "v", v, "id", "v").count() == 0


def test_memory_and_stream(spark, tmp_path):
    rows = [("c", 1, "a b. c"), ("c", 2, ""), ("c", 3, "  "), ("c", 4, "a a b"), ("c", 5, "a new one"), ("d", 1, None)]
    batch = {(r["conv"], r["turn"]): (r["pos"], r["score"]) for r in memory.salience(spark.createDataFrame(rows, "conv string, turn int, text string"), "conv", "turn", "text").collect()}
    assert set(batch) == {("c", 1), ("c", 3), ("c", 4), ("c", 5)} and batch["c", 3] == (2, 0.0)
    from lanternq.streaming.salience import salience_stream

    src = tmp_path / "in"
    src.mkdir()
    for i, part in enumerate((rows[:3], rows[3:])):
        (src / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("conv", "turn", "text"), r))) for r in part))
        os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken in order of their times
    s = spark.readStream.schema("conv string, turn int, text string").option("maxFilesPerTrigger", 1).json(str(src))
    run = salience_stream(s).writeStream.format("memory").queryName("sal").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert {(r["conv"], r["turn"]): (r["pos"], r["score"]) for r in spark.table("sal").collect()} == batch


def test_grid_and_scorer(spark):
    calls = []

    def scorer(texts):
        calls.append(len(texts))
        return ['{"final_answer": "x", "reasoning": "y"}' for _ in texts]

    df = spark.createDataFrame([(1, "abc"), (2, None)], "id int, text string")
    out = grid.run(df, {"router": ("r1", "r2"), "mode": ("none",)}, scorer, "text").collect()
    assert len(out) == 4 and all(json.loads(r["output"])["final_answer"] == "x" for r in out)
    fixed = classify.with_repair(lambda ts: ["bad" if t == "b" else "ok" for t in ts], lambda o: o == "ok", fallback="none")
    assert fixed(["a", "b"]) == ["ok", "none"]


def test_classifiers(spark):
    df = spark.createDataFrame([(1, "password reset"), (2, ""), (3, None), (4, "payroll and vacation and salary question")], "id int, t string")
    best = {r["id"]: r["b"] for r in df.select("id", classify.best_label(classify.prior("t")).alias("b")).collect()}
    assert best == {1: "Access", 2: "Access", 3: "Access", 4: "HR Support"}
    p = df.select(classify.heuristic("t").alias("p")).collect()
    assert all(sum(r["p"]) == pytest.approx(1) for r in p)
    assert set(classify.REGISTRY) == {"prior", "heuristic"}


def test_gold_gate(spark):
    df = spark.createDataFrame([(1, None), (5, 2)], "a int, b int")
    codes = [r[0] for r in df.select(gold.gate([(F.col("a") > 0, 2), (F.col("b") > 1, 3)])).collect()]
    assert codes == [3, 0]


def test_pipeline(spark, tmp_path):
    corpus = spark.createDataFrame([("a", "red mouse"), ("b", "blue mouse pad"), ("c", None)], "doc string, text string")
    q = spark.createDataFrame([(1, "mouse"), (2, "zebra"), (3, None)], "q int, text string")
    for mode, hits in (("rag_bm25", 2), ("lexical", 2), ("none", 0), ("no such mode", 0)):
        got = {r["q"]: r for r in pipeline.retrieve(q, corpus, mode).collect()}
        assert set(got) == {1, 2, 3} and got[1]["hits"] == hits and got[2]["hits"] == got[3]["hits"] == 0 and got[2]["context"] == ""
    stored = corpus.withColumn("v", F.when(F.col("doc") == "b", pipeline.V.letter_vector(F.lit("mouse"))).when(F.col("doc") == "a", pipeline.V.letter_vector(F.lit("zzz"))))
    for mode in ("rag_dense", "rag_hybrid"):  # vectors bring any text near; texts without letters have none
        got = {r["q"]: r for r in pipeline.retrieve(q, stored, mode).collect()}
        assert set(got) == {1, 2, 3} and got[1]["hits"] == 2 and got[3]["hits"] == 0 and got[3]["context"] == "" and "1 [b]" in got[1]["context"]
    only = pipeline.retrieve(q, corpus, "rag_bm25", known_ids=corpus.filter("doc = 'b'")).filter("q = 1").first()
    assert only["hits"] == 1 and "[b]" in only["context"]
    more = pipeline.append_documents(corpus, spark.createDataFrame([(1, " x "), (2, " "), (3, "y")], "at int, t string"), "t")
    assert {r["doc"]: r["text"] for r in more.collect()}["dynamic:4"] == "y" and more.count() == 5
    twice = pipeline.append_documents(more, spark.createDataFrame([(1, "z")], "at int, t string"), "t")
    assert sorted(r["doc"] for r in twice.collect()) == ["a", "b", "c", "dynamic:3", "dynamic:4", "dynamic:5"]
    asked = [r["text"] for r in pipeline.with_query_fallback(q, "last").orderBy("q").collect()]
    assert asked == ["mouse", "zebra", "last"]
    seen = []

    def encode(df):
        seen.append(sorted(r["text"] or "" for r in df.collect()))
        return df.select("sha256", F.array(F.lit(1.0)).alias("v"))

    path = str(tmp_path / "cache")
    assert pipeline.cached_vectors(corpus, encode, path).count() == 3
    assert pipeline.cached_vectors(more, encode, path).count() == 5 and seen == [["", "blue mouse pad", "red mouse"], ["x", "y"]]
    row = spark.sql("select 'dynamic:1' as a, 'x' as b, 'y' as c, array('y') as ok, ' ' as p, 'm' as m")
    assert row.select(pipeline.first_policy(F.col("ok"), ["a", "b", "c"]), pipeline.first_prediction("p", "m")).first()[:] == ("y", "m")
