"""Contracts, defaults, gold validation, registries, artefacts and re-projection on small fixtures."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lanternq.functions import contracts as C
from lanternq.functions import vocabulary as V
from lanternq.operators import analytics, classify, gold, guards
from lanternq.sources import readers, writers

FLAGS = {"needs_human": False, "needs_llm_escalation": True, "policy_gap": False, "reasons": ["a"]}
METRICS = {"latency_ms": 1.5, "total_input_tokens": 1, "total_output_tokens": 2, "total_cost_usd": 0}
GOOD = {f: "x" for f in C.TEXT_FIELDS} | {
    "ticket_id": "1", "topic_group": "hardware", "classifier_label": "Access", "classifier_confidence_bucket": "low", "memory_mode": "none", "classifier_confidence": 0.5, "resolution_steps": ["a"],
    "escalation_flags": FLAGS, "metrics": METRICS, "classification": {"label": "access", "confidence": 1, "confidence_bucket": "high"}, "kb_policy_ids": [], "kb_categories": ["Access", ""], "escalation_model_name": None,
}
#: what is changed (a missing field by ...) and the error that it must give
BROKEN = [
    ({"ticket_id": 5}, "ticket_id must be a string when provided"), ({"reasoning": ...}, "Missing field: reasoning"), ({"reasoning": 1}, "Field reasoning must be a string"), ({"reasoning": None}, "Field reasoning must be a string"),
    ({"final_answer": " \n"}, "Field final_answer is empty"), ({"topic_group": "zzz"}, "Field topic_group is not in the allowed label set"), ({"classifier_confidence_bucket": "huge"}, "classifier_confidence_bucket must be one of ['high', 'low', 'medium']"),
    ({"classifier_confidence": ...}, "Missing field: classifier_confidence"), ({"classifier_confidence": "1"}, "classifier_confidence must be a number"), ({"classifier_confidence": 1.01}, "classifier_confidence must be between 0 and 1"),
    ({"context_mode": "q"}, "context_mode must be one of ['none', 'rag_bm25', 'rag_dense', 'rag_hybrid']"), ({"memory_mode": "q"}, "memory_mode must be one of ['none', 'rag_bm25', 'rag_dense', 'rag_hybrid'] or None"),
    ({"classification": []}, "classification must be an object"), ({"classification": {"label": "zzz"}}, "classification.label is not in the allowed label set"), ({"classification": {"confidence": 2}}, "classification.confidence must be between 0 and 1"),
    ({"classification": {"confidence_bucket": 1}}, "classification.confidence_bucket must be one of ['high', 'low', 'medium']"), ({"resolution_steps": ...}, "Missing field: resolution_steps"), ({"resolution_steps": ["a", 1]}, "resolution_steps must be a list of strings"),
    ({"resolution_steps": ["a", None]}, "resolution_steps must be a list of strings"), ({"escalation_flags": ...}, "Missing field: escalation_flags"), ({"escalation_flags": "x"}, "escalation_flags must be an object"),
    ({"escalation_flags": {k: v for k, v in FLAGS.items() if k != "policy_gap"}}, "escalation_flags missing field: policy_gap"), ({"escalation_flags": FLAGS | {"policy_gap": 0}}, "escalation_flags field policy_gap must be a bool"),
    ({"escalation_flags": FLAGS | {"reasons": "a"}}, "escalation_flags.reasons must be a list of strings"), ({"kb_policy_ids": [1]}, "kb_policy_ids must be a list of strings"), ({"kb_categories": "a"}, "kb_categories must be a list of strings"),
    ({"kb_categories": ["Access", "zz"]}, "kb_categories contains non-canonical label: zz"), ({"metrics": ...}, "Missing field: metrics"), ({"metrics": 1}, "metrics must be an object"), ({"metrics": METRICS | {"latency_ms": "1"}}, "metrics field latency_ms has wrong type"),
    ({"metrics": {k: v for k, v in METRICS.items() if k != "total_cost_usd"}}, "metrics missing field: total_cost_usd"), ({"escalation_model_name": 3}, "escalation_model_name must be a string when provided"),
]


def test_each_rule_violated_once(spark):
    cases = [(GOOD, [])] + [({k: v for k, v in (GOOD | change).items() if v is not ...}, [error]) for change, error in BROKEN]
    rows = [(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(900, None), (901, "text"), (902, "[1]"), (903, "")]
    got = {r["i"]: r["e"] for r in spark.createDataFrame(rows, "i int, errors string").select("i", C.errors("errors").alias("e")).collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, (cases[i], got[i])
    assert all(got[i] == [C.NO_OBJECT] for i in (900, 901, 902, 903))


def test_defaults_and_quarantine(spark):
    rows = [(1, json.dumps(GOOD)), (2, json.dumps({"original_query": "q", "category": "vpn login", "escalation_flags": {"reasons": "why"}, "classification": {"confidence": 0.25}})), (3, "nope"), (4, None)]
    df = spark.createDataFrame(rows, "i int, json string")
    valid, bad = C.validated(df, "json")
    assert [r["i"] for r in valid.collect()] == [1] and json.loads(valid.first()["json"])["topic_group"] == "Hardware"
    bad = {r["i"]: r for r in bad.collect()}
    made = json.loads(bad[2]["json"])
    assert made["ticket_id"] == "" and made["rewritten_query"] == "q" and made["topic_group"] == made["classifier_label"] == "Access" and made["classifier_confidence"] == 0.25
    assert made["escalation_flags"] == {"needs_human": False, "needs_llm_escalation": False, "policy_gap": False, "reasons": ["why"]} and made["memory_mode"] == "none" and made["metrics"]["total_input_tokens"] == 0
    assert "Missing field: resolution_steps" in bad[2]["errors"] and bad[3]["json"] == "nope" and bad[4]["errors"] == [C.NO_OBJECT]
    assert C.validated(df.limit(0), "json")[0].count() == 0
    out = spark.createDataFrame([('say {"reasoning": " r ", "final_answer": "printer", "predicted_category": ""} end',), ("plain",), (None,)], "t string").select(C.normal_output("t").alias("o")).select("o.*").collect()
    assert tuple(out[0]) == ("r", "printer", "Hardware") and out[1]["final_answer"] == "plain" and out[2]["final_answer"] == "No valid answer produced"
    assert spark.createDataFrame([('{"reasoning": "a", "final_answer": 1}',)], "t string").select(C.errors("t", C.answer_rules)).first()[0] == ["Field final_answer has wrong type", "Missing field: predicted_category"]


def test_gold_validation(spark):
    base = {"summary": "Reset it", "steps": ["open the panel", "press reset", "check the light"], "escalation_required": False, "escalation_reason": "", "kb_policies": ["a"], "acceptance_criteria": ["works", "stays"]}
    cases = [
        ({}, []), ({"summary": "todo"}, ["summary_missing"]), ({"steps": ["open it"]}, ["steps_count_out_of_range"]), ({"steps": ["do it now"] * 9}, ["steps_count_out_of_range"]), ({"steps": ["open it", "go", "close it"]}, ["steps_not_actionable"]),
        ({"acceptance_criteria": ["works"]}, ["empty_acceptance_criteria"]), ({"kb_policies": []}, ["kb_policies_missing"]), ({"kb_policies": ["z", "a", "b", "z"]}, ["kb_policy_not_retrieved:b,z"]),
        ({"escalation_required": True}, ["escalation_reason_missing"]), ({"summary": "As an AI I wait"}, ["non_actionable_fluff"]), (None, ["empty_resolution"]),
    ]
    kind = "struct<summary:string,steps:array<string>,escalation_required:boolean,escalation_reason:string,kb_policies:array<string>,acceptance_criteria:array<string>>"
    rows = [(i, None if c is None else tuple((base | c).values())) for i, (c, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, r {kind}").withColumn("g", F.when(F.col("r").isNotNull(), gold.normal_resolution("r")))
    got = {r["i"]: r["e"] for r in df.select("i", gold.validation_reasons("g", F.array(F.lit("a"))).alias("e")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}
    nested = spark.sql("select named_struct('gold_resolution', named_struct('summary', 's')) as r")
    assert gold.unwrapped(nested, "r").first()["r"]["summary"] == "s" and gold.unwrapped(df, "r").count() == len(cases)
    lists = spark.sql("select array('f') as f, array('p') as p union all select null, array('p') union all select null, null")
    assert sorted(r[0] for r in lists.select(gold.snippets("f", "p")).collect()) == [[], ["f"], ["p"]]
    assert [r["line"] for r in gold.audit_text(spark.sql("select 1 as a, cast(null as string) as b")).orderBy("pos").collect()] == ["a: 1", "b: n/a"]


def test_argmax_takes_text_labels(spark):
    p = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (2, "x", 0.1), (2, "y", 0.9), (3, None, 0.2), (4, "z", None)], "k int, label string, p double")
    assert {r["k"]: (r["predicted"], r["confidence"]) for r in classify.argmax(p, "k").collect()} == {1: ("a", 0.5), 2: ("y", 0.9), 3: (None, 0.2)}
    one = analytics.extremes(spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5), ("a", "c", -0.5), ("c", "b", 0.5)], "a string, b string, v double"), "v").first()
    assert tuple(one) == (0.25, -0.5, "a", "c", 0.5, "a", "b")


def test_heads_and_blend(spark):
    rows = [([float(i % 2), float(i % 3 == 0), 1.0], float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, "x array<double>, y double").select(F.expr("x"), "y")
    from pyspark.ml.functions import array_to_vector

    df = df.withColumn("f", array_to_vector("x"))
    model, tried = classify.sweep_heads(df, df, "f", "y")
    assert len(tried) == 6 and max(c["accuracy"] for c in tried) == 1.0 and model.transform(df).filter("prediction = y").count() == 60
    _, tried = classify.sweep_heads(df, df, "f", "y", (0.03,), ("none",), hidden=(4,))
    assert len(tried) == 1 and tried[0]["macro_f1"] is not None
    b = spark.sql("select 'printer printer laptop' as t, array(0.2D, 0.8D) as p union all select 'zzz', array(0D, 0D)")
    got = [r[0] for r in b.select(classify.blended(F.col("p"), "t", ("Hardware", "Access"))).collect()]
    assert abs(sum(got[0]) - 1) < 1e-9 and got[0][V.LABELS.index("Hardware")] > 0.3 and got[1] == pytest.approx([1 / len(V.LABELS)] * len(V.LABELS))
    assert spark.sql("select array(1, 2) as a, array(3D) as b").select(classify.joined_features("a", "b")).first()[0] == [1.0, 2.0, 3.0]


def test_registry_records_and_frames(spark, tmp_path):
    models = spark.createDataFrame([("a", "slm"), ("b", "LLM")], "name string, kind string")
    assert guards.sane_registry(models).count() == 2 and guards.sane_registry(models, force="llm").count() == 1
    for bad in ({"only": ["a"]}, {"only": ["a"], "force": "llm"}):
        with pytest.raises(ValueError):
            guards.sane_registry(models, **bad)
    j = spark.createDataFrame([('{"a":1}',), ("x",), (None,)], "j string").select(guards.coerced_record(F.col("j"))).collect()
    assert [json.loads(r[0]) for r in j] == [{"a": 1}, {"result": "error", "raw_record": "x"}, {"result": "error", "raw_record": "null"}]
    assert [tuple(r) for r in readers.tickets_frame(spark, ["x", {"id": 7, "text": "y"}, {"document": "z"}]).collect()] == [("0", "x"), ("7", "y"), ("2", "z")]
    (tmp_path / "c.json").write_text('{"a": {"b": 2}, "d": 1}')
    assert readers.read_config(str(tmp_path / "c.json"), {"a": {"b": 1, "c": 3}}) == {"a": {"b": 2, "c": 3}, "d": 1} and readers.read_config(str(tmp_path / "none"), {"q": 1}) == {"q": 1}
    (tmp_path / "list.json").write_text("[1]")
    with pytest.raises(ValueError):
        readers.read_config(str(tmp_path / "list.json"))
    assert readers.file_hashes(spark, str(tmp_path / "list.json")).first()["n_bytes"] == 3


def test_artefacts_and_swaps(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "label string, centroid array<double>")
    writers.write_vectors(v, str(tmp_path / "v"))
    assert readers.read_vectors(spark, str(tmp_path / "v"), ("a", "b")).count() == 2
    with pytest.raises(ValueError):
        readers.read_vectors(spark, str(tmp_path / "v"), ("a", "c"))
    writers.write_vectors(v.unionByName(spark.createDataFrame([("c", [1.0])], v.schema)), str(tmp_path / "w"))
    with pytest.raises(ValueError):
        readers.read_vectors(spark, str(tmp_path / "w"))
    old = str(tmp_path / "old")
    spark.createDataFrame([("r", "1", "x")], "router string, accuracy string, odd string").write.csv(old, header=True)
    assert writers.reproject(spark, [old, str(tmp_path / "none")]) == [old]
    back = spark.read.csv(old, header=True)
    assert back.columns == [n for n, _ in V.RESULT_COLUMNS] and back.first()["router"] == "r" and not (tmp_path / "old.new").exists() and not (tmp_path / "old.old").exists()
    writers.write_summaries({"router": back.select("router")}, str(tmp_path / "s"))
    writers.write_anova(spark.createDataFrame([], "term string, p double"), str(tmp_path / "anova"))
    assert spark.read.csv(str(tmp_path / "s" / "summary_by_router"), header=True).count() == 1 and spark.read.csv(str(tmp_path / "anova"), header=True).count() == 0
    writers.write_outputs(spark.createDataFrame([(1, "o"), (2, "p")], "k int, out string"), spark.createDataFrame([(1, "Access"), (1, "Access")], "k int, label string"), "k", "label", str(tmp_path / "o"))
    assert {(r["k"], r["gold_label"]) for r in spark.read.schema("k int, gold_label string").json(str(tmp_path / "o")).collect()} == {(1, "Access"), (2, None)}
