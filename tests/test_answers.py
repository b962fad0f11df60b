import json

import pytest
from pyspark.sql import functions as F

from presswork.operators import answers, state


def test_request_bodies(spark):
    df = spark.range(1)
    line = lambda layout, model: json.loads(df.select(answers.request_body(layout, F.lit("c"), F.lit("s"), F.lit('u "é"'), model, 9).alias("x")).first().x)
    chat = line("chat", "m")
    assert chat["body"]["max_tokens"] == 9 and chat["body"]["temperature"] == 0.0 and chat["body"]["messages"][1]["content"] == 'u "é"'
    newer = line("chat", "GPT-5-x")
    assert newer["body"]["max_completion_tokens"] == 9 and "temperature" not in newer["body"]
    assert line("messages", "m")["params"]["messages"] == [{"role": "user", "content": 'u "é"'}]
    with pytest.raises(ValueError):
        answers.request_body("other", F.lit("c"), F.lit("s"), F.lit("u"), "m", 9)


def test_calls_are_retried_and_kept(spark):
    def call(p):
        if p == "bad":
            raise ValueError("no")
        return p.upper()

    rows = spark.createDataFrame([("a", "x"), ("b", "bad"), ("c", "y"), ("d", None)], "k string, p string")
    done = spark.createDataFrame([("c", True, "old", None, 1), ("b", False, None, "e", 1), ("z", True, "gone", None, 1)], "k string, ok boolean, text string, error string, attempts int")
    got = {r.k: tuple(r)[1:] for r in answers.call_each(rows, "k", "p", call, retries=2, done=done).collect()}
    assert got["a"] == (True, "X", None, 1) and got["b"] == (False, None, "ValueError: no", 2) and got["c"] == (True, "old", None, 1)
    assert got["d"][0] is False and "z" not in got
    assert answers.call_each(rows.limit(0), "k", "p", call).count() == 0


def test_hydration_keeps_rows_without_a_batch(spark):
    st = spark.createDataFrame([("1", "b", ""), ("2", None, "relevant"), ("3", "b", "")], "custom_id string, batch_id string, headline_label string")
    batches = spark.createDataFrame([("b", "ended")], "batch_id string, status string")
    res = spark.createDataFrame([("b", "1", True, '{"label": "irrelevant", "confidence": 2}', "")], "batch_id string, custom_id string, success boolean, raw_text string, error string")
    got = {r.custom_id: (r.headline_label, r.headline_confidence, r.batch_state, r.final_action) for r in answers.hydrate(st, batches, res).collect()}
    assert got == {"1": ("irrelevant", 1.0, "hydrated", "drop"), "2": ("relevant", None, "", "keep"), "3": ("", None, "", None)}


def test_rationales(spark):
    ok = "[HUMAN] markets closed in three towns after many deaths; linkage: the fever drove people away"
    for text, relevant, want in [(ok, True, "relevant_missing_evidence_span"), (ok, False, ""), (ok.replace("linkage:", "link"), False, "rationale_missing_linkage_tag"), ("short", False, "rationale_too_short:1<12"), (None, False, "rationale_too_short:0<12")]:
        df = spark.createDataFrame([(text, relevant)], "t string, r boolean")
        assert df.select(answers.rationale_reason(F.col("t"), F.col("r"), F.array().cast("array<string>"), ["Fever"]).alias("x")).first().x == want


def test_manifest_of_another_strategy_is_replaced(spark):
    keys = state.MANIFEST_KEYS
    row = lambda start, role, status: (*["x"] * 7, start, "e", role, status)
    schema = ", ".join(f"{k} string" for k in keys) + ", status string"
    plan = spark.createDataFrame([row("1", "base", "pending"), row("2", "base", "pending")], schema)
    other = spark.createDataFrame([row("9", "base", "success")], schema)
    assert sorted(r.window_start for r in state.load_manifest(plan, other, keys, ["status"]).collect()) == ["1", "2"]
    mine = spark.createDataFrame([row("1", "base", ""), row("7", "", "split")], schema)
    got = {(r.window_start, r.window_role, r.status) for r in state.load_manifest(plan, mine, keys, ["status"]).collect()}
    assert got == {("1", "base", "pending"), ("7", "hierarchical_child", "split"), ("2", "base", "pending")}
    assert state.load_manifest(plan, other.limit(0), keys, ["status"]).count() == 2
    with pytest.raises(ValueError):
        state.select_rows(plan, "window_start", ["1", "none"])
