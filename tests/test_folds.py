"""Folding attempts, with canned calls."""

import pytest
from pyspark.sql import functions as F

from evalloom.operators import folds
from evalloom.operators import evaluate as ev

SCHEMA = (
    "sample_id string, task_name string, parser string, pass_kind string, attempt_idx int,"
    " prompt string, raw_response string, latency_s double, input_tokens bigint, output_tokens bigint"
)


def calls(spark, rows, task="nested_squares", parser="integer"):
    """rows: (sample, kind, index, response)."""
    full = [(s, task, parser, k, i, f"p{i}", r, 0.5, 10, 1) for s, k, i, r in rows]
    return ev.extract_answers(spark.createDataFrame(full, SCHEMA))


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def samples(*replies):
    return [("a", "sample", i, r) for i, r in enumerate(replies)]


def test_votes(spark):
    got = one(folds.best_of_n(calls(spark, samples("{2}", "{3}", "{3}", "no", "{1}"))))
    assert (got["parsed_answer"], got["raw_response"], got["strategy_n"]) == ("3", "{3}", 5)
    assert got["strategy_votes"] == {"2": 1, "3": 2, "1": 1}
    assert got["strategy_all_answers"] == ["2", "3", "3", None, "1"]
    assert (got["latency_s"], got["input_tokens"], got["output_tokens"]) == (2.5, 50, 5)


def test_ties_go_to_the_first_seen(spark):
    df = calls(spark, samples("{9}", "{2}", "{2}", "{9}"))
    assert one(folds.best_of_n(df))["parsed_answer"] == "9"
    assert one(folds.majority_vote(df))["parsed_answer"] == "9"


def test_all_unreadable(spark):
    df = calls(spark, samples("no", "none"))
    got = one(folds.best_of_n(df))
    assert (got["parsed_answer"], got["raw_response"], got["strategy_votes"]) == (None, "no", {})
    assert one(folds.majority_vote(df))["votes"] == 0


def test_every_call_counts(spark):
    rows = samples(*["{5}"] * 7, *["{3}"] * 3)
    assert one(folds.best_of_n(calls(spark, rows)))["parsed_answer"] == "5"
    assert one(folds.majority_vote(calls(spark, rows)))["parsed_answer"] == "5"


def test_repeated_calls_are_calls(spark):
    """Rows of one kind and index count each, by the same rule in both votes."""
    rows = samples("{1}", "{2}", "{1}")
    df = calls(spark, rows + rows[1:2] * 50)
    got = one(folds.best_of_n(df))
    assert (got["parsed_answer"], got["strategy_n"]) == ("2", 53) and one(folds.majority_vote(df))["votes"] == 51


def test_strategies_and_models_stay_apart(spark):
    one_table = calls(spark, samples("{1}", "{1}", "{2}")).withColumn("strategy", F.lit("best_of_n")).unionByName(
        calls(spark, samples("{0}", "{0}", "{0}") + [("a", "verify", 0, "yes")]).withColumn("strategy", F.lit("best_of_n_verify"))
    )
    df = one_table.withColumn("model", F.lit("m1")).unionByName(one_table.withColumn("model", F.lit("m2")))
    got = {(r["strategy"], r["model"]): r["parsed_answer"] for r in folds.fold_all(df).collect()}
    assert got == {(s, m): a for s, a in (("best_of_n", "1"), ("best_of_n_verify", "0")) for m in ("m1", "m2")}
    voted = {(r["strategy"], r["model"]): r["votes"] for r in folds.majority_vote(df.where("pass_kind = 'sample'")).collect()}
    assert voted[("best_of_n", "m1")] == 2 and voted[("best_of_n_verify", "m2")] == 3
    assert "SortAggregate" not in folds.best_of_n(df)._jdf.queryExecution().toString()


def test_registered_folds(spark):
    df = calls(spark, samples("{4}", "{9}")).withColumn("strategy", F.lit("largest"))
    largest = F.max(F.col("parsed_answer").try_cast("bigint")).cast("string")
    own = {"largest": lambda d: d.groupBy("sample_id", "strategy").agg(largest.alias("parsed_answer"))}
    assert one(folds.fold_all(df, {**folds.FOLDS, **own}))["parsed_answer"] == "9"
    with pytest.raises(Exception, match="no fold for strategy largest"):
        folds.fold_all(df).collect()


def verify(spark, first, second):
    return one(folds.verify(calls(spark, [("a", "full", 0, first), ("a", "verify", 0, second)])))


def test_second_look(spark):
    got = verify(spark, "{3}", "It is {4}")
    assert (got["parsed_answer"], got["strategy_verify_confirmed"], got["strategy_final_changed"]) == ("4", False, True)
    assert verify(spark, "{3}", "Yes, {4}")["parsed_answer"] == "3"
    assert verify(spark, "{3}", "incorrect, {4}")["parsed_answer"] == "3"
    assert verify(spark, "{3}", "hm")["parsed_answer"] == "3"
    missing = verify(spark, "hm", "{4}")
    assert (missing["parsed_answer"], missing["latency_s"], missing["strategy_verify_confirmed"]) == (None, 0.5, None)


def test_crops(spark):
    rows = [("a", "full", 0, "{2}"), ("a", "crop", 0, "{5}"), ("a", "crop", 1, "{5}"), ("a", "crop", 2, "x")]
    assert one(folds.crop_zoom(calls(spark, rows)))["parsed_answer"] == "5"
    deep = one(folds.crop_zoom(calls(spark, rows + [("a", "crop", 3, "{10}")], task="hierarchy_depth")))
    assert (deep["parsed_answer"], deep["strategy_full_answer"]) == ("10", "2")
    unread = [("a", "full", 0, "x"), ("a", "crop", 0, "y")]
    assert one(folds.crop_zoom(calls(spark, unread, task="hierarchy_depth")))["parsed_answer"] is None


def test_grid_size_is_rebuilt_from_lines(spark):
    rows = [
        ("a", "counting_grid", "integer", "sub", 0, "q" * 120, "{6}", 1.0, 1, 1),
        ("a", "counting_grid", "integer", "sub", 1, "r", "{9}", 1.0, 1, 1),
        ("a", "counting_grid", "row_col", "final", 0, "f", "unclear", 1.0, 1, 1),
    ]
    got = one(folds.decompose(ev.extract_answers(spark.createDataFrame(rows, SCHEMA))))
    assert got["parsed_answer"] == "5,8" and got["strategy_steps"] == 3
    assert len(got["strategy_sub_responses"][0]["prompt"]) == 100


def rounds(spark, *replies):
    return one(folds.iterative_refine(calls(spark, [("a", "round", i, r) for i, r in enumerate(replies)])))


def test_convergence(spark):
    got = rounds(spark, "{1}", "{2}", "{2}", "{7}")
    assert (got["parsed_answer"], got["strategy_rounds"], got["strategy_converged"]) == ("2", 3, True)
    got = rounds(spark, "{1}", "{2}", "x")
    assert (got["parsed_answer"], got["strategy_rounds"], got["strategy_converged"], got["raw_response"]) == ("2", 3, False, "x")
    got = rounds(spark, "x", "x")
    assert (got["parsed_answer"], got["strategy_converged"]) == (None, False)


def passes(spark, *replies):
    return one(folds.sketchpad(calls(spark, [("a", "pass", i + 1, r) for i, r in enumerate(replies)])))


def test_passes(spark):
    assert passes(spark, "TOOL(detect_boxes)", "ANSWER {4}")["parsed_answer"] == "4"
    assert passes(spark, "ANSWER {3}", "ANSWER {4}")["strategy_passes"] == 2
    assert passes(spark, "TOOL(made_up) {8}", "ANSWER {4}")["parsed_answer"] == "8"
    assert passes(spark, "TOOL(detect_boxes)", "TOOL(detect_edges) {6}")["parsed_answer"] == "6"


def test_routes(spark):
    tasks = ["pie_chart_text", "pie_chart", "counting_grid", "somewhere", "edge_crossing"]
    df = spark.createDataFrame([(t,) for t in tasks], "task_name string")
    got = [r[0] for r in df.select(folds.routed_strategy(F.col("task_name"))).collect()]
    assert got == ["sketchpad", "sketchpad", "baseline", "verify", "code_vision"]


def test_one_table_of_all_strategies_is_read_and_gathered_once(spark):
    """``fold_all`` gives each strategy what its own fold gives, from one shuffle; folds of other kinds read their own rows."""
    kinds = {
        "baseline": [("full", 0, "{1}")], "verify": [("full", 0, "{1}"), ("verify", 0, "it is {2}")],
        "best_of_n": [("sample", i, r) for i, r in enumerate(("{1}", "{2}", "{2}", "no"))],
        "best_of_n_verify": [("sample", 0, "{1}"), ("sample", 1, "{1}"), ("verify", 0, "yes, right")],
        "crop_zoom": [("full", 0, "{4}"), ("crop", 0, "{5}"), ("crop", 1, "{5}")],
        "decompose": [("sub", 0, "{4}"), ("sub", 1, "{6}"), ("final", 0, "none")],
        "code_vision": [("code", 0, "```python\nprint(1)\n```"), ("output", 0, "1"), ("final", 0, "{1}")],
        "iterative_refine": [("round", i, r) for i, r in enumerate(("{1}", "{2}", "{2}", "{3}"))],
        "sketchpad": [("pass", 0, "TOOL(count_lines)"), ("pass", 1, "ANSWER: {7}")],
    }
    rows = [(s, k, i, r, strategy) for strategy, made in kinds.items() for s in ("a", "b") for k, i, r in made]
    rows += [("c", "crop", 0, "{1}", "crop_zoom"), ("c", "crop", 0, None, "baseline")]  # no call the fold needs: no row
    df = ev.extract_answers(
        spark.createDataFrame([(s, "nested_squares", "integer", k, i, "p", r, 0.5, 10, 1, x) for s, k, i, r, x in rows], SCHEMA + ", strategy string")
    )
    whole = folds.fold_all(df)
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Scan ExistingRDD") == 1
    together = {(r["sample_id"], r["strategy"]): r.asDict() for r in whole.collect()}
    assert set(together) == {(s, x) for s in ("a", "b") for x in kinds}
    for name in kinds:
        for r in folds.FOLDS[name](df.where(F.col("strategy") == name)).collect():
            full = together[(r["sample_id"], name)]
            assert {**full, **r.asDict()} == full and all(v is None for k, v in full.items() if k not in r.asDict())
    own = {**folds.FOLDS, "verify": lambda x: x.groupBy("sample_id", "strategy").agg(F.lit("mine").alias("parsed_answer"))}
    mixed = {(r["sample_id"], r["strategy"]): r["parsed_answer"] for r in folds.fold_all(df, own).collect()}
    assert mixed == {k: "mine" if k[1] == "verify" else v["parsed_answer"] for k, v in together.items()}


def test_sketchpad_lists_its_findings(spark):
    rows = [
        ("plan", 0, "How many?", None, "nine lines"), ("plan", 1, "Where?", None, "x" * 150), ("plan", 2, "Why?", None, None),
        ("pass", 1, "p", "TOOL(count_lines)", "three"), ("pass", 2, "p", "ANSWER: {7}", None), ("pass", 3, "p", "{8}", "unused"),
    ]
    df = spark.createDataFrame(
        [("a", "nested_squares", "integer", k, i, q, r, 0.5, 10, 1, f) for k, i, q, r, f in rows], SCHEMA + ", findings string"
    )
    got = one(folds.sketchpad(ev.extract_answers(df)))
    tool = folds.dims.SKETCH_TOOLS
    if "count_lines" in tool:
        assert got["strategy_findings"] == f"[How many?] nine lines; [Where?] {'x' * 100}; [Model-requested (pass 1)] three"
        assert (got["strategy_sub_questions"], got["strategy_passes"], got["parsed_answer"]) == (3, 3, "7")
    else:
        assert (got["strategy_sub_questions"], got["strategy_passes"]) == (3, 2)


def test_calls_are_gathered_behind_one_shuffle_by_sample(spark):
    """Gathered before the shuffle, a task sorts and spills all calls it reads; texts that no fold reads are not carried."""
    rows = [("s", "decompose", kind, i, "1", "p" * 90) for i, kind in enumerate(("sub", "sub", "final"))]
    df = spark.createDataFrame(rows, "sample_id string, strategy string, pass_kind string, attempt_idx int, parsed_answer string, prompt string")
    plan = folds.fold_all(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(sample_id" in plan
    assert plan.index("ObjectHashAggregate") < plan.index("Exchange") and "ObjectHashAggregate" not in plan[plan.index("Exchange"):]
    made = folds.fold_all(df).first()
    assert [s["prompt"] for s in made["strategy_sub_responses"]] == ["p" * 90] * 2
    held = folds._gather(df, {"prompt": ("sub",)}).first()["_all"]
    assert [c["prompt"] is None for c in held] == [False, False, True]
