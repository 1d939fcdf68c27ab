"""Top-k, sampling, sweeps, geometry, graphs, sources and streaming against brute force."""

import itertools
import json
import os
import random
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from evalloom import dims
from evalloom.functions import scoring
from evalloom.operators import evaluate as ev
from evalloom.operators import strategies as st
from evalloom.operators import accuracy as acc
from evalloom.operators import audit, cot_text, gaps, generate as gen, geometry as geo, graph
from evalloom.operators import params as pm, sampling as sm, sets
from evalloom.operators import diagnostics as dg
from evalloom.operators.ranking import smallest_hashes, top_k_per_group
from evalloom.plans import fixtures as fx
from evalloom.sources import readers, writers
from evalloom.streaming.incremental import score_stream


def test_top_k_of_a_dominant_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i, (i * 7919) % 1000) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, sample_id int, v int")
    got = {(r["g"], r["rank"], r["sample_id"]) for r in top_k_per_group(df, ["g"], [F.col("v"), F.col("sample_id")], 4).collect()}
    want = set()
    for g in {r[0] for r in rows}:
        best = sorted((r[2], r[1]) for r in rows if r[0] == g)[:4]
        want |= {(g, i + 1, sample) for i, (_, sample) in enumerate(best)}
    assert got == want


def test_balanced_sample_is_repeatable(spark):
    rows = [(str(i), "a" if i % 10 else "b") for i in range(400)]
    df = spark.createDataFrame(rows, "sample_id string, c string")
    first = {r["sample_id"] for r in sm.balanced_sample(df, ["c"], 20).collect()}
    again = {r["sample_id"] for r in sm.balanced_sample(df.repartition(7), ["c"], 20).collect()}
    other = {r["sample_id"] for r in sm.balanced_sample(df, ["c"], 20, seed=1).collect()}
    assert first == again != other and len(first) == 40


def combos(spark, axes, defaults=None):
    rows = [("t", i, name, str(v), j) for i, (name, vs) in enumerate(axes.items()) for j, v in enumerate(vs)]
    config = spark.createDataFrame(rows, "task_name string, axis_no int, axis string, value string, value_no int")
    made = gen.sweep_axes(config)
    if defaults:
        made = made.withColumn("defaults", F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv]))
    return gen.sweep_combos(made)


def test_sweep_order(spark):
    axes = {"x": [1, 2], "y": ["a", "b", "c"], "z": [0, 5]}
    got = sorted((r["combo"], r["params"]) for r in combos(spark, axes, {"y": "q", "w": "k"}).collect())
    want = [dict(w="k", x=str(x), y=y, z=str(z)) for x, y, z in itertools.product(*axes.values())]
    assert [p for _, p in got] == want


def test_coverage_sample_covers_every_value(spark):
    axes = {"x": list(range(6)), "y": list(range(5)), "z": list(range(4))}
    kept = sm.coverage_sample(combos(spark, axes), 20).collect()
    assert len(kept) == 20
    for name, values in axes.items():
        assert {r["params"][name] for r in kept} == {str(v) for v in values}


def test_distractors_are_apart(spark):
    rng = random.Random(3)
    rows = [(str(i), float(rng.choice([0, 1, 7, 50, 333])), [float(rng.randint(0, 400)) for _ in range(rng.randint(0, 5))]) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, c double, o array<double>")
    wrong = gen.distractors(F.col("k"), F.col("c"), F.col("o"))
    made = df.withColumn("w", wrong).withColumn("m", gen.choice_prompt(F.col("k"), F.lit("Q?"), F.col("c"), F.col("w")))
    for r in made.collect():
        values = [r["c"], *r["o"]]
        span = max(values) - min(values) if len(values) > 1 else abs(r["c"]) or 10
        least = max(span * 0.15, 1)
        options = [r["c"], *r["w"]]
        assert len(r["w"]) == 3
        assert all(abs(a - b) >= least for a, b in itertools.combinations(options, 2))
        lines = r["m"]["prompt"].split("\n")
        assert lines[0] == "Q?" and lines[-1] == "Answer with only the letter." and len(lines) == 6
        line = next(x for x in lines if x.startswith(f"({r['m']['letter']})"))
        assert float(line[4:]) == r["c"]


def test_generated_rows_earn_full_reward(spark):
    seeds = [(s, k) for k, lo in (("direct", 0), ("intermediate_repr", 20000), ("tool_use", 40000)) for s in range(lo, lo + 400)]
    df = spark.createDataFrame(seeds, "seed long, strategy string")
    rows = gen.training_rows(df)
    assert dg.reward_failures(rows).count() == 0
    for r in rows.collect():
        low, high = {"direct": (3, 12), "intermediate_repr": (3, 15), "tool_use": (12, 25)}[r["strategy"]]
        if r["is_skip"]:
            low, high = 3, 8
        assert low <= r["rows"] <= high and low <= r["cols"] <= high
        assert "{rows}" not in r["chain_of_thought"] and "{{" not in r["chain_of_thought"]
        assert 0.85 <= r["stretch_width"] <= 1.15 and 0 <= r["pad_top"] <= 30
    assert sum(r["is_skip"] for r in rows.collect()) == 200


def test_sketch(spark):
    df = spark.createDataFrame([(2, 1), (9, 9)], "r int, c int")
    small, large = [r[0] for r in df.select(gen.grid_sketch(F.col("r"), F.col("c"))).collect()]
    assert small == "+---+\n|   |\n+---+\n|   |\n+---+"
    lines = large.split("\n")
    assert len(lines) == 18 and lines[-1] == "  ..." and lines[0] == "+" + "---+" * 8 + " ..."


def test_template_count():
    assert [len(v) for v in cot_text.TEMPLATES.values()] == [5, 5, 3, 3]


def brute_cross(a, b):
    (x1, y1, x2, y2), (x3, y3, x4, y4) = a, b
    turn = (x1 - x2) * (y3 - y4) - (y1 - y2) * (x3 - x4)
    if abs(turn) < 1e-10:
        return False
    t = ((x1 - x3) * (y3 - y4) - (y1 - y3) * (x3 - x4)) / turn
    u = -((x1 - x2) * (y1 - y3) - (y1 - y2) * (x1 - x3)) / turn
    return 0.05 < t < 0.95 and 0.05 < u < 0.95


@pytest.mark.parametrize("length", [1.0, 0.1])
def test_crossing_segments(spark, length):
    rng = random.Random(5)
    rows = []
    for i in range(260):
        x, y = rng.random(), rng.random()
        rows.append((i % 5 == 0, i, x, y, x + rng.uniform(-length, length), y + rng.uniform(-length, length)))
    rows += [(True, 900, 0.5, 0.0, 0.5, 1.0), (True, 901, 0.0, 0.5, 1.0, 0.5), (True, 902, 0.25, 0.25, 0.75, 0.75)]
    df = spark.createDataFrame(rows, "figure boolean, edge int, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r["figure"], r["edge_a"], r["edge_b"]) for r in geo.crossing_segments(df, ["figure"]).collect())
    want = sorted(
        (a[0], a[1], b[1]) for a, b in itertools.combinations(sorted(rows, key=lambda r: r[1]), 2)
        if a[0] == b[0] and brute_cross(a[2:], b[2:])
    )
    assert got == want and want


def crossings(spark, rows, most):
    df = spark.createDataFrame(rows, "figure boolean, edge int, x1 double, y1 double, x2 double, y2 double")
    got = sorted((r["figure"], r["edge_a"], r["edge_b"]) for r in geo.crossing_segments(df, ["figure"], most).collect())
    want = sorted(
        (a[0], a[1], b[1]) for a, b in itertools.combinations(sorted(rows, key=lambda r: r[1]), 2)
        if a[0] == b[0] and brute_cross(a[2:], b[2:])
    )
    assert got == want and want
    return geo.cells_of(df, ["figure"], most)


def test_crossings_beside_a_far_outlier(spark):
    """One segment a million units away; the others still lie in small cells."""
    rng = random.Random(8)
    rows = [(True, 0, 1e6, 1e6, 1e6 + 1, 1e6 + 1)]
    for i in range(1, 600):
        x, y = rng.random(), rng.random()
        rows.append((i % 3 > 0, i, x, y, x + rng.uniform(-0.05, 0.05), y + rng.uniform(-0.05, 0.05)))
    rows += [(True, 900, 0.5, 0.0, 0.5, 1.0), (True, 901, 0.0, 0.5, 1.0, 0.5), (False, 902, -3.0, -3.0, 3.0, 3.0)]
    held = crossings(spark, rows, 16).agg(F.max("n").alias("n"), F.count("*").alias("rows")).first()
    assert held["n"] <= 16 and held["rows"] < 12 * len(rows)


def test_crossings_where_many_segments_meet(spark):
    """Segments through one point and repeated ones cannot be parted by cuts: they are compared in blocks."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        dx, dy = rng.uniform(-1, 1), rng.uniform(-1, 1)
        rows.append((True, i, 5 - dx, 5 - dy, 5 + dx * 1.1, 5 + dy * 1.1))
    rows += [(True, 100 + i, 4.0, 4.5, 6.0, 5.6) for i in range(20)] + [(True, 200, 5.0, 5.0, 5.0, 5.0)]
    assert crossings(spark, rows, 8).agg(F.max("n")).first()[0] > 8


@pytest.mark.parametrize("stretch", [1, 3, 1000])
def test_sign_changes_do_not_depend_on_the_cut(spark, stretch):
    rng = random.Random(9)
    series = {k: [rng.choice([-2, -1, 0, 0, 1, 2]) for _ in range(40)] for k in "abc"} | {"z": [0] * 5, "one": [0, 3, 0]}
    df = spark.createDataFrame([(k, i, float(v)) for k, vs in series.items() for i, v in enumerate(vs)], "k string, p int, v double")
    got = {r["k"]: r["sign_changes"] for r in geo.sign_changes(df, ["k"], "p", "v", stretch).collect()}
    for k, vs in series.items():
        signs = [v > 0 for v in vs if v]
        assert got.get(k, 0) == sum(a != b for a, b in zip(signs, signs[1:]))


def test_levels(spark):
    rng = random.Random(2)
    boxes = [(g, rng.uniform(0, 900), rng.choice([10.0, 60.0])) for g in "ab" for _ in range(60)]
    df = spark.createDataFrame(boxes, "g string, y double, height double")
    got = sorted((r["g"], round(r["low"], 6), r["n"]) for r in geo.cluster_levels(df, ["g"]).collect())
    want = []
    for g in "ab":
        limit = max(0.5 * sum(b[2] for b in boxes if b[0] == g) / 60, 15)
        levels = []
        for y in sorted(b[1] for b in boxes if b[0] == g):
            if levels and y - levels[-1][-1] <= limit:
                levels[-1].append(y)
            else:
                levels.append([y])
        want += [(g, round(v[0], 6), len(v)) for v in levels]
    assert got == sorted(want)


def test_walks_end_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 6), (1, 2)], "src long, dst long")
    starts = spark.createDataFrame([(1,), (4,), (5,)], "start long")
    got = {tuple(r) for r in graph.reachable_terminals(edges, starts).collect()}
    assert got == {(1, 4), (4, 4), (5, 6)}


@pytest.mark.parametrize("seed", [0, 2])
def test_terminals_of_random_graphs(spark, seed):
    """Cycles with and without exits, long chains, loops on one node, starts that are no nodes, several graphs."""
    rng = random.Random(seed)
    edges = [(g, rng.randrange(30), rng.randrange(30)) for g in "ab" for _ in range((25, 32, 45)[seed])]
    edges += [("a", 100 + i, 101 + i) for i in range(25)] + [("a", 3, 100), ("a", 200, 201), ("a", 201, 202), ("a", 202, 200), ("a", 3, 200), ("b", 300, 300)]
    starts = [(g, rng.randrange(30)) for g in "ab" for _ in range(9)] + [("a", 3), ("a", 200), ("b", 300), ("b", 999), ("a", 112)]
    onward = {}
    for g, a, b in edges:
        onward.setdefault((g, a), set()).add(b)
    want = set()
    for g, s in starts:
        seen, todo = {s}, [s]
        while todo:
            new = onward.get((g, todo.pop()), set()) - seen
            seen |= new
            todo += new
        want |= {(g, s, x) for x in seen if (g, x) not in onward}
    e = spark.createDataFrame(edges, "g string, src long, dst long")
    got = graph.reachable_terminals(e, spark.createDataFrame(starts, "g string, start long"), ("g",)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    pairs = {tuple(r) for r in graph.reachable(e, spark.createDataFrame(starts, "g string, start long"), ("g",)).collect()}
    assert {p for p in pairs if (p[0], p[2]) not in onward} == want


def test_depth(spark):
    chain = [("a", i, i - 1 if i else None) for i in range(37)]
    nodes = spark.createDataFrame(chain + [("b", 0, None), ("b", 1, 0), ("b", 2, 0)], "tree string, node int, parent int")
    assert {tuple(r) for r in graph.tree_depth(nodes).collect()} == {("a", 37), ("b", 2)}


def test_depth_of_compressible_pointers_is_not_broadcast(spark, monkeypatch):
    """Files of a chain are tiny against its rows, so no round may broadcast by their size; short trees are set aside."""
    plans, keep = [], graph.stored

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, name)

    monkeypatch.setattr(graph, "stored", watched)
    chain = [(1, i, i - 1 if i else None) for i in range(300)]
    short = [(t, i, i - 1 if i else None) for t in (2, 3) for i in range(t)]
    nodes = spark.createDataFrame([*chain, *short, (4, 9, 8), (None, 1, None)], "tree long, node long, parent long")
    assert {tuple(r) for r in graph.tree_depth(nodes).collect()} == {(1, 300), (2, 2), (3, 3), (4, 2), (None, 1)}
    assert len(plans) > 8 and not any("BroadcastExchange" in p for p in plans)
    monkeypatch.setattr(graph, "TREES", 1)
    assert {tuple(r) for r in graph.tree_depth(nodes).collect()} == {(1, 300), (2, 2), (3, 3), (4, 2), (None, 1)}


def test_answer_keys(spark):
    rows = [
        ("arrow_following", {"edges": [["A", "B"], ["B", "C"], ["A", "D"], ["X", "Y"]], "start_box": "A"}, "", "C,D"),
        ("arrow_following", {"edges": [], "start_box": "Q"}, "", "Q"),
        ("venn_diagram", {"question_type": "intersection", "item_regions": {"b": "S ∩ T", "a": "S ∩ T ∩ U", "c": "S"}},
         "Which items are in BOTH S AND T? List", "a, b"),
        ("venn_diagram", {"question_type": "exclusive", "item_regions": {"b": "S ∩ T"}},
         "Which items are ONLY in S and not in any other set?", "None"),
        ("venn_diagram", {"question_type": "union_minus", "item_regions": {"b": "S ∩ T", "c": "S"}},
         "Which items are in S but NOT in T? List", "c"),
        ("line_chart_crossing", {"series_a": [1, 2, 3, 1], "series_b": [2, 2, 1, 5]}, "", "2"),
        ("counting_grid", {"question_type": "total_cells", "rows": 4, "cols": 5, "merges": [[0, 0, 2, 2], [3, 0, 1, 2]]}, "", "16"),
        ("table_cell_read", {"table": [[1, 2], [3, 4]], "target_row": 2, "target_col": 1}, "", "3"),
        ("merged_cell_read", {"merges": [{"r": 1, "c": 2, "sr": 1, "sc": 3, "label": "L"}]},
         "What text is in the cell that spans columns 3-5 in row 2? Put", "L"),
        ("highlighted_text", {"highlighted_words": ["pear", "Apple", "fig"]}, "", "Apple,fig,pear"),
        ("color_coded_cells", {"target_cells": ["B1", "A2"]}, "", "A2,B1"),
        ("colored_paths_text", {"path_details": [{"color": "r", "from": "A", "to": "B"}, {"color": "b", "from": "B", "to": "A"}]},
         "How many direct paths connect A to B? Answer", "1"),
        ("touching_circles", {"distance": -0.1}, "", "Yes"),
        ("edge_crossing", {"edges": [["A", "B"]], "query": ["B", "A"]}, "", "Yes"),
        ("edge_crossing", {"edges": [["A", "B"]], "query": ["B", "C"]}, "", "No"),
        ("nothing_known", {}, "", None),
    ]
    df = spark.createDataFrame(
        [(str(i), t, json.dumps(p), q, e) for i, (t, p, q, e) in enumerate(rows)],
        "sample_id string, task_name string, params string, prompt string, ground_truth string",
    )
    got = {int(r["sample_id"]): (r["expected"], r["matches"]) for r in audit.audit_manifest(df).collect()}
    assert [(rows[i], got[i]) for i in got if got[i][0] != rows[i][3]] == []


def test_nested_params(spark):
    df = spark.createDataFrame(
        [("t", True, '{"a": 1, "b": {"c": {"d": 2}, "e": "x"}, "l": [1]}'), ("t", False, '{"a": 2, "b": {"c": {"d": 2}}, "m": null}')],
        "task_name string, correct boolean, params string",
    )
    flat = {(r["param"], r["value"], r["value_type"]) for r in pm.param_strings(df).collect()}
    assert {("a", "1", "BIGINT"), ("b.c.d", "2", "BIGINT"), ("b.e", "x", "STRING"), ("l", "[1]", "ARRAY")} <= flat
    assert [(r["param"], r["value"], r["accuracy"]) for r in pm.accuracy_by_param(df).orderBy("value").collect()] == [("a", "1", 1.0), ("a", "2", 0.0)]


def test_invariants_on_the_test_tables(spark, sf_dir):
    results = fx.results(spark, sf_dir)
    summary = {r["task_name"]: r for r in acc.accuracy_summary(results).collect()}
    total = summary.pop("TOTAL")
    assert total["n"] == sum(r["n"] for r in summary.values()) == results.count()
    assert all(0 <= r["ci_lo"] <= r["accuracy"] <= r["ci_hi"] <= 1 for r in summary.values())
    kinds = {r["failure_class"] for r in gaps.full_diagnostic(results).collect()}
    assert {"perceptual", "not_a_failure"} <= kinds


def test_no_rows(spark, sf_dir):
    results = fx.results(spark, sf_dir).where("false")
    assert acc.accuracy_summary(results).count() == 0
    assert gaps.full_diagnostic(results).count() == 0
    assert acc.confusion(results).count() == 0


def test_control_without_its_task_stands_alone(spark):
    df = spark.createDataFrame(
        [("a", True), ("a_text", True), ("b_text", False), ("c", False)], "task_name string, correct boolean"
    )
    got = {r["task_name"]: (r["image_acc"], r["text_acc"]) for r in gaps.full_diagnostic(df).collect()}
    assert got == {"a": (1.0, 1.0), "b_text": (0.0, None), "c": (0.0, None)}


def test_malformed_lines(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    path.write_text('{"sample_id": "1", "params": {"a": [1, 2]}}\n\n{"sample_id": "2"}\n')
    got = [r["params"] for r in readers.read_results(spark, str(path)).orderBy("sample_id").collect()]
    assert json.loads(got[0]) == {"a": [1, 2]} and got[1] is None
    path.write_text('{"sample_id": "1"}\n{"sample_id": \n{"other": 3}\n{"sample_id": "1"}\n')
    assert [r[0] for r in readers.read_completed(spark, str(path)).collect()] == ["1"]
    with pytest.raises(Exception):
        readers.read_results(spark, str(path)).collect()
    assert readers.read_completed(spark, str(tmp_path / "absent")).count() == 0


def dropped(folder, name, *rows):
    (folder / "in").mkdir(exist_ok=True)
    lines = [json.dumps(dict(sample_id=i, parser="integer", scorer="exact_match", ground_truth="3", raw_response=r)) for i, r in rows]
    (folder / "in" / name).write_text("\n".join(lines))


def test_streamed_rows_are_scored_once(spark, tmp_path):
    """Three batches with restarts between them; the last one is run again and leaves the same rows."""
    source, sink, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    dropped(tmp_path, "a.json", ("1", "{3}"), ("2", "{4}"), ("1", "{3}"))
    score_stream(spark, source, sink, marks).awaitTermination()
    dropped(tmp_path, "b.json", ("2", "{3}"), ("3", "{3}"))
    score_stream(spark, source, sink, marks).awaitTermination()
    dropped(tmp_path, "c.json", ("1", "{4}"), ("4", "{4}"), (None, "{3}"), (None, "{3}"))
    score_stream(spark, source, sink, marks).awaitTermination()

    def rows():
        return sorted((r["batch_id"], str(r["sample_id"]), r["correct"]) for r in spark.read.parquet(sink).collect())

    got = rows()
    assert got == [(0, "1", True), (0, "2", False), (1, "3", True), (2, "4", False), (2, "None", True)]
    for mark in (tmp_path / "marks" / "commits").glob("*2*"):  # as if the driver was lost before the commit
        mark.unlink()
    dropped(tmp_path, "d.json", ("4", "{3}"), ("5", "{3}"))
    score_stream(spark, source, sink, marks).awaitTermination()
    assert rows() == [*got, (3, "5", True)]


def test_a_batch_reads_no_history(spark, tmp_path):
    """What is left of the sink and the source after a batch is not looked at by the next one."""
    source, sink, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    dropped(tmp_path, "a.json", *[(str(i), "{3}") for i in range(300)])
    score_stream(spark, source, sink, marks).awaitTermination()
    for file in (tmp_path / "out" / "batch_id=0").glob("*.parquet"):
        file.unlink()
    (tmp_path / "in" / "a.json").unlink()
    dropped(tmp_path, "b.json", ("7", "{3}"), ("300", "{3}"))
    query = score_stream(spark, source, sink, marks)
    query.awaitTermination()
    assert [r["sample_id"] for r in spark.read.parquet(f"{sink}/batch_id=1").collect()] == ["300"]
    assert query.lastProgress["numInputRows"] == 2 and query.lastProgress["stateOperators"][0]["numRowsUpdated"] == 1


def test_ids_can_be_forgotten(spark, tmp_path):
    """With an allowance for repeats, an id that comes again long after is new."""
    source, sink, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    for n, (name, age) in enumerate((("a", 500), ("b", 499.5), ("c", 300), ("d", 100))):
        dropped(tmp_path, f"{name}.json", ("1", "{3}"), (f"x{n}", "{3}"))
        when = 1_700_000_000 - age * 3600
        os.utime(tmp_path / "in" / f"{name}.json", (when, when))
        score_stream(spark, source, sink, marks, repeats_within="24 hours").awaitTermination()
    got = [r["sample_id"] for r in spark.read.parquet(sink).collect()]
    assert 2 <= got.count("1") <= 3 and {f"x{n}" for n in range(4)} <= set(got)


def test_a_sink_belongs_to_one_checkpoint(spark, tmp_path):
    dropped(tmp_path, "a.json", ("1", "{3}"))
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    score_stream(spark, source, sink, str(tmp_path / "m1")).awaitTermination()
    with pytest.raises(ValueError, match="does not know"):
        score_stream(spark, source, sink, str(tmp_path / "m2"))


def test_episodes_come_in_order_of_files(spark, tmp_path):
    """A small first file and a large second one, which tasks read the other way round."""
    for name, n in (("a", 5), ("b", 300)):
        lines = [f'{{"response": "{name}{i:03d}", "ground_truth": "1,1"}}' for i in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
    want = [f"a{i:03d}" for i in range(5)] + [f"b{i:03d}" for i in range(300)]
    rows = readers.read_episodes(spark, str(tmp_path))
    assert [r["response"] for r in rows.orderBy("episode_id").collect()] == want
    assert sorted(r["response"] for r in readers.read_episodes(spark, str(tmp_path), n=7).collect()) == want[:7]


def test_deep_parameters(spark):
    """Any depth, nulls, empty objects and lists, odd names; texts that are no objects have no leaves. One scan, no join."""
    deep = "".join(f'{{"k{i}":' for i in range(30)) + "1" + "}" * 30
    df = spark.createDataFrame(
        [
            ("t", '{"a":{"b":{"c":{"d":{"e":1}}}},"l":[{"x":1}],"n":null,"o":{},"s":"5"}'), ("t", '{"a":7}'), ("t", "not json"), ("t", None),
            ("t", "[1]"), ("t", "3"), ("t", deep), ("u", '{"OBJECT<":{"y.z":true}, "q":{"r":1.5,"p":{"m":"x"}}}'),
        ],
        "task_name string, params string",
    )
    flat = pm.param_strings(df)
    got = {(r["param"], r["value"], r["value_type"]) for r in flat.collect()}
    assert got == {
        ("a.b.c.d.e", "1", "BIGINT"), ("l", '[{"x":1}]', "ARRAY"), ("n", None, "VOID"), ("o", None, None), ("s", "5", "STRING"), ("a", "7", "BIGINT"),
        (".".join(f"k{i}" for i in range(30)), "1", "BIGINT"), ("OBJECT<.y.z", "true", "BOOLEAN"), ("q.r", "1.5", "DECIMAL"), ("q.p.m", "x", "STRING"),
    }
    plan = flat._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and plan.count("Scan ExistingRDD") == 1


def test_confusion_over_observed_labels(spark):
    df = spark.createDataFrame([("t", "15", "15")] * 6 + [("t", "2", "15")], "task_name string, parsed_answer string, ground_truth string")
    got = {(r["predicted"], r["truth"]): r["n"] for r in acc.confusion_table(df).collect()}
    assert got == {(15, 15): 6, (2, 15): 1, (2, 2): 0, (15, 2): 0}


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_confusion_in_blocks(spark, block):
    rng = random.Random(block)
    rows = [(t, str(rng.randrange(12)), str(rng.randrange(12))) for t in "ab" for _ in range(40)] + [("few", "1", "1")]
    df = spark.createDataFrame(rows, "task_name string, parsed_answer string, ground_truth string")
    got = {(r["task_name"], r["predicted"], r["truth"]): r["n"] for r in acc.confusion_table(df, block).collect()}
    want = {}
    for t in "ab":
        labels = {int(x) for r in rows if r[0] == t for x in r[1:]}
        want |= {(t, p, q): sum(r == (t, str(p), str(q)) for r in rows) for p in labels for q in labels}
    assert got == want


def test_keep_that_differs_by_task(spark):
    """Only about as many rows as are kept pass the threshold, whatever the size of the task."""
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "small").when(F.col("id") % 500 == 1, "tiny").otherwise("hot").alias("task_name"), F.col("id").alias("combo"),
    ).withColumn("_h", sm.hash_text(1, F.col("task_name"), F.col("combo")))
    keep = F.when(F.col("task_name") == "hot", 40).when(F.col("task_name") == "tiny", 1_000).otherwise(0)
    near = smallest_hashes(rows, ["task_name"], "_h", keep).collect()
    held = {t: sorted(r["_h"] for r in near if r["task_name"] == t) for t in ("hot", "tiny", "small")}
    assert 40 <= len(held["hot"]) <= 160 and len(held["small"]) == 0
    hot, tiny = (sorted(r["_h"] for r in rows.where(F.col("task_name") == t).select("_h").collect()) for t in ("hot", "tiny"))
    assert held["hot"][:40] == hot[:40] and held["tiny"] == tiny
    made = rows.withColumns({"params": F.create_map(F.lit("a"), (F.col("combo") % 7).cast("string")), "axes": F.array(F.lit("a"))})
    kept = sm.coverage_sample(made.drop("_h"), keep).collect()
    by = {t: [r for r in kept if r["task_name"] == t] for t in ("hot", "tiny", "small")}
    assert len(by["hot"]) == 40 and len(by["tiny"]) == len(tiny) and not by["small"]
    assert {r["params"]["a"] for r in by["hot"] if r["for_coverage"]} == set("0123456")


def test_failed_calls_are_rows(spark, tmp_path):
    def model(batch):
        if (batch["sample_id"] == "s3").any():
            raise RuntimeError("down")
        return batch.assign(raw_response="r" + batch["sample_id"])[["sample_id", "raw_response"]]

    rows = spark.createDataFrame([(f"s{i}",) for i in range(8)], "sample_id string")
    path = str(tmp_path / "run")
    first = {r["sample_id"]: (r["raw_response"], r["error_message"]) for r in ev.run_to(rows, path, model, "sample_id string, raw_response string", rows_per_wave=3).collect()}
    assert first["s3"] == (None, "RuntimeError: down") and first["s4"] == ("rs4", None) and len(first) == 8
    assert ev.run_to(rows, path, model, "sample_id string, raw_response string").count() == 8


def test_cycles_of_parents_are_refused(spark):
    nodes = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "tree long, node long, parent long")
    with pytest.raises(RuntimeError, match="cycle"):
        graph.tree_depth(nodes)


def test_unlisted_names(spark):
    df = spark.createDataFrame([("t", "mine", True), ("t", "baseline", False)], "task_name string, strategy string, correct boolean")
    assert st.best_strategies(df).first()["best_strategy"] == "mine"
    with pytest.raises(Exception, match="not a listed strategy: mine"):
        st.task_matrix(df, "strategy", ["baseline"]).collect()


def models():
    """A model that fails on one sample, and one that answers another way (made here, so that tasks get them whole)."""

    def answer(batch):
        if (batch["sample_id"] == "s3").any():
            raise RuntimeError("down")
        return batch.assign(raw_response="r" + batch["sample_id"])[["sample_id", "raw_response"]]

    def later(batch):
        return batch.assign(raw_response="later " + batch["sample_id"])[["sample_id", "raw_response"]]

    return answer, later


def test_waves_are_committed_one_by_one(spark, tmp_path):
    """A broken wave has no marker and is done again; finished ones are left alone; new rows run in their own wave only."""
    _answer, _later = models()
    kind, path = "sample_id string, raw_response string", str(tmp_path / "run")
    rows = spark.createDataFrame([(f"s{i}", i) for i in range(40)], "sample_id string, n long")
    whole = {r["sample_id"]: r["raw_response"] for r in ev.run_to(rows, path, _answer, kind, rows_per_wave=10, rows_per_task=4).collect()}
    assert whole == {f"s{i}": f"rs{i}" if i != 3 else None for i in range(40)}
    marks = sorted(p.name for p in (tmp_path / "run" / "_committed").iterdir() if p.name.startswith("wave"))
    assert len(marks) == 4
    (tmp_path / "run" / "_committed" / marks[2]).unlink()  # as if the driver was lost before the marker
    held = spark.read.parquet(f"{path}/batch={marks[2]}").count()
    assert ev.read_run(spark, path).count() == 40 - held
    again = {r["sample_id"]: r["raw_response"] for r in ev.run_to(rows, path, _later, kind, rows_per_wave=3).collect()}
    assert len(again) == 40 and sum(v is not None and v.startswith("later") for v in again.values()) == held
    times = {p: p.stat().st_mtime_ns for p in (tmp_path / "run").glob("batch=*/*.parquet")}
    assert ev.run_to(rows, path, _later, kind).count() == 40  # nothing to do: no model call, no file
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "run").glob("batch=*/*.parquet")} == times
    more = rows.unionByName(spark.createDataFrame([("new", 1)], rows.schema))
    assert {r["sample_id"]: r["raw_response"] for r in ev.run_to(more, path, _later, kind).collect()} == again | {"new": "later new"}
    assert len(list((tmp_path / "run").glob("batch=*"))) == 5


def test_failing_rows_are_found_in_parts():
    """Every tenth row fails: all are found, none is lost, and good rows do not cost a call each."""
    calls = []

    def model(batch):
        calls.append(len(batch))
        if (batch["n"] % 10 == 3).any():
            raise ValueError("no three")
        return batch.assign(raw_response="r" + batch["sample_id"])[["sample_id", "raw_response"]]

    batch = pd.DataFrame({"sample_id": [f"s{i}" for i in range(2000)], "n": range(2000)})
    made = pd.concat(ev._with_errors(model, ["sample_id", "raw_response", "error_message"])(iter([batch, batch[3:4]])))
    got = {r.sample_id: (r.raw_response, r.error_message) for r in made.itertuples()}
    assert len(made) == 2001 and got == {
        f"s{i}": (None, "ValueError: no three") if i % 10 == 3 else (f"rs{i}", None) for i in range(2000)
    }
    assert len(calls) < 2000, len(calls)


def test_many_small_waves_run_in_few_rounds(spark, tmp_path, monkeypatch):
    """The number of jobs is set by the rows, not by the waves; a wave is still skipped, resumed and replaced by itself."""
    _answer, _later = models()
    kind, path = "sample_id string, raw_response string", str(tmp_path / "run")
    monkeypatch.setattr(ev, "ROUNDS", 4)
    rows = spark.createDataFrame([(f"s{i}",) for i in range(60)], "sample_id string")
    first = {r["sample_id"]: r["raw_response"] for r in ev.run_to(rows, path, _answer, kind, rows_per_wave=3).collect()}
    assert first == {f"s{i}": f"rs{i}" if i != 3 else None for i in range(60)}
    assert len(list((tmp_path / "run").glob("batch=*"))) == 4
    more = rows.unionByName(spark.createDataFrame([("new",)], rows.schema))
    grown = {r["sample_id"]: r["raw_response"] for r in ev.run_to(more, path, _later, kind).collect()}
    assert grown == first | {"new": "later new"}
    tried = {r["sample_id"]: r["raw_response"] for r in ev.run_to(more, path, _later, kind, retry_errors=True).collect()}
    assert tried == grown | {"s3": "later s3"} and ev.read_run(spark, path).count() == 61
    assert ev.run_to(more, path, _answer, kind, retry_errors=True).count() == 61
    assert len(list((tmp_path / "run").glob("batch=*"))) == 6


def test_errors_are_tried_again_when_asked(spark, tmp_path):
    _answer, _later = models()
    kind, path = "sample_id string, raw_response string", str(tmp_path / "run")
    rows = spark.createDataFrame([(f"s{i}",) for i in range(12)], "sample_id string")
    ev.run_to(rows, path, _answer, kind, rows_per_wave=4)
    assert ev.run_to(rows, path, _later, kind).where("error_message IS NOT NULL").count() == 1
    tried = ev.run_to(rows, path, _later, kind, retry_errors=True).collect()
    assert sorted(r["raw_response"] for r in tried) == sorted(f"rs{i}" if i != 3 else "later s3" for i in range(12))
    assert all(r["error_message"] is None for r in tried)
    assert ev.run_to(rows, path, _answer, kind, retry_errors=True).count() == 12


def test_runs_of_nothing_and_into_other_tables(spark, tmp_path):
    _answer, _later = models()
    kind = "sample_id string, raw_response string"
    none = spark.createDataFrame([], "sample_id string")
    assert ev.run_to(none, str(tmp_path / "none"), _answer, kind).collect() == []
    spark.range(3).write.parquet(str(tmp_path / "other"))
    with pytest.raises(ValueError, match="something else"):
        ev.run_to(none, str(tmp_path / "other"), _answer, kind)


def test_appends_can_be_repeated(spark, tmp_path):
    """The same batch twice gives its rows once, and what an unfinished append left is replaced."""
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([("1", "t", True), ("2", "t", False)], "sample_id string, task_name string, correct boolean")
    assert readers.read_batches(spark, path).count() == 0
    rows.write.json(f"{path}/batch=a")  # an append whose driver was lost
    assert readers.read_batches(spark, path).count() == 0
    assert writers.append_results(rows, path, batch_id="a") and not writers.append_results(rows, path, batch_id="a")
    assert writers.append_results(rows.limit(1), path, batch_id="b")
    got = readers.read_batches(spark, path)
    assert sorted(r["sample_id"] for r in got.collect()) == ["1", "1", "2"] and "batch" not in got.columns
    with pytest.raises(ValueError, match="batch id"):
        writers.append_results(rows, path, batch_id="../up")


def test_scorers_of_ones_own(spark):
    df = spark.createDataFrame([("1", "shout", "same", "yes", "YES")], "sample_id string, parser string, scorer string, raw_response string, ground_truth string")
    got = ev.evaluate(df, {"shout": F.upper}, {"same": scoring.SCORERS["exact_match"]}).first()
    assert (got["parsed_answer"], got["correct"]) == ("YES", True) and "same" not in scoring.SCORERS


def test_sets(spark):
    """Membership of several sets against Python's, null items among them."""
    rng = random.Random(6)
    rows = [(rng.choice("abcd"), rng.randrange(12)) for _ in range(60)] + [("a", None), ("b", None), ("c", 99)]
    df = spark.createDataFrame(rows, "set string, item int")
    held = {n: {i for s, i in rows if s == n} for n in "abcd"}
    one = lambda x: {r["item"] for r in x.collect()}
    assert one(sets.in_all(df, ["a", "b"])) == held["a"] & held["b"]
    assert one(sets.in_all(df, ["a", "b", "c"])) == held["a"] & held["b"] & held["c"]
    assert one(sets.in_first_only(df, "a", ["b", "c"])) == held["a"] - held["b"] - held["c"]
    alone = {(i, n) for n in "abcd" for i in held[n] if sum(i in held[m] for m in "abcd") == 1}
    assert {tuple(r) for r in sets.in_one_only(df).collect()} == alone and (99, "c") in alone
    p, q = spark.createDataFrame([("x", 1), ("x", 2), ("y", 5)], "key string, n long"), spark.createDataFrame([("y", 1), ("z", 7)], "key string, n long")
    assert {tuple(r) for r in sets.counts_of_either(p, q).collect()} == {("x", 3, 0), ("y", 5, 1), ("z", 0, 7)}
    plan = sets.in_all(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and "Join" not in plan


def test_scratch_folder_is_shared(spark):
    from evalloom.storage import shared_folder

    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_choices_are_dealt_to_all_cores(spark, sf_dir):
    """Few bytes hold many parts, and their wrong values take long: one split of a file may not make them all."""
    from evalloom.plans import build_queries as bq

    for name in ("gen4", "gen5", "gen5_format"):
        plan = getattr(bq, name)(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(p_partkey" in plan
        assert plan.count("42other") == 1  # made once a row


def test_one_strategy_is_made_alone(spark):
    from evalloom.plans import fixtures as fx

    folder = "/root/testdata/sf0.001"
    one = fx.strategy_results(spark, folder, "verify")
    same = fx.strategy_results(spark, folder).where("strategy = 'verify'")
    assert one.columns == same.columns and sorted(map(tuple, one.collect())) == sorted(map(tuple, same.collect()))
    assert "Generate" not in one._jdf.queryExecution().executedPlan().toString()


def test_what_strategies_share_is_made_once(spark):
    folder = "/root/testdata/sf0.001"
    events = fx.judged_events(spark, folder)
    same = fx.strategy_results(spark, folder).collect()
    got = [r for s in dims.STRATEGIES for r in fx.results_of(events, s).collect()]
    assert sorted(map(tuple, got)) == sorted(map(tuple, same)) and len(got) == len(dims.STRATEGIES) * events.count()
    plain = spark.createDataFrame(events.collect(), events.schema)
    assert "get_json_object" not in fx.results_of(plain, "verify")._jdf.queryExecution().optimizedPlan().toString()


def test_nulls_of_events_stay_nulls_of_their_results(spark, tmp_path):
    rows = [(1, 3, None), (1, 3, None), (2, None, '{"k": 4}'), (3, 5, "{}"), (4, 25, '{"k": 17}'), (5, 14, "")]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, props string").write.parquet(f"{tmp_path}/events.parquet")
    every = fx.strategy_results(spark, str(tmp_path)).where("strategy = 'crop_zoom'").collect()
    alone = fx.results_of(fx.judged_events(spark, str(tmp_path)), "crop_zoom").collect()
    assert sorted(map(repr, alone)) == sorted(map(repr, every)) and len(alone) == len(rows)


def test_runs_are_named_by_the_folders_above_them(spark, tmp_path):
    names = ["plain/verify", "a b/x+y", "50%/ü", "r%2Fs/100%25"]
    for i, name in enumerate(names):
        os.makedirs(tmp_path / "in" / name)
        (tmp_path / "in" / name / "results.jsonl").write_text(f'{{"sample_id": "{i}"}}\n')
    os.makedirs(tmp_path / "in" / "many/files/results.jsonl")
    for part in "12":
        (tmp_path / "in" / "many/files/results.jsonl" / f"part-{part}").write_text('{"sample_id": "9"}\n')
    got = [tuple(r) for r in readers.read_runs(spark, str(tmp_path / "in")).select("sample_id", "run_model", "run_strategy").collect()]
    made = [(str(i), *name.replace("+", " ").split("/")) for i, name in enumerate(names)]
    assert sorted(got) == sorted([*made, ("9", "many", "files"), ("9", "many", "files")])
    # places that folders above may have: the first name with two folders before it counts
    paths = ["file:///results.jsonl/m/s/results.jsonl/p", "s3://b/results.jsonl.d/m/s/results.jsonl", "dbfs:/results.jsonl/m/s/results.jsonl",
             "file:/s/results.jsonl", "file:///s/results.jsonl", "a/b/results.jsonl/m/s/results.jsonl", "/x/y/none", "results.jsonl", ""]
    model, strategy = readers._run_of(F.col("p"))
    for row in spark.createDataFrame([(p,) for p in paths], "p string").select("p", model.alias("m"), strategy.alias("s")).collect():
        found = re.search(r"([^/]+)/([^/]+)/results\.jsonl", row["p"])
        assert (row["m"], row["s"]) == (found.groups() if found else ("", "")), row["p"]


def test_long_paths_of_runs_cost_little_a_row(spark, tmp_path):
    root = tmp_path
    for _ in range(10):
        root = root / ("f" * 200)
    os.makedirs(root / "m" / "s")
    (root / "m" / "s" / "results.jsonl").write_text('{"task_name": "t", "correct": true}\n' * 10000)
    began = time.perf_counter()
    got = acc.tally(readers.read_runs(spark, str(root)), "run_model", "run_strategy", "task_name").select("run_model", "run_strategy", "n", "n_correct").collect()
    assert [tuple(r) for r in got] == [("m", "s", 10000, 10000)]
    assert time.perf_counter() - began < 15  # the pattern tried from each place took several times as long
