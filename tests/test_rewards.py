"""Rewards and checks for reward gaming."""

import math

import pytest
from pyspark.sql import functions as F

from evalloom.functions import rewards
from evalloom.operators import diagnostics as dg

CODE = "```python\nprint(1)\n```\n"
OUT = "```output\n{}\n```\n"
CASES = [
    # response, truth, outcome, process, tool_use
    ("rows=3 columns=4", "3,4", 1.0, 1.0, 1.0),
    ("rows=3 columns=4 then rows=5 columns=4", "3,4", 0.0, 0.0, 0.0),
    ("no answer", "3,4", 0.0, 0.0, 0.0),
    ("4 horizontal lines → 3 rows. rows=3 columns=9", "3,4", 0.0, 0.2, 0.0),
    ("4 lines means 4 rows. rows=9 columns=9", "3,4", 0.0, 0.0, 0.0),
    ("4 - 1 = 3 rows, 6 - 1 = 5 columns. rows=3 columns=9", "3,4", 0.0, 0.0, 0.0),
    ("I see 4 lines in all, rows = 3. 3x9", "3,4", 0.0, 0.2, 0.0),
    (CODE + "rows=3 columns=4", "3,4", 1.0, 1.0, 0.7),
    (CODE + OUT.format("3 rows, 4 columns") + "rows=9 columns=9", "3,4", 0.0, 0.0, 0.5),
    (CODE + OUT.format("7 x 7") + "rows=9 columns=9", "3,4", 0.0, 0.0, 0.0),
    (CODE + OUT.format("7 x 7") + "rows=3 columns=4", "3,4", 1.0, 1.0, 1.0),
    (CODE + OUT.format("done") + "rows=3 columns=4", "3,4", 1.0, 1.0, 1.0),
    (CODE + OUT.format("hm") + OUT.format("3 x 4") + "rows=1 columns=1", "3,4", 0.0, 0.0, 0.5),
]


def test_rewards(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "i int, response string, ground_truth string")
    for row in dg.add_rewards(df, ["outcome", "process", "tool_use"]).collect():
        want = CASES[row["i"]]
        got = (row["reward_outcome"], row["reward_process"], row["reward_tool_use"])
        assert got == pytest.approx(want[2:]), want


def test_consistency_reads_the_nearest_dimension(spark):
    texts = {
        "5 - 1 = 4 columns and rows. rows=9 columns=4": 1.0,
        "5 - 1 = 4 columns and rows. rows=4 columns=9": 0.0,
        "5 - 1 = 4 " + "." * 70 + " rows. rows=9 columns=9": 1.0,
        "5 - 1 = 4 rows. 5 - 1 = 4 cols.": 1.0,
    }
    df = spark.createDataFrame([(t,) for t in texts], "r string")
    got = {r[0]: r[1] for r in df.select("r", rewards.consistency(F.col("r"))).collect()}
    assert got == texts


def episodes(spark, rows):
    """rows: (response, truth, confidence, logprob)."""
    flat = [(i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(flat, "episode_id long, response string, ground_truth string, confidence double, logprob double")
    return df.withColumn("metadata", F.struct("confidence", "logprob")).drop("confidence", "logprob")


def answer(rows, cols):
    return f"rows={rows} columns={cols}"


def test_clean_run_raises_nothing(spark):
    rows = [(answer(3 + i % 20, 4), f"{3 + i % 20},4", None, None) for i in range(60)]
    rows += [(answer(1, 1), f"{3 + i % 3},4", None, None) for i in range(4)]
    report = dg.report(dg.profile(episodes(spark, rows))).first()
    assert report["flags"] == [] and report["n_flags"] == 0
    assert report["calibration_status"]["status"] == "no_confidence_data"


def test_gaming_is_flagged(spark):
    rows = [(CODE + "4 - 1 = 3 rows. " + answer(5, 5), f"{3 + i % 6},5", 0.95, None) for i in range(60)]
    report = dg.report(dg.profile(episodes(spark, rows))).first()
    kinds = [f.split(":")[0].split(" on ")[0] for f in report["flags"]]
    assert kinds == ["DOMINANT PREDICTION", "LOW COT CONSISTENCY", "TOOL OVERUSE", "OVERCONFIDENCE"]
    flat = [(answer(1, 1), f"{3 + i % 6},5", None, None) for i in range(60)]
    assert any("FLAT" in f for f in dg.report(dg.profile(episodes(spark, flat))).first()["flags"])


def test_divergence(spark):
    preds = ["3,4"] * 6 + ["5,5"] * 3 + [None]
    truths = ["3,4"] * 5 + ["4,4"] * 5
    rows = [("none" if p is None else answer(*p.split(",")), t, None, None) for p, t in zip(preds, truths)]
    got = dg.answer_distribution(dg.profile(episodes(spark, rows))).first()
    want = 0.6 * math.log(0.6 / 0.5) + 0.3 * math.log(0.3 / 0.1) + 0.1 * math.log(0.1 / 0.1)
    assert got["kl_divergence"] == pytest.approx(round(want, 4))
    assert [tuple(t) for t in got["top_answers"]] == [("3,4", 6), ("5,5", 3), ("UNPARSED", 1)]
    assert (got["n_unique"], got["dominant"]) == (3, True)


def test_zero_confidence_falls_back(spark):
    rows = [(answer(3, 3), "3,3", 0.0, 0.4), (answer(3, 3), "3,3", 0.6, None), (answer(3, 3), "3,3", 0.0, None)]
    prof = dg.profile(episodes(spark, rows))
    assert {(r["confidence_bin"], r["n"]) for r in dg.calibration(prof).collect()} == {("0.3-0.5", 1), ("0.5-0.7", 1)}
    assert dg.calibration_status(prof).first()["n_with_confidence"] == 2


def test_no_episodes(spark):
    prof = dg.profile(episodes(spark, [(answer(1, 1), "1,1", None, None)]).where("false"))
    assert dg.answer_distribution(prof).count() == 0
    assert dg.step_consistency(prof).count() == 0
    assert [r["n"] for r in dg.tool_rates(prof).collect()] == [0, 0, 0, 0]
