"""Queries over attempts: folds, routing, convergence; and over failures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from evalloom import dims
from evalloom.functions import extract
from evalloom.operators import evaluate as ev
from evalloom.operators import accuracy as acc
from evalloom.operators import failures as fl
from evalloom.operators import folds
from evalloom.plans import fixtures as fx
from evalloom.plans.catalog import query
from evalloom.storage import scratch_path


def sql(strategy: str) -> str:
    return "WITH " + fx.attempts_sql(strategy)


def listed(column) -> object:
    """Array of answers as text, nulls shown."""
    return F.array_join(column, ",", "-")


_USE = ["latency_s", "input_tokens", "output_tokens"]
_SUMS = "sum(latency_s) AS latency_s, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens"


@query("fld1", sql("crop_zoom") + f" SELECT sample_id, raw_response, parsed_answer, {', '.join(_USE)}, 'baseline' AS strategy FROM attempts WHERE pass_kind = 'full' AND attempt_idx = 0")
def fld1(spark, sf_dir):
    rows = folds.baseline(fx.attempts(spark, sf_dir, "crop_zoom"))
    return rows.drop("task_name")


_VOTE = """, counted AS (SELECT sample_id, parsed_answer, count(*) AS c, min(attempt_idx) AS first FROM {src} WHERE parsed_answer IS NOT NULL GROUP BY ALL),
  winner AS (SELECT sample_id, parsed_answer AS win, c AS votes FROM counted QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY c DESC, first) = 1)"""


@query("fld2", sql("best_of_n") + _VOTE.format(src="attempts") + """ SELECT a.sample_id, max(win) AS parsed_answer, coalesce(max(votes), 0) AS votes, count(*) AS attempts
   FROM attempts a LEFT JOIN winner USING (sample_id) GROUP BY a.sample_id""")
def fld2(spark, sf_dir):
    return folds.majority_vote(fx.attempts(spark, sf_dir, "best_of_n"))


_BON = """, bon AS (SELECT a.sample_id, max(win) AS parsed_answer, arg_min(raw_response, attempt_idx) FILTER (WHERE parsed_answer IS NOT DISTINCT FROM win) AS raw_response,
   sum(latency_s) AS latency_s, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(*) AS strategy_n,
   string_agg(coalesce(parsed_answer, '-'), ',' ORDER BY attempt_idx) AS strategy_all_answers FROM (SELECT * FROM attempts WHERE pass_kind = 'sample') a LEFT JOIN winner USING (sample_id) GROUP BY a.sample_id),
  votes AS (SELECT sample_id, string_agg(parsed_answer || '=' || c::VARCHAR, ',' ORDER BY parsed_answer) AS strategy_votes FROM counted GROUP BY sample_id)"""


@query("fld3", sql("best_of_n") + _VOTE.format(src="attempts") + _BON + " SELECT b.*, coalesce(strategy_votes, '') AS strategy_votes FROM bon b LEFT JOIN votes USING (sample_id)")
def fld3(spark, sf_dir):
    rows = folds.best_of_n(fx.attempts(spark, sf_dir, "best_of_n"))
    votes = F.transform(
        F.array_sort(F.map_entries("strategy_votes")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return rows.select(
        "sample_id", "parsed_answer", "raw_response", *_USE, F.col("strategy_n").cast("bigint").alias("strategy_n"),
        listed("strategy_all_answers").alias("strategy_all_answers"),
        F.array_join(votes, ",").alias("strategy_votes"),
    )


_SEEN = """, seen AS (SELECT *, CASE WHEN pass_kind = 'full' THEN 0 ELSE attempt_idx + 1 END AS pos FROM attempts),
  counted AS (SELECT sample_id, parsed_answer, count(*) AS c, min(pos) AS first FROM seen WHERE parsed_answer IS NOT NULL GROUP BY ALL),
  winner AS (SELECT sample_id, parsed_answer AS win FROM counted QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY c DESC, first) = 1)
"""
_ALL_CROPS = _SEEN + """ SELECT s.sample_id, CASE WHEN max(task_name) = 'hierarchy_depth' THEN coalesce(max(CAST(parsed_answer AS BIGINT))::VARCHAR, max(parsed_answer) FILTER (WHERE pos = 0)) ELSE max(win) END AS parsed_answer,
   sum(latency_s) AS latency_s FROM seen s LEFT JOIN winner USING (sample_id) GROUP BY s.sample_id"""


@query("fld4", sql("crop_zoom") + _SEEN + """
  SELECT s.sample_id, CASE WHEN max(task_name) = 'hierarchy_depth' THEN coalesce(max(CAST(parsed_answer AS BIGINT))::VARCHAR, max(parsed_answer) FILTER (WHERE pos = 0)) ELSE max(win) END AS parsed_answer,
   sum(latency_s) AS latency_s, string_agg(coalesce(parsed_answer, '-'), ',' ORDER BY pos) AS strategy_all_answers,
   max(parsed_answer) FILTER (WHERE pos = 0) AS strategy_full_answer FROM seen s LEFT JOIN winner USING (sample_id) GROUP BY s.sample_id""")
def fld4(spark, sf_dir):
    return folds.crop_zoom(fx.attempts(spark, sf_dir, "crop_zoom")).select(
        "sample_id", "parsed_answer", "latency_s", listed("strategy_all_answers").alias("strategy_all_answers"),
        "strategy_full_answer",
    )


_CONFIRM = "regexp_matches(lower({0}), '" + "|".join(dims.CONFIRM_WORDS) + "')"


_VERIFIED = f"""WITH w AS (SELECT sample_id, max(parsed_answer) FILTER (WHERE pass_kind = 'full') AS p1, max(parsed_answer) FILTER (WHERE pass_kind = 'verify') AS p2,
   max(raw_response) FILTER (WHERE pass_kind = 'verify') AS r2, sum(latency_s) AS l_all, max(latency_s) FILTER (WHERE pass_kind = 'full') AS l_one FROM attempts GROUP BY sample_id),
   f AS (SELECT *, CASE WHEN p1 IS NULL THEN NULL WHEN p2 IS NOT NULL AND NOT {_CONFIRM.format('r2')} THEN p2 ELSE p1 END AS parsed_answer FROM w)
   SELECT sample_id, parsed_answer, p1 AS strategy_initial_answer, CASE WHEN p1 IS NOT NULL THEN {_CONFIRM.format('r2')} END AS strategy_verify_confirmed,
   CASE WHEN p1 IS NOT NULL THEN parsed_answer <> p1 END AS strategy_final_changed, CASE WHEN p1 IS NULL THEN l_one ELSE l_all END AS latency_s FROM f"""


@query("fld5", sql("verify") + " SELECT * FROM (" + _VERIFIED + ")")
def fld5(spark, sf_dir):
    return folds.verify(fx.attempts(spark, sf_dir, "verify")).select(
        "sample_id", "parsed_answer", "strategy_initial_answer", "strategy_verify_confirmed",
        "strategy_final_changed", "latency_s",
    )


@query("fld6", sql("best_of_n_verify") + _VOTE.format(src="(SELECT * FROM attempts WHERE pass_kind = 'sample')") + f""", v AS (SELECT sample_id, raw_response AS r2, parsed_answer AS p2, latency_s AS l2 FROM attempts WHERE pass_kind = 'verify'),
   b AS (SELECT sample_id, sum(latency_s) AS l1 FROM attempts WHERE pass_kind = 'sample' GROUP BY sample_id),
   f AS (SELECT v.*, win, l1, CASE WHEN win IS NULL THEN NULL WHEN p2 IS NOT NULL AND NOT {_CONFIRM.format('r2')} THEN p2 ELSE win END AS parsed_answer FROM v JOIN b USING (sample_id) LEFT JOIN winner USING (sample_id))
   SELECT sample_id, parsed_answer, win AS strategy_consensus, CASE WHEN win IS NOT NULL THEN parsed_answer <> win END AS strategy_final_changed,
   CASE WHEN win IS NULL THEN l1 ELSE l1 + l2 END AS latency_s FROM f""")
def fld6(spark, sf_dir):
    return folds.best_of_n_verify(fx.attempts(spark, sf_dir, "best_of_n_verify")).select(
        "sample_id", "parsed_answer", "strategy_consensus", "strategy_final_changed", "latency_s"
    )


@query("fld7", sql("decompose") + """, w AS (SELECT sample_id, max(task_name) AS task_name, max(parsed_answer) FILTER (WHERE pass_kind = 'final') AS fin,
   list(TRY_CAST(parsed_answer AS BIGINT) ORDER BY attempt_idx) FILTER (WHERE pass_kind = 'sub' AND parsed_answer IS NOT NULL) AS subs, sum(latency_s) AS latency_s,
   string_agg(substr(prompt, 1, 100) || '>' || substr(raw_response, 1, 200), ';' ORDER BY attempt_idx) FILTER (WHERE pass_kind = 'sub') AS strategy_sub_responses FROM attempts GROUP BY sample_id)
   SELECT sample_id, coalesce(fin, CASE WHEN task_name = 'counting_grid' AND subs[1] > 1 AND subs[2] > 1 THEN (subs[1] - 1)::VARCHAR || ',' || (subs[2] - 1)::VARCHAR END) AS parsed_answer,
   latency_s, strategy_sub_responses, 3 AS strategy_steps FROM w""")
def fld7(spark, sf_dir):
    shown = F.array_join(
        F.transform("strategy_sub_responses", lambda s: F.concat(s["prompt"], F.lit(">"), s["response"])), ";"
    )
    return folds.decompose(fx.attempts(spark, sf_dir, "decompose")).select(
        "sample_id", "parsed_answer", "latency_s", shown.alias("strategy_sub_responses"), "strategy_steps"
    )


@query("fld8", sql("code_vision") + """ SELECT sample_id, max(parsed_answer) FILTER (WHERE pass_kind = 'final') AS parsed_answer, sum(latency_s) FILTER (WHERE pass_kind <> 'output') AS latency_s,
   max(substr(CASE WHEN contains(raw_response, '```') THEN trim(regexp_extract(raw_response, '(?s)```(?:python)?\\s*\\n(.*?)```', 1), chr(10) || ' ') ELSE trim(raw_response) END, 1, 500)) FILTER (WHERE pass_kind = 'code') AS strategy_code,
   max(substr(raw_response, 1, 500)) FILTER (WHERE pass_kind = 'output') AS strategy_code_output, 3 AS strategy_steps FROM attempts GROUP BY sample_id""")
def fld8(spark, sf_dir):
    return folds.code_vision(fx.attempts(spark, sf_dir, "code_vision")).select(
        "sample_id", "parsed_answer", "latency_s", "strategy_code", "strategy_code_output", "strategy_steps"
    )


_KEPT_ROUNDS = """, l AS (SELECT *, lag(parsed_answer) OVER (PARTITION BY sample_id ORDER BY attempt_idx) AS before FROM attempts),
   stop AS (SELECT sample_id, min(attempt_idx) AS stop_at FROM l WHERE attempt_idx >= 1 AND parsed_answer = before GROUP BY sample_id),
   kept AS (SELECT l.*, stop_at FROM l LEFT JOIN stop USING (sample_id) WHERE attempt_idx <= coalesce(stop_at, 99))"""
_ROUNDS = sql("iterative_refine") + _KEPT_ROUNDS


@query("fld9", _ROUNDS + """ SELECT sample_id, arg_max(parsed_answer, attempt_idx) FILTER (WHERE parsed_answer IS NOT NULL) AS parsed_answer, arg_max(raw_response, attempt_idx) AS raw_response,
   count(*) AS strategy_rounds, max(stop_at) IS NOT NULL AS strategy_converged, string_agg(coalesce(parsed_answer, '-'), ',' ORDER BY attempt_idx) AS strategy_all_answers, sum(latency_s) AS latency_s FROM kept GROUP BY sample_id""")
def fld9(spark, sf_dir):
    return folds.iterative_refine(fx.attempts(spark, sf_dir, "iterative_refine")).select(
        "sample_id", "parsed_answer", "raw_response", F.col("strategy_rounds").cast("bigint").alias("strategy_rounds"),
        "strategy_converged", listed("strategy_all_answers").alias("strategy_all_answers"), "latency_s",
    )


@query("win7", _ROUNDS + " SELECT sample_id, (stop_at + 1)::BIGINT AS converged_round FROM stop")
def win7(spark, sf_dir):
    rounds = fx.attempts(spark, sf_dir, "iterative_refine")
    return folds.convergence(rounds)


_TOOLS = "(" + ", ".join(f"'{t}'" for t in dims.SKETCH_TOOLS) + ")"


@query("fld10", sql("sketchpad") + f""", d AS (SELECT *, nullif(regexp_extract(raw_response, 'TOOL\\((\\w+)(?:,\\s*(.+?))?\\)', 1), '') AS tool,
     nullif(trim(regexp_extract(raw_response, '(?s)ANSWER\\s*[:]?\\s*(.+)', 1)), '') AS ans FROM attempts),
   e AS (SELECT *, CASE WHEN tool IS NULL THEN coalesce(ans, trim(raw_response)) ELSE raw_response END AS said, tool IS NOT NULL AND tool IN {_TOOLS} AS goes_on FROM d),
   s AS (SELECT a.sample_id, CASE WHEN a.goes_on THEN b.said ELSE a.said END AS raw_response, CASE WHEN a.goes_on THEN 3 ELSE 2 END AS strategy_passes,
     CASE WHEN a.goes_on THEN a.latency_s + b.latency_s ELSE a.latency_s END AS latency_s
     FROM (SELECT * FROM e WHERE attempt_idx = 1) a JOIN (SELECT * FROM e WHERE attempt_idx = 2) b USING (sample_id))
   SELECT *, {fx.parse_integer_sql('raw_response')} AS parsed_answer FROM s""")
def fld10(spark, sf_dir):
    return folds.sketchpad(fx.attempts(spark, sf_dir, "sketchpad")).select(
        "sample_id", "raw_response", "strategy_passes", "latency_s", "parsed_answer"
    )


_BASE = "regexp_replace(task_name, '_text$', '')"
_ROUTE = f"CASE {_BASE} " + " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in dims.ROUTES.items()) + " ELSE 'verify' END"
_ADAPTIVE = f"""WITH {fx.STRATEGY_SQL} SELECT sample_id, task_name, strategy AS strategy_selected, 'adaptive' AS strategy, correct
   FROM strategy_results WHERE strategy = {_ROUTE}"""


@query("fld11", _ADAPTIVE)
def fld11(spark, sf_dir):
    return folds.adaptive(fx.strategy_results(spark, sf_dir)).select(
        "sample_id", "task_name", "strategy_selected", "strategy", "correct"
    )


@query("jn8", f"WITH {fx.STRATEGY_SQL} SELECT DISTINCT task_name, {_ROUTE} AS route FROM strategy_results")
def jn8(spark, sf_dir):
    rows = fx.strategy_results(spark, sf_dir).select("task_name").distinct()
    return rows.withColumn("route", folds.routed_strategy(F.col("task_name")))


@query("udf3", sql("best_of_n") + " SELECT sample_id, max(CAST(parsed_answer AS BIGINT))::VARCHAR AS parsed_answer FROM attempts GROUP BY sample_id")
def udf3(spark, sf_dir):
    """A strategy of the user's own, registered by name: a fold is any aggregate over attempts."""
    largest = F.max(F.col("parsed_answer").try_cast("bigint")).cast("string")
    own = {"largest": lambda df: df.groupBy("sample_id", "strategy").agg(largest.alias("parsed_answer"))}
    attempts = fx.attempts(spark, sf_dir, "best_of_n").withColumn("strategy", F.lit("largest"))
    return folds.fold_all(attempts, own).select("sample_id", "parsed_answer")


def _fld_all_sql() -> str:
    """Every strategy of one table folded apart: the rules of the queries above over more calls."""
    last = {
        "best_of_n": _VOTE.format(src="attempts") + " SELECT a.sample_id, max(win) AS parsed_answer, sum(latency_s) AS latency_s FROM attempts a LEFT JOIN winner USING (sample_id) GROUP BY a.sample_id",
        "crop_zoom": _ALL_CROPS,
        "decompose": """, w AS (SELECT sample_id, max(task_name) AS task_name, max(parsed_answer) FILTER (WHERE pass_kind = 'final') AS fin,
           list(TRY_CAST(parsed_answer AS BIGINT) ORDER BY attempt_idx) FILTER (WHERE pass_kind = 'sub' AND parsed_answer IS NOT NULL) AS subs, sum(latency_s) AS latency_s FROM attempts GROUP BY sample_id)
           SELECT sample_id, coalesce(fin, CASE WHEN task_name = 'counting_grid' AND subs[1] > 1 AND subs[2] > 1 THEN (subs[1] - 1)::VARCHAR || ',' || (subs[2] - 1)::VARCHAR END) AS parsed_answer, latency_s FROM w""",
        "iterative_refine": _KEPT_ROUNDS + " SELECT sample_id, arg_max(parsed_answer, attempt_idx) FILTER (WHERE parsed_answer IS NOT NULL) AS parsed_answer, sum(latency_s) AS latency_s FROM kept GROUP BY sample_id",
        "code_vision": " SELECT sample_id, max(parsed_answer) FILTER (WHERE pass_kind = 'final') AS parsed_answer, sum(latency_s) FILTER (WHERE pass_kind <> 'output') AS latency_s FROM attempts GROUP BY sample_id",
        "verify": " SELECT sample_id, parsed_answer, latency_s FROM (" + _VERIFIED + ")",
    }
    return " UNION ALL ".join(
        f"SELECT sample_id, '{name}' AS strategy, model, parsed_answer, latency_s FROM (WITH {fx.attempts_sql(name, fx.MANY_CALLS)}{rule}) JOIN (SELECT event_id::VARCHAR AS sample_id, 'm' || (event_id % 2)::VARCHAR AS model FROM events) USING (sample_id)"
        for name, rule in last.items()
    )


@query("fld_all", _fld_all_sql())
def fld_all(spark, sf_dir):
    names = ["best_of_n", "crop_zoom", "decompose", "iterative_refine", "code_vision", "verify"]
    attempts = fx.attempts_of(spark, sf_dir, names, fx.MANY_CALLS)
    attempts = attempts.withColumn("model", F.concat(F.lit("m"), (F.col("sample_id").cast("bigint") % 2).cast("string")))
    return folds.fold_all(attempts).select("sample_id", "strategy", "model", "parsed_answer", "latency_s")


# ---------------------------------------------------------------- model calls

def echo_model(batch):
    """Stands for a model: a user function over a pandas batch."""
    said = ["I see " + truth if isinstance(truth, str) else None for truth in batch["ground_truth"]]
    return pd.DataFrame({"sample_id": batch["sample_id"].array, "raw_response": said}, copy=False)


_CALLED = f"WITH {fx.RESPONSES_SQL} SELECT sample_id, 'I see ' || ground_truth AS raw_response FROM responses WHERE line_no % 4 <> 0"


def called(spark, sf_dir):
    rows = fx.responses(spark, sf_dir)
    done = rows.where(F.col("line_no") % 4 == 0)
    return ev.run_model(
        rows.select("sample_id", "ground_truth"), done, echo_model, "sample_id string, raw_response string"
    ).drop("error_message")


query("gen11", _CALLED)(called)


def moody_model(batch):
    """A model that fails on some questions, and with them on their whole batch."""
    if "3" in list(batch["ground_truth"]):
        raise ValueError("no three")
    return echo_model(batch)


def loud_model(batch):
    return batch.assign(raw_response="AGAIN " + batch["ground_truth"])[["sample_id", "raw_response"]]


@query("gen11_resume", f"""WITH {fx.RESPONSES_SQL} SELECT sample_id,
   CASE WHEN line_no % 4 = 0 THEN 'AGAIN ' || ground_truth WHEN ground_truth <> '3' THEN 'I see ' || ground_truth END AS raw_response,
   CASE WHEN line_no % 4 <> 0 AND ground_truth = '3' THEN 'ValueError: no three' END AS error_message FROM responses""")
def gen11_resume(spark, sf_dir):
    """Two runs into one place: failed calls are rows, and the second run leaves all finished rows alone."""
    path = scratch_path(spark, "model-run")
    rows = fx.responses(spark, sf_dir).select("sample_id", "ground_truth", "line_no")
    kind = "sample_id string, raw_response string"
    ev.run_to(rows.where("line_no % 4 <> 0"), path, moody_model, kind, rows_per_wave=3_000)
    return ev.run_to(rows, path, loud_model, kind)
query("udf5", _CALLED)(called)


# ---------------------------------------------------------------- failures

_ERR = """CASE WHEN parsed_answer IS NULL THEN 'Parse failure' WHEN error > 0 THEN 'Overcount (+' || error::VARCHAR || ')'
   WHEN error < 0 THEN 'Undercount (' || error::VARCHAR || ')' ELSE 'Unknown' END"""
_ARTIFACT = """(task_name = 'pie_chart' AND len([p for p in CAST(json_extract(params, '$.percentages') AS BIGINT[])
   if p <> CAST(json_extract_string(params, '$.target_pct') AS BIGINT) AND abs(p - CAST(json_extract_string(params, '$.target_pct') AS BIGINT)) <= 5]) > 0)"""
_R = "WITH " + fx.RESULTS_SQL
_WRONG = _R + f""", wrong AS (SELECT *, {_ERR} AS error_type FROM results WHERE NOT correct AND NOT ends_with(task_name, '_text') AND NOT {_ARTIFACT})"""


@query("prj13", _R + f" SELECT sample_id, {_ARTIFACT} AS is_artifact FROM results WHERE NOT correct")
def prj13(spark, sf_dir):
    return fl.wrong_rows(fx.results(spark, sf_dir)).select("sample_id", fl.is_artifact().alias("is_artifact"))


@query("agg29", _R + f""" SELECT task_name, count(*) AS n, count(*) FILTER (WHERE NOT correct) AS n_fail, count(*) FILTER (WHERE NOT correct AND {_ARTIFACT}) AS n_artifacts,
   (count(*) FILTER (WHERE correct))::DOUBLE / count(*) * 100 AS raw_acc, (count(*) FILTER (WHERE correct OR {_ARTIFACT}))::DOUBLE / count(*) * 100 AS adjusted_acc
   FROM results WHERE NOT ends_with(task_name, '_text') GROUP BY task_name HAVING count(*) FILTER (WHERE NOT correct) > 0 ORDER BY raw_acc, task_name LIMIT 10""")
def agg29(spark, sf_dir):
    return fl.adjusted_ranking(fx.results(spark, sf_dir))


_PICKED = """, typed AS (SELECT *, row_number() OVER (PARTITION BY task_name, error_type ORDER BY line_no) AS turn, count(*) OVER (PARTITION BY task_name, error_type) AS type_n,
     min(line_no) OVER (PARTITION BY task_name, error_type) AS first_seen FROM wrong),
   picked AS (SELECT *, row_number() OVER (PARTITION BY task_name ORDER BY turn, type_n DESC, first_seen) AS pick FROM typed)
   SELECT task_name, pick::INTEGER AS pick, error_type, type_n, sample_id, parsed_answer, ground_truth FROM picked WHERE pick <= 5"""


@query("win2", _WRONG + _PICKED)
def win2(spark, sf_dir):
    return fl.diverse_failures(fx.results(spark, sf_dir))


def _several_models(spark, sf_dir):
    """Results of two models: the second could be read on no sample of the first's."""
    rows = fx.results(spark, sf_dir)
    other = rows.withColumns({
        "line_no": F.col("line_no") + 1_000_000, "parsed_answer": F.lit(None).cast("string"), "correct": F.lit(False),
    })
    return rows.unionByName(other)


_TWO = """, both_models AS (SELECT * FROM results UNION ALL SELECT * REPLACE (line_no + 1000000 AS line_no, NULL AS parsed_answer, false AS correct) FROM results)"""


@query("win2_models", _R + _TWO + f""", wrong AS (SELECT *, {_ERR} AS error_type FROM both_models WHERE NOT correct AND NOT ends_with(task_name, '_text') AND NOT {_ARTIFACT}
     QUALIFY row_number() OVER (PARTITION BY task_name, sample_id ORDER BY line_no) = 1)""" + _PICKED)
def win2_models(spark, sf_dir):
    return fl.diverse_failures(_several_models(spark, sf_dir))


@query("win8", _R + " SELECT task_name, arg_min(sample_id, line_no) AS sample_id, arg_min(ground_truth, line_no) AS ground_truth, arg_min(coalesce(parsed_answer, '~'), line_no) AS parsed_answer FROM results WHERE NOT correct GROUP BY task_name")
def win8(spark, sf_dir):
    return fl.first_failures(fx.results(spark, sf_dir)).withColumn(
        "parsed_answer", F.coalesce("parsed_answer", F.lit("~"))
    )


@query("win9", _R + """, w AS (SELECT task_name, sample_id, row_number() OVER (PARTITION BY task_name ORDER BY line_no) AS rank FROM results WHERE NOT correct),
   r AS (SELECT task_name, (count(*) FILTER (WHERE NOT correct))::DOUBLE / count(*) AS fail_rate FROM results GROUP BY task_name)
   SELECT task_name, fail_rate, rank::INTEGER AS rank, sample_id FROM w JOIN r USING (task_name) WHERE rank <= 4""")
def win9(spark, sf_dir):
    rows = fx.results(spark, sf_dir)
    return fl.leading_failures(rows, acc.failure_rates(rows))
