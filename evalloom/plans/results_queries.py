"""Queries over results: sources, sinks, projections, joins and accuracy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom import dims
from evalloom.functions import scoring
from evalloom.operators import accuracy as acc
from evalloom.operators import evaluate as ev
from evalloom.operators import gaps, params as pm, sets, strategies as st
from evalloom.plans import fixtures as fx
from evalloom.plans.catalog import query
from evalloom.sources import readers, writers
from evalloom.storage import scratch_path, stored


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round the named doubles so that two engines' last bits do not matter."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def cols(*names: str) -> str:
    return ", ".join(names)


R, T = "WITH " + fx.RESULTS_SQL, "WITH " + fx.TALLY_SQL
RESPONSES = "WITH " + fx.RESPONSES_SQL

# ---------------------------------------------------------------- sources and sinks

_KEPT = ["sample_id", "task_name", "parsed_answer", "ground_truth", "correct", "score", "error"]


def written_results(spark, sf_dir):
    """Results written as JSON lines to the shared folder; returns the path."""
    path = scratch_path(spark, "results")
    writers.append_results(fx.results(spark, sf_dir).drop("line_no"), path)
    return path


@query("src1", f"{R} SELECT {cols(*_KEPT)} FROM results")
def src1(spark, sf_dir):
    return readers.read_results(spark, written_results(spark, sf_dir)).select(*_KEPT)


_FIELDS = ["level", "width", "name", "size", "path", "percentages", "target_pct"]


@query("src2", f"{RESPONSES} SELECT sample_id, task_name, prompt, ground_truth, parser, scorer, "
       + ", ".join(f"replace(json_extract_string(params, '$.{f}'), ' ', '') AS {f}" for f in _FIELDS) + " FROM responses")
def src2(spark, sf_dir):
    """A manifest whose lines hold ``params`` as an object; all its fields are read back."""
    path = scratch_path(spark, "manifest")
    plain = ["sample_id", "task_name", "prompt", "ground_truth", "parser", "scorer"]
    line = F.to_json(F.struct(*plain, F.parse_json("params").alias("params")))
    fx.responses(spark, sf_dir).select(line.alias("value")).write.text(path)
    return readers.read_manifest(spark, path).select(*plain, *[F.get_json_object("params", f"$.{f}").alias(f) for f in _FIELDS])


@query("src3", f"{RESPONSES} SELECT DISTINCT sample_id FROM responses WHERE line_no % 3 <> 0")
def src3(spark, sf_dir):
    """Every third line is cut short, so it cannot be read."""
    path = scratch_path(spark, "completed")
    line = F.to_json(F.struct("sample_id", "task_name"))
    torn = F.when(F.col("line_no") % 3 == 0, F.substring(line, 1, 9)).otherwise(line)
    fx.responses(spark, sf_dir).select(torn.alias("value")).write.text(path)
    return readers.read_completed(spark, path)


@query("src4", f"WITH {fx.EPISODES_SQL} SELECT ground_truth, CASE WHEN form = 6 THEN 'I cannot tell.' || chr(10) || chr(10)"
       " ELSE response END AS response FROM episodes")
def src4(spark, sf_dir):
    """Episodes without a response have worked steps only."""
    path = scratch_path(spark, "episodes")
    fx.episodes(spark, sf_dir).select(
        "ground_truth",
        F.when(F.col("response") != "I cannot tell.", F.col("response")).alias("response"),
        F.when(F.col("response") == "I cannot tell.", F.col("response")).alias("chain_of_thought"),
    ).write.json(path)
    return readers.read_episodes(spark, path).select("ground_truth", "response")


@query("src6", f"""WITH {fx.STRATEGY_SQL} SELECT 'big_v_1' AS run_model, strategy AS run_strategy, task_name,
       count(*) AS n, count(*) FILTER (WHERE correct) AS n_correct FROM strategy_results GROUP BY ALL""")
def src6(spark, sf_dir):
    """A run of every strategy, each a directory of its own."""
    root = scratch_path(spark, "runs")
    events = stored(fx.judged_events(spark, sf_dir), "judged")
    for strategy in dims.STRATEGIES:
        rows = fx.results_of(events, strategy).drop("rank", "strategy")
        rows.write.json(f"{root}/big_v_1/{strategy}/results.jsonl")
    return acc.tally(readers.read_runs(spark, root), "run_model", "run_strategy", "task_name").select(
        "run_model", "run_strategy", "task_name", "n", "n_correct"
    )


@query("snk1", f"{R} SELECT task_name, count(*) * 2 AS n FROM results GROUP BY task_name")
def snk1(spark, sf_dir):
    """Two batches of the same results, each appended twice: rows are doubled by the ids, not by the repeats."""
    path = scratch_path(spark, "append")
    rows = fx.results(spark, sf_dir).drop("line_no")
    for batch in ("first", "second", "second", "first"):
        writers.append_results(rows, path, "json", batch)
    return readers.read_batches(spark, path).groupBy("task_name").agg(F.count("*").alias("n"))


@query("snk2", f"""{R} SELECT sample_id, parsed_answer, correct, reasoning_mode,
       substr(thinking_text, 1, 500) AS thinking_text FROM results""")
def snk2(spark, sf_dir):
    path = scratch_path(spark, "trace")
    writers.write_trace(fx.results(spark, sf_dir), path)
    return readers.read_results(spark, path).select(
        "sample_id", "parsed_answer", "correct", "reasoning_mode", "thinking_text"
    )


_COMBINED = f"""{RESPONSES}, both_parts AS (SELECT sample_id, task_name, ground_truth, CAST(NULL AS BIGINT) AS prompt_variant
       FROM responses WHERE task_name LIKE '%\\_text' ESCAPE '\\' UNION ALL SELECT sample_id, task_name, ground_truth, 2
       FROM responses WHERE task_name NOT LIKE '%\\_text' ESCAPE '\\') SELECT * FROM both_parts"""


def combined(spark, sf_dir):
    rows = fx.responses(spark, sf_dir).select("sample_id", "task_name", "ground_truth")
    text = rows.where(F.endswith("task_name", F.lit("_text")))
    image = acc.image_tasks_only(rows).withColumn("prompt_variant", F.lit(2).cast("bigint"))
    return writers.combine_manifests([text, image])


query("snk3", _COMBINED)(combined)
query("set6", _COMBINED)(combined)

_WORST = f"{R} SELECT sample_id, task_name, score FROM results WHERE NOT correct ORDER BY score, sample_id LIMIT 20"


@query("snk4", _WORST)
def snk4(spark, sf_dir):
    path = scratch_path(spark, "failures")
    writers.write_failures(fx.results(spark, sf_dir), path)
    return readers.read_results(spark, path).select("sample_id", "task_name", "score")


@query("top1", _WORST)
def top1(spark, sf_dir):
    from evalloom.operators.failures import worst_rows

    return worst_rows(fx.results(spark, sf_dir)).select("sample_id", "task_name", "score")


@query("snk5", f"{RESPONSES} SELECT task_name, count(*) AS n, count(DISTINCT ground_truth) AS truths FROM responses GROUP BY task_name")
def snk5(spark, sf_dir):
    path = scratch_path(spark, "by_task")
    rows = fx.responses(spark, sf_dir)
    half = F.col("line_no") % 2
    for batch in (0, 1, 1):
        writers.write_by_task(rows.where(half == batch), path, batch_id=f"half-{batch}")
    kind = "ground_truth string, task_name string"
    return readers.read_batches(spark, path, kind).groupBy("task_name").agg(
        F.count("*").alias("n"), F.count_distinct("ground_truth").alias("truths")
    )


# ---------------------------------------------------------------- projections

@query("prj1", f"{RESPONSES} SELECT sample_id, coalesce(reasoning_mode, false) AS reasoning_mode FROM responses")
def prj1(spark, sf_dir):
    return ev.normalise_reasoning(fx.responses(spark, sf_dir)).select("sample_id", "reasoning_mode")


_FLAT_SQL = RESPONSES + """, flat AS (
  SELECT sample_id, task_name, correct_, param, value, value_type FROM (SELECT *, true AS correct_ FROM responses), LATERAL (
    SELECT unnest(['level', 'width', 'name', 'size.w', 'path', 'percentages', 'target_pct']) AS param,
           unnest([json_extract_string(params, '$.level'), json_extract_string(params, '$.width'),
             json_extract_string(params, '$.name'), json_extract_string(params, '$.size.w'),
             replace(json_extract(params, '$.path')::VARCHAR, ' ', ''), replace(json_extract(params, '$.percentages')::VARCHAR, ' ', ''),
             json_extract_string(params, '$.target_pct')]) AS value,
           unnest(['BIGINT', 'BIGINT', 'STRING', 'BIGINT', 'ARRAY', 'ARRAY', 'BIGINT']) AS value_type))"""


@query("prj2", _FLAT_SQL + " SELECT sample_id, 'p_' || param AS param, value, value_type FROM flat")
def prj2(spark, sf_dir):
    flat = pm.param_strings(fx.responses(spark, sf_dir))
    return flat.select(
        "sample_id", F.concat(F.lit("p_"), "param").alias("param"), "value", "value_type"
    )


@query("prj3", f"{RESPONSES} SELECT sample_id, json_array_length(params, '$.path')::BIGINT AS path_length, CAST(NULL AS BIGINT) AS name_length FROM responses")
def prj3(spark, sf_dir):
    rows = pm.list_length(pm.list_length(fx.responses(spark, sf_dir), "path"), "name")
    return rows.select(
        "sample_id", F.col("path_length").cast("bigint").alias("path_length"),
        F.col("name_length").cast("bigint").alias("name_length"),
    )


_BY_PARAM = R + """, cells AS (SELECT task_name, unnest(['level', 'width', 'size.w', 'target_pct']) AS param,
   unnest([json_extract_string(params, '$.level'), json_extract_string(params, '$.width'),
     json_extract_string(params, '$.size.w'), json_extract_string(params, '$.target_pct')]) AS value, correct FROM results),
  counted AS (SELECT task_name, param, value, count(*) AS n, (count(*) FILTER (WHERE correct))::DOUBLE / count(*) AS accuracy
   FROM cells GROUP BY ALL),
  shown AS (SELECT *, count(*) OVER (PARTITION BY task_name, param) AS n_values FROM counted)"""


@query("prj4", _BY_PARAM + " SELECT DISTINCT task_name, param FROM shown WHERE n_values > 1")
def prj4(spark, sf_dir):
    return pm.accuracy_by_param(fx.results(spark, sf_dir)).select("task_name", "param").distinct()


@query("agg6", _BY_PARAM + """ SELECT task_name, param, value, n, accuracy, (SELECT count(*) FROM results r WHERE r.task_name = s.task_name) AS param_n,
   (SELECT (count(*) FILTER (WHERE correct))::DOUBLE / count(*) FROM results r WHERE r.task_name = s.task_name) AS param_accuracy FROM shown s WHERE n_values > 1""")
def agg6(spark, sf_dir):
    return pm.accuracy_by_param(fx.results(spark, sf_dir))


@query("agg6b", R + """ SELECT task_name, json_extract_string(params, '$.level') AS x_value,
   json_extract_string(params, '$.size.w') AS y_value, count(*) AS n,
   (count(*) FILTER (WHERE correct))::DOUBLE / count(*) AS accuracy FROM results GROUP BY ALL""")
def agg6b(spark, sf_dir):
    return pm.accuracy_by_two(fx.results(spark, sf_dir), "level", "size.w")


_SPLIT = T + """, names AS (SELECT task_name FROM tally) SELECT a.task_name,
   b.task_name IS NOT NULL AS is_control FROM names a LEFT JOIN names b ON a.task_name = b.task_name || '_text'"""


@query("prj5", _SPLIT)
def prj5(spark, sf_dir):
    return gaps.split_tasks(acc.tally(fx.results(spark, sf_dir), "task_name"))


@query("prj5_suffix", T + " SELECT task_name, n FROM tally WHERE NOT ends_with(task_name, '_text')")
def prj5_suffix(spark, sf_dir):
    return acc.tally(acc.image_tasks_only(fx.results(spark, sf_dir)), "task_name").select("task_name", "n")


@query("prj5_registry", "WITH " + fx.TALLY_SQL + ", " + fx.TAXONOMY_SQL + """ SELECT t.task_name,
   x.task_name IS NOT NULL AS is_control FROM tally t LEFT JOIN taxonomy x ON t.task_name = x.task_name || '_text'""")
def prj5_registry(spark, sf_dir):
    names = fx.results(spark, sf_dir).select("task_name").distinct()
    return gaps.split_by_registry(names, F.broadcast(dims.taxonomy(spark)))


@query("prj6", f"{RESPONSES} SELECT sample_id FROM responses WHERE NOT coalesce(reasoning_mode, false)")
def prj6(spark, sf_dir):
    return ev.without_reasoning(fx.responses(spark, sf_dir)).select("sample_id")


@query("prj7", f"""WITH {fx.STRATEGY_SQL} SELECT CASE WHEN count(DISTINCT strategy) = 1 THEN max(strategy) ELSE 'strategy' END AS label,
   'verify_only' AS run FROM strategy_results WHERE strategy = 'verify'
   UNION ALL SELECT CASE WHEN count(DISTINCT strategy) = 1 THEN max(strategy) ELSE 'strategy' END, 'all' FROM strategy_results""")
def prj7(spark, sf_dir):
    rows = fx.strategy_results(spark, sf_dir)
    one = acc.strategy_label(rows.where(F.col("strategy") == "verify")).withColumn("run", F.lit("verify_only"))
    return one.unionByName(acc.strategy_label(rows).withColumn("run", F.lit("all")))


@query("prj8", T + """ SELECT task_name, CASE WHEN acc >= 0.95 THEN 'strong' WHEN acc >= 0.80 THEN 'good'
   WHEN acc >= 0.60 THEN 'weak' ELSE 'poor' END AS tier FROM tally""")
def prj8(spark, sf_dir):
    return acc.task_stats(fx.results(spark, sf_dir)).select("task_name", "tier")


@query("prj10", f"""{R}, cut AS (SELECT *, trim(regexp_replace(prompt, '\\s+', ' ', 'g')) AS p,
    trim(regexp_replace(thinking_text, '\\s+', ' ', 'g')) AS th FROM results)
    SELECT sample_id, sample_id || ' | ' || task_name || ' | ' || CASE WHEN correct THEN 'CORRECT' ELSE 'WRONG' END || chr(10)
     || '   Prompt:    ' || CASE WHEN length(p) > 120 THEN substr(p, 1, 117) || '...' ELSE p END || chr(10)
     || CASE WHEN length(thinking_text) > 0 THEN '   Thinking:  ' || CASE WHEN length(th) > 150 THEN substr(th, 1, 147) || '...' ELSE th END || chr(10) ELSE '' END
     || '   Response:  ' || raw_response || chr(10) || '   Parsed: ' || coalesce(parsed_answer, 'None') || '  |  GT: ' || ground_truth
     || '  |  ' || input_tokens::VARCHAR || '→' || output_tokens::VARCHAR || ' tok  |  ' || latency_s::VARCHAR || 's' AS trace FROM cut""")
def prj10(spark, sf_dir):
    return ev.trace_line(fx.results(spark, sf_dir))


@query("prj12", f"""{RESPONSES} SELECT DISTINCT replace(replace(list_last(string_split(name, '/')), ' ', '_'), ':', '_') AS slug
   FROM (SELECT 'vendor/' || task_name || ' v:' || model AS name FROM responses)""")
def prj12(spark, sf_dir):
    name = F.concat(F.lit("vendor/"), "task_name", F.lit(" v:"), "model")
    return fx.responses(spark, sf_dir).select(readers.model_slug(name).alias("slug")).distinct()


# ---------------------------------------------------------------- joins

@query("jn1", f"{RESPONSES} SELECT sample_id, task_name FROM responses WHERE line_no % 7 > 2")
def jn1(spark, sf_dir):
    rows = fx.responses(spark, sf_dir)
    done = rows.where(F.col("line_no") % 7 <= 2)
    return ev.pending(rows, done).select("sample_id", "task_name")


_PAIRS = T + """, pairs AS (SELECT a.task_name, a.acc AS image_acc, b.acc AS text_acc, b.acc - a.acc AS gap, a.n AS image_n, b.n AS text_n
  FROM tally a JOIN tally b ON b.task_name = a.task_name || '_text')"""


@query("jn2", _PAIRS + " SELECT task_name, task_name || '_text' AS text_task FROM pairs")
def jn2(spark, sf_dir):
    return gaps.control_pairs(acc.tally(fx.results(spark, sf_dir), "task_name"))


_DIAG = _PAIRS + ", " + fx.TAXONOMY_SQL + """, diag AS (SELECT i.task_name, i.acc AS image_acc, p.text_acc, p.gap,
   CASE WHEN p.text_acc IS NULL THEN 'insufficient_data' WHEN i.acc > 0.80::DOUBLE THEN 'not_a_failure'
     WHEN p.text_acc > 0.80::DOUBLE AND p.gap > 0.15::DOUBLE THEN 'perceptual'
     WHEN p.gap < 0.10::DOUBLE AND p.text_acc < 0.80::DOUBLE THEN 'reasoning' WHEN p.gap >= 0.10::DOUBLE THEN 'mixed' ELSE 'reasoning' END AS failure_class,
   coalesce(x.perception, '—') AS perception, coalesce(x.reasoning, '—') AS reasoning, coalesce(x.category, '—') AS category
   FROM tally i LEFT JOIN pairs p USING (task_name) LEFT JOIN taxonomy x USING (task_name)
   WHERE NOT EXISTS (SELECT 1 FROM tally b WHERE i.task_name = b.task_name || '_text'))"""


@query("agg10", _DIAG + " SELECT * FROM diag")
def agg10(spark, sf_dir):
    return gaps.full_diagnostic(fx.results(spark, sf_dir))


@query("sco7", _DIAG + " SELECT task_name, failure_class FROM diag")
def sco7(spark, sf_dir):
    return gaps.full_diagnostic(fx.results(spark, sf_dir)).select("task_name", "failure_class")


@query("jn6", _DIAG + " SELECT task_name, perception, reasoning, category FROM diag")
def jn6(spark, sf_dir):
    return gaps.full_diagnostic(fx.results(spark, sf_dir)).select(
        "task_name", "perception", "reasoning", "category"
    )


@query("agg11", _DIAG + """ SELECT failure_class, rank::INTEGER AS rank, task_name, image_acc, text_acc, gap FROM (SELECT *, row_number() OVER (PARTITION BY failure_class
   ORDER BY CASE failure_class WHEN 'perceptual' THEN -gap WHEN 'reasoning' THEN text_acc ELSE image_acc END, task_name) AS rank
   FROM diag WHERE failure_class IN ('perceptual', 'reasoning', 'mixed')) WHERE rank <= 10""")
def agg11(spark, sf_dir):
    return gaps.worst_by_class(gaps.full_diagnostic(fx.results(spark, sf_dir)))


_CATEGORY = """ SELECT category, count(*) AS n_tasks, round(avg(image_acc), 6) AS mean_image, round(avg(text_acc), 6) AS mean_text,
   round(avg(text_acc) - avg(image_acc), 6) AS mean_gap FROM {} GROUP BY category"""


@query("agg12", _DIAG + _CATEGORY.format("diag"))
def agg12(spark, sf_dir):
    summary = gaps.category_summary(gaps.full_diagnostic(fx.results(spark, sf_dir)))
    return rounded(summary, "mean_image", "mean_text", "mean_gap")


_PERCENT = T + ", " + fx.TAXONOMY_SQL + """, pp AS (SELECT a.task_name, a.acc * 100 AS image_acc, b.acc * 100 AS text_acc,
   b.acc * 100 - a.acc * 100 AS gap, a.n AS image_n, b.n AS text_n, coalesce(perception, '?') AS perception,
   coalesce(reasoning, '?') AS reasoning, coalesce(category, '?') AS category
  FROM tally a JOIN tally b ON b.task_name = a.task_name || '_text' LEFT JOIN taxonomy x ON x.task_name = a.task_name)"""


@query("agg13", _PERCENT + " SELECT * FROM pp")
def agg13(spark, sf_dir):
    return gaps.paired_percent(fx.results(spark, sf_dir))


_GAPCLASS = "CASE WHEN gap > 15 THEN 'perceptual' WHEN gap < -15 THEN 'reasoning' ELSE 'mixed' END AS gap_class"


@query("agg14", _PERCENT + f" SELECT task_name, gap, {_GAPCLASS} FROM pp")
def agg14(spark, sf_dir):
    return gaps.gap_ranking(gaps.paired_percent(fx.results(spark, sf_dir)))


@query("prj9", _PERCENT + f" SELECT task_name, {_GAPCLASS} FROM pp")
def prj9(spark, sf_dir):
    pairs = gaps.paired_percent(fx.results(spark, sf_dir))
    return pairs.select("task_name", scoring.gap_class(F.col("gap")).alias("gap_class"))


@query("top2", _PERCENT + " SELECT task_name, gap FROM pp ORDER BY gap DESC, task_name LIMIT 10")
def top2(spark, sf_dir):
    return gaps.largest_gaps(gaps.paired_percent(fx.results(spark, sf_dir))).select("task_name", "gap")


@query("agg15", _PERCENT + """ SELECT perception, list_position(['none', 'low', 'medium', 'high'], perception)::BIGINT AS level, count(*) AS n,
   round(min(gap), 6) AS min, round(quantile_cont(gap, 0.25), 6) AS q1, round(quantile_cont(gap, 0.5), 6) AS median,
   round(quantile_cont(gap, 0.75), 6) AS q3, round(max(gap), 6) AS max FROM pp WHERE perception <> '?' GROUP BY perception""")
def agg15(spark, sf_dir):
    box = gaps.demand_box(gaps.paired_percent(fx.results(spark, sf_dir)))
    return rounded(box, "min", "q1", "median", "q3", "max")


@query("agg16", _PERCENT.replace("WITH ", "WITH RECURSIVE ", 1) + """, ordered AS (SELECT *, row_number() OVER (PARTITION BY perception, reasoning ORDER BY task_name) AS i
     FROM pp WHERE perception <> '?'),
   running AS (SELECT perception, reasoning, i, image_acc AS run FROM ordered WHERE i = 1
     UNION ALL SELECT o.perception, o.reasoning, o.i, (r.run + o.image_acc) / 2 FROM running r JOIN ordered o
       ON o.perception = r.perception AND o.reasoning = r.reasoning AND o.i = r.i + 1)
   SELECT perception, reasoning, round(avg(image_acc), 6) AS mean_acc, round(max(final_run), 6) AS running_acc, string_agg(task_name, ',' ORDER BY task_name) AS tasks
   FROM (SELECT o.*, (SELECT arg_max(run, r.i) FROM running r WHERE r.perception = o.perception AND r.reasoning = o.reasoning) AS final_run FROM ordered o)
   GROUP BY perception, reasoning""")
def agg16(spark, sf_dir):
    return rounded(gaps.demand_grid(gaps.paired_percent(fx.results(spark, sf_dir))), "mean_acc", "running_acc")


@query("agg17", _PERCENT + """ SELECT count(*) FILTER (WHERE gap > 15) AS perceptual,
   count(*) FILTER (WHERE text_acc < 50 AND image_acc < 50) AS reasoning,
   count(*) - count(*) FILTER (WHERE gap > 15) - count(*) FILTER (WHERE text_acc < 50 AND image_acc < 50) AS mixed FROM pp""")
def agg17(spark, sf_dir):
    return gaps.error_type_split(gaps.paired_percent(fx.results(spark, sf_dir)))


@query("agg18", _PERCENT + " SELECT task_name, image_acc, text_acc FROM pp WHERE text_acc < 50")
def agg18(spark, sf_dir):
    return gaps.reasoning_failures(gaps.paired_percent(fx.results(spark, sf_dir)))


@query("agg19", _PERCENT + _CATEGORY.format("pp"))
def agg19(spark, sf_dir):
    summary = gaps.category_summary(gaps.paired_percent(fx.results(spark, sf_dir))).orderBy("mean_image")
    return rounded(summary, "mean_image", "mean_text", "mean_gap")


# ---------------------------------------------------------------- aggregations

def wilson_sql(k: str, n: str, digits: int = 6) -> str:
    z = "1.96::DOUBLE"
    p, spread = f"({k}::DOUBLE / {n})", f"({z} * {z})"
    scale = f"(1.0::DOUBLE + {spread} / {n})"
    centre = f"(({p} + {spread} / (2.0::DOUBLE * {n})) / {scale})"
    half = (f"({z} / {scale} * sqrt({p} * (1.0::DOUBLE - {p}) / {n} + {spread} / (4.0::DOUBLE * {n} * {n})))")
    return (f"round(greatest(0.0::DOUBLE, {centre} - {half}), {digits}) AS ci_lo, "
            f"round(least(1.0::DOUBLE, {centre} + {half}), {digits}) AS ci_hi")


@query("agg1", T + f""" SELECT coalesce(task_name, 'TOTAL') AS task_name, sum(n)::BIGINT AS n, sum(n_correct)::BIGINT AS correct,
   sum(n_correct)::DOUBLE / sum(n) AS accuracy, {wilson_sql('sum(n_correct)', 'sum(n)')},
   sum(n_unparsed)::DOUBLE / sum(n) AS parse_fail_rate, sum(error_sum)::DOUBLE / nullif(sum(error_n), 0) AS mean_error
   FROM tally GROUP BY ROLLUP (task_name)""")
def agg1(spark, sf_dir):
    return rounded(acc.accuracy_summary(fx.results(spark, sf_dir)), "ci_lo", "ci_hi")


@query("agg2", f"{T} SELECT task_name, {wilson_sql('n_correct', 'n')} FROM tally")
def agg2(spark, sf_dir):
    low, high = scoring.wilson_interval(F.col("n_correct"), F.col("n"))
    counts = acc.tally(fx.results(spark, sf_dir), "task_name")
    return rounded(counts.select("task_name", low.alias("ci_lo"), high.alias("ci_hi")), "ci_lo", "ci_hi")


_MODES = R + """, m AS (SELECT task_name, count(*) FILTER (WHERE NOT coalesce(reasoning_mode, false)) AS n_plain,
   count(*) FILTER (WHERE coalesce(reasoning_mode, false)) AS n_reasoning,
   count(*) FILTER (WHERE NOT coalesce(reasoning_mode, false) AND correct) AS c_plain,
   count(*) FILTER (WHERE coalesce(reasoning_mode, false) AND correct) AS c_reasoning FROM results GROUP BY ROLLUP (task_name))
   SELECT coalesce(task_name, 'TOTAL') AS task_name, n_plain, c_plain::DOUBLE / n_plain AS acc_plain, n_reasoning,
   c_reasoning::DOUBLE / n_reasoning AS acc_reasoning, c_reasoning::DOUBLE / n_reasoning - c_plain::DOUBLE / n_plain AS delta FROM m"""


def modes(spark, sf_dir):
    return acc.reasoning_comparison(fx.results(spark, sf_dir))


query("agg3", _MODES)(modes)
query("jn4", _MODES)(modes)

_COMPARE = f"""WITH {fx.STRATEGY_SQL}, c AS (SELECT task_name, count(*) FILTER (WHERE strategy = 'baseline') AS n_base,
   count(*) FILTER (WHERE strategy = 'verify') AS n_strategy,
   count(*) FILTER (WHERE strategy = 'baseline' AND correct) AS c_base, count(*) FILTER (WHERE strategy = 'verify' AND correct) AS c_strategy
   FROM strategy_results WHERE NOT ends_with(task_name, '_text') AND strategy IN ('baseline', 'verify') GROUP BY ROLLUP (task_name)),
   d AS (SELECT task_name AS t, coalesce(task_name, 'TOTAL') AS task_name, n_base, c_base::DOUBLE / n_base AS acc_base, n_strategy,
   c_strategy::DOUBLE / n_strategy AS acc_strategy, c_strategy::DOUBLE / n_strategy - c_base::DOUBLE / n_base AS delta FROM c),
   e AS (SELECT * EXCLUDE (t), CASE WHEN t IS NULL THEN NULL WHEN delta > 0.005::DOUBLE THEN 'improved' WHEN delta < -0.005::DOUBLE THEN 'regressed' ELSE 'same' END AS status FROM d)"""


def comparison(spark, sf_dir):
    rows = fx.strategy_results(spark, sf_dir)
    return acc.strategy_comparison(
        rows.where(F.col("strategy") == "baseline"), rows.where(F.col("strategy") == "verify")
    )


query("agg4", _COMPARE + " SELECT * FROM e")(comparison)


@query("agg4_counts", _COMPARE + """ SELECT count(*) FILTER (WHERE status = 'improved') AS improved,
   count(*) FILTER (WHERE status = 'regressed') AS regressed, count(*) FILTER (WHERE status = 'same') AS unchanged FROM e""")
def agg4_counts(spark, sf_dir):
    return acc.status_counts(comparison(spark, sf_dir))


@query("jn3", _COMPARE + " SELECT task_name, acc_base, acc_strategy FROM e WHERE task_name <> 'TOTAL'")
def jn3(spark, sf_dir):
    return comparison(spark, sf_dir).where(F.col("task_name") != "TOTAL").select(
        "task_name", "acc_base", "acc_strategy"
    )


_COMMON = f"""WITH {fx.STRATEGY_SQL} SELECT task_name FROM strategy_results WHERE strategy = 'baseline' AND CAST(sample_id AS BIGINT) % 2 = 0
   INTERSECT SELECT task_name FROM strategy_results WHERE strategy = 'verify' AND NOT ends_with(task_name, '_text')"""


@query("set4", _COMMON)
def set4(spark, sf_dir):
    rows = fx.strategy_results(spark, sf_dir)
    even = F.col("sample_id").cast("bigint") % 2 == 0
    first = rows.where((F.col("strategy") == "baseline") & even)
    second = acc.image_tasks_only(rows.where(F.col("strategy") == "verify"))
    return sets.common_tasks(first, second)


@query("agg5", T + f""" , s AS (SELECT task_name, n, n_correct, acc AS accuracy, {wilson_sql('n_correct', 'n', 15)} FROM tally)
   SELECT task_name, n, n_correct, accuracy, round(ci_lo, 6) AS ci_lo, round(ci_hi, 6) AS ci_hi,
   round(greatest(accuracy - ci_lo, 0.0::DOUBLE), 6) AS err_lo, round(greatest(ci_hi - accuracy, 0.0::DOUBLE), 6) AS err_hi,
   CASE WHEN accuracy >= 0.95 THEN 'strong' WHEN accuracy >= 0.80 THEN 'good' WHEN accuracy >= 0.60 THEN 'weak' ELSE 'poor' END AS tier FROM s""")
def agg5(spark, sf_dir):
    return rounded(acc.task_stats(fx.results(spark, sf_dir)), "ci_lo", "ci_hi", "err_lo", "err_hi")


_CELLS = R + """, cells AS (SELECT task_name, CAST(parsed_answer AS BIGINT) AS predicted, CAST(ground_truth AS BIGINT) AS truth, count(*) AS n
   FROM results WHERE parsed_answer IS NOT NULL GROUP BY ALL)"""


@query("agg7", _CELLS + " SELECT * FROM cells WHERE task_name IN (SELECT task_name FROM cells GROUP BY task_name HAVING sum(n) >= 5)")
def agg7(spark, sf_dir):
    return acc.confusion(fx.results(spark, sf_dir))


@query("agg7_table", _CELLS + """, fit AS (SELECT * FROM cells WHERE task_name IN (SELECT task_name FROM cells GROUP BY task_name HAVING sum(n) >= 5)),
   labels AS (SELECT task_name, predicted AS label FROM fit UNION SELECT task_name, truth FROM fit)
   SELECT a.task_name, a.label AS predicted, b.label AS truth, coalesce(n, 0)::BIGINT AS n FROM labels a JOIN labels b USING (task_name)
   LEFT JOIN fit f ON f.task_name = a.task_name AND f.predicted = a.label AND f.truth = b.label""")
def agg7_table(spark, sf_dir):
    return acc.confusion_table(fx.results(spark, sf_dir))


_TEXTS = """texts AS (SELECT doc_id::VARCHAR AS sample_id, lang AS task_name, quality::VARCHAR AS ground_truth,
     text || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'So {' || toxic::VARCHAR || '}' WHEN 1 THEN 'I count ' || toxic::VARCHAR ELSE '' END AS raw_response
     FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL)"""


def labelled_texts(spark, sf_dir):
    """Whole documents as responses that end in an answer or in none; one label is the truth, another the answer."""
    docs = fx.table(spark, sf_dir, "documents").join(fx.table(spark, sf_dir, "labels"), "doc_id")
    toxic = F.col("toxic").cast("string")
    tail = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("So {"), toxic, F.lit("}"))).when(
        F.col("doc_id") % 3 == 1, F.concat(F.lit("I count "), toxic)
    ).otherwise(F.lit(""))
    rows = docs.where("text IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").select(
        F.col("doc_id").cast("string").alias("sample_id"), F.col("lang").alias("task_name"),
        F.col("quality").cast("string").alias("ground_truth"), F.concat("text", F.lit("\n"), tail).alias("raw_response"),
        F.lit("integer").alias("parser"), F.lit("integer_distance").alias("scorer"),
    )
    return ev.evaluate(rows)


@query("par1_documents", f"WITH {_TEXTS} SELECT sample_id, {fx.parse_integer_sql('raw_response')} AS parsed_answer FROM texts")
def par1_documents(spark, sf_dir):
    return labelled_texts(spark, sf_dir).select("sample_id", "parsed_answer")


@query("agg3_documents", f"""WITH {_TEXTS}, read AS (SELECT *, {fx.parse_integer_sql('raw_response')} AS a FROM texts)
   SELECT task_name, count(*) AS n, count(*) FILTER (WHERE TRY_CAST(a AS HUGEINT) = TRY_CAST(ground_truth AS HUGEINT)) AS n_correct FROM read GROUP BY task_name""")
def agg3_documents(spark, sf_dir):
    return acc.tally(labelled_texts(spark, sf_dir), "task_name").select("task_name", "n", "n_correct")


_SAID = """said AS (SELECT conv_id || '-' || turn::VARCHAR AS sample_id, role AS task_name, coalesce(text, '') || ' = ' || (turn % 7)::VARCHAR AS raw_response FROM conversations)"""


@query("par1_conversations", f"WITH {_SAID} SELECT sample_id, {fx.parse_integer_sql('raw_response')} AS parsed_answer FROM said")
def par1_conversations(spark, sf_dir):
    turns = fx.table(spark, sf_dir, "conversations").select(
        F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("sample_id"),
        F.concat(F.coalesce("text", F.lit("")), F.lit(" = "), (F.col("turn") % 7).cast("string")).alias("raw_response"),
        F.lit("integer").alias("parser"),
    )
    return ev.extract_answers(turns).select("sample_id", "parsed_answer")


@query("agg8", R + """ SELECT task_name, sum(error)::DOUBLE / count(error) AS mean_error, (count(*) FILTER (WHERE error > 0))::DOUBLE / count(error) AS overcount_rate,
   (count(*) FILTER (WHERE error < 0))::DOUBLE / count(error) AS undercount_rate, (count(*) FILTER (WHERE error = 0))::DOUBLE / count(error) AS exact_rate
   FROM results WHERE error IS NOT NULL GROUP BY task_name""")
def agg8(spark, sf_dir):
    return acc.count_bias(fx.results(spark, sf_dir))


_CLUTTER = R + """, a AS (SELECT task_name, (count(*) FILTER (WHERE correct))::DOUBLE / count(*) AS acc FROM results {where} GROUP BY task_name)
   SELECT clean_task, business_task, primitive, c.acc AS clean_acc, b.acc AS business_acc, b.acc - c.acc AS gap
   FROM {pairs} LEFT JOIN a c ON c.task_name = clean_task LEFT JOIN a b ON b.task_name = business_task {having}"""


def _clutter_sql(where: str, pairs: list, having: str) -> str:
    return (_CLUTTER.replace("{where}", where)
            .replace("{pairs}", fx.values_sql(pairs, "clean_task, business_task, primitive"))
            .replace("{having}", having))


_CLUTTER_1 = _clutter_sql("WHERE NOT coalesce(reasoning_mode, false)", dims.CLUTTER_PAIRS, "")


@query("agg9", _CLUTTER_1)
def agg9(spark, sf_dir):
    return acc.clutter_tax(fx.results(spark, sf_dir))


@query("jn5", _clutter_sql("", [dims.EXTRA_CLUTTER_PAIR, *dims.CLUTTER_PAIRS], "WHERE b.acc - c.acc IS NOT NULL"))
def jn5(spark, sf_dir):
    return acc.clutter_tax_all(fx.results(spark, sf_dir))


_S = f"WITH {fx.STRATEGY_SQL}"
_CELL = _S + """, cell AS (SELECT task_name, strategy, rank, (count(*) FILTER (WHERE correct))::DOUBLE / count(*) * 100 AS acc
   FROM strategy_results WHERE NOT ends_with(task_name, '_text') GROUP BY ALL)"""
_WIDE = ", ".join(f"max(acc) FILTER (WHERE strategy = '{s}') AS {s}" for s in dims.STRATEGIES)


@query("agg20", f"{_CELL} SELECT task_name, {_WIDE} FROM cell GROUP BY task_name")
def agg20(spark, sf_dir):
    return st.task_matrix(fx.strategy_results(spark, sf_dir), "strategy", dims.STRATEGIES)


_BEST = _CELL + """, best AS (SELECT task_name, arg_max(strategy, acc * 1000 - rank) AS best_strategy, max(acc) AS best_acc,
   max(acc) - coalesce(max(acc) FILTER (WHERE strategy = 'baseline'), 0) AS delta FROM cell GROUP BY task_name)"""


@query("agg21", _BEST + " SELECT * FROM best")
def agg21(spark, sf_dir):
    return st.best_strategies(fx.strategy_results(spark, sf_dir))


@query("agg22", _S + """, m AS (SELECT strategy, (count(*) FILTER (WHERE correct))::DOUBLE / count(*) * 100 AS mean_acc
   FROM strategy_results WHERE NOT ends_with(task_name, '_text') GROUP BY strategy)
   SELECT strategy, mean_acc, mean_acc - (SELECT mean_acc FROM m WHERE strategy = 'baseline') AS delta,
   CASE WHEN mean_acc - (SELECT mean_acc FROM m WHERE strategy = 'baseline') > 0 THEN '↑'
     WHEN mean_acc - (SELECT mean_acc FROM m WHERE strategy = 'baseline') < 0 THEN '↓' ELSE '→' END AS direction FROM m""")
def agg22(spark, sf_dir):
    return st.strategy_means(fx.strategy_results(spark, sf_dir))


_NINE = "(" + ", ".join(f"'{t}'" for t in dims.BENCHMARK_TASKS) + ")"


@query("agg23", _CELL + f""", m AS (SELECT strategy, sum(acc) / 9 AS mean_acc FROM cell WHERE task_name IN {_NINE} GROUP BY strategy)
   SELECT strategy, round(mean_acc, 6) AS mean_acc, round(mean_acc - (SELECT mean_acc FROM m WHERE strategy = 'baseline'), 6) AS delta FROM m""")
def agg23(spark, sf_dir):
    means = st.strategy_task_means(fx.strategy_results(spark, sf_dir), dims.BENCHMARK_TASKS, dims.STRATEGIES)
    return rounded(means, "mean_acc", "delta")


@query("agg24", _BEST + " SELECT round(avg(best_acc), 6) AS oracle_mean, count(*) AS n_tasks FROM best")
def agg24(spark, sf_dir):
    return rounded(st.oracle_mean(st.best_strategies(fx.strategy_results(spark, sf_dir))), "oracle_mean")


_MODELS = ["m0", "m1", "m2", "m3"]
_MODEL_OF = {"baseline": "m0", "best_of_n": "m1", "verify": "m2", "adaptive": "m3"}


def model_results(spark, sf_dir):
    """Four strategies' results taken as four models' runs."""
    rows = fx.strategy_results(spark, sf_dir).where(F.col("strategy").isin(*_MODEL_OF))
    model = F.lit(None).cast("string")
    for strategy, name in _MODEL_OF.items():
        model = F.when(F.col("strategy") == strategy, name).otherwise(model)
    return rows.withColumn("model", model)


_MODEL_SQL = _S + """, mr AS (SELECT *, CASE strategy WHEN 'baseline' THEN 'm0' WHEN 'best_of_n' THEN 'm1' WHEN 'verify' THEN 'm2' ELSE 'm3' END AS model
   FROM strategy_results WHERE strategy IN ('baseline', 'best_of_n', 'verify', 'adaptive'))"""


@query("agg25", _MODEL_SQL + ", cell AS (SELECT task_name, model, (count(*) FILTER (WHERE correct))::DOUBLE / count(*) * 100 AS acc FROM mr"
       " WHERE NOT ends_with(task_name, '_text') GROUP BY ALL) SELECT task_name, "
       + ", ".join(f"coalesce(max(acc) FILTER (WHERE model = '{m}'), 0) AS {m}" for m in _MODELS) + " FROM cell GROUP BY task_name")
def agg25(spark, sf_dir):
    return st.task_matrix(model_results(spark, sf_dir), "model", _MODELS, 0.0)


_ROUTE = "CASE task_name " + " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in dims.ROUTES.items()) + " ELSE 'verify' END"


@query("agg26", _CELL + f""", g AS (SELECT task_name, coalesce(max(acc) FILTER (WHERE strategy = 'baseline'), 0) AS baseline_acc,
   coalesce(max(acc) FILTER (WHERE strategy = 'adaptive'), 0) AS adaptive_acc FROM cell WHERE task_name IN {_NINE} GROUP BY task_name)
   SELECT *, adaptive_acc - baseline_acc AS delta, {_ROUTE} AS route, abs(adaptive_acc - baseline_acc) >= 3 AS labelled FROM g""")
def agg26(spark, sf_dir):
    return st.routing_gain(fx.strategy_results(spark, sf_dir), dims.BENCHMARK_TASKS)


_AGREE = _MODEL_SQL + """, s AS (SELECT c.task_name, coalesce(a.correct, false) AS a, coalesce(b.correct, false) AS b, c.correct AS c
   FROM (SELECT * FROM mr WHERE model = 'm0') c LEFT JOIN (SELECT * FROM mr WHERE model = 'm1' AND CAST(sample_id AS BIGINT) % 10 > 0) a USING (sample_id)
   LEFT JOIN (SELECT * FROM mr WHERE model = 'm2') b USING (sample_id))"""


def agreeing(spark, sf_dir):
    """One model lacks a tenth of the samples."""
    missing = (F.col("model") == "m1") & (F.col("sample_id").cast("bigint") % 10 == 0)
    return model_results(spark, sf_dir).where(~missing)


@query("agg27", _AGREE + """ SELECT task_name, count(*) AS n, avg((a AND b AND c)::INT) * 100 AS all_correct, avg(((a OR b) AND NOT c)::INT) * 100 AS family_only,
   avg((c AND NOT a AND NOT b)::INT) * 100 AS base_only, avg((NOT a AND NOT b AND NOT c)::INT) * 100 AS all_wrong, avg((c AND a <> b)::INT) * 100 AS rest
   FROM s GROUP BY task_name""")
def agg27(spark, sf_dir):
    return st.model_agreement(agreeing(spark, sf_dir), "m1", "m2", "m0")


@query("jn7", _AGREE + " SELECT task_name, count(*) FILTER (WHERE a) AS a_right, count(*) FILTER (WHERE b) AS b_right, count(*) AS n FROM s GROUP BY task_name")
def jn7(spark, sf_dir):
    """The three runs side by side, by conditional aggregates over one scan."""
    return st.right_answers(agreeing(spark, sf_dir), "m1", "m2", "m0")


def repeats(spark, sf_dir):
    """Every user's repeated responses within an event type, as repeats of one sample."""
    return fx.table(spark, sf_dir, "events").select(
        F.concat_ws("-", "event_type", "user_id").alias("sample_id"),
        F.col("event_type").alias("task_name"),
        F.when(F.col("user_id") % 3 == 0, "same").otherwise(F.col("props")).alias("raw_response"),
    )


_REPEATS = """WITH d AS (SELECT event_type || '-' || user_id::VARCHAR AS sample_id, event_type AS task_name, count(*) AS repeats,
   count(DISTINCT CASE WHEN user_id % 3 = 0 THEN 'same' ELSE props END) = 1 AS match FROM events GROUP BY ALL)"""


@query("agg28", _REPEATS + " SELECT count(*) FILTER (WHERE match) AS n_match, count(*) AS n_total, avg(match::INT) AS match_rate FROM d")
def agg28(spark, sf_dir):
    return ev.determinism_rate(repeats(spark, sf_dir))


@query("agg28_samples", _REPEATS + " SELECT * FROM d")
def agg28_samples(spark, sf_dir):
    return ev.determinism(repeats(spark, sf_dir))


_FAMILY = fx.values_sql([(t, f) for f, ts in dims.FAMILIES.items() for t in ts], "task_name, category")


@query("agg30", T + f""" SELECT coalesce(category, 'Other') AS category, task_name, sum(n)::BIGINT AS n, sum(n_correct)::BIGINT AS n_correct,
   sum(n_correct)::DOUBLE / sum(n) AS accuracy FROM (SELECT t.*, coalesce(v.category, 'Other') AS category FROM tally t LEFT JOIN {_FAMILY} USING (task_name))
   GROUP BY GROUPING SETS ((category), (category, task_name))""")
def agg30(spark, sf_dir):
    return acc.family_accuracy(fx.results(spark, sf_dir))


_RATES = T + " SELECT task_name, n - n_correct AS n_fail, n AS n_total, (n - n_correct)::DOUBLE / n AS fail_rate FROM tally WHERE n > n_correct"


def rates(spark, sf_dir):
    return acc.failure_rates(fx.results(spark, sf_dir))


query("agg31", _RATES)(rates)
query("jn9", _RATES)(rates)


@query("agg32", R + " SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT correct) AS n_failures, (count(*) FILTER (WHERE NOT correct))::DOUBLE / count(*) AS failure_rate, count(DISTINCT task_name) AS n_tasks FROM results")
def agg32(spark, sf_dir):
    return acc.overview(fx.results(spark, sf_dir))


@query("agg33", R + """ SELECT task_name, CASE WHEN stddev_pop(abs_error) > 0 THEN round(corr(CAST(ground_truth AS DOUBLE), abs_error::DOUBLE), 6) END AS size_error_corr,
   (count(*) FILTER (WHERE error > 0))::DOUBLE / nullif(count(error), 0) AS over_share, (count(*) FILTER (WHERE error < 0))::DOUBLE / nullif(count(error), 0) AS under_share
   FROM results GROUP BY task_name""")
def agg33(spark, sf_dir):
    profile = acc.error_profile(fx.results(spark, sf_dir), F.col("ground_truth"))
    return rounded(profile, "size_error_corr")


@query("agg33_echo", R + """ SELECT task_name, count(*) AS n_fail, (count(*) FILTER (WHERE parsed_answer = json_extract_string(params, '$.level')))::DOUBLE / count(*) AS echo_share
   FROM results WHERE NOT correct GROUP BY task_name""")
def agg33_echo(spark, sf_dir):
    return acc.echo_rate(fx.results(spark, sf_dir), F.get_json_object("params", "$.level"))


@query("agg34", R + """ SELECT task_name, (count(*) FILTER (WHERE NOT correct AND (contains(lower(thinking_text), 'maybe') OR contains(lower(thinking_text), 'appears'))))::DOUBLE
   / nullif(count(*) FILTER (WHERE NOT correct), 0) AS hedge_share, avg(length(thinking_text)) FILTER (WHERE correct) AS mean_len_correct,
   avg(length(thinking_text)) FILTER (WHERE NOT correct) AS mean_len_wrong FROM results GROUP BY task_name""")
def agg34(spark, sf_dir):
    return acc.wording_profile(fx.results(spark, sf_dir), ["maybe", "appears"])


@query("agg35", f"""WITH {fx.attempts_sql('best_of_n')}, s AS (SELECT ground_truth, sample_id, max((parsed_answer = ground_truth AND attempt_idx < 1)::INT) AS p1,
   max(coalesce(parsed_answer = ground_truth AND attempt_idx < 4, false)::INT) AS pk FROM attempts GROUP BY ALL)
   SELECT ground_truth, count(*) AS n_samples, avg(coalesce(p1, 0)) AS pass_at_1, avg(pk) AS pass_at_k, avg(pk) > 0.20 AS keep FROM s GROUP BY ground_truth""")
def agg35(spark, sf_dir):
    rows = fx.attempts(spark, sf_dir, "best_of_n").withColumn(
        "correct", F.col("parsed_answer") == F.col("ground_truth")
    )
    return acc.pass_at_k(rows, ["ground_truth"], 4)
