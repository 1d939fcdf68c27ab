"""Queries over episodes: rewards and checks for reward gaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom import dims
from evalloom.functions import rewards
from evalloom.operators import diagnostics as dg, sets
from evalloom.plans import fixtures as fx
from evalloom.plans.catalog import query
from evalloom.plans.fixtures import derive_sql
from evalloom.sources import readers, writers
from evalloom.storage import scratch_path

E = "WITH " + fx.EPISODES_SQL

# What the worked steps and the final answer hold, by form (see the fixture).
_PAIRS = """(CASE form WHEN 0 THEN [[r + 1, rs], [c + 1, c], [r + 1, ra]] WHEN 1 THEN [[r + 1, rs], [c + 1, c]]
   WHEN 4 THEN [[r + 1, rs]] ELSE [] END)"""
_OUTCOME = "(CASE WHEN answer = ground_truth THEN 1.0 ELSE 0.0 END)::DOUBLE"
_CHECK = "(CASE WHEN form = 3 THEN rs = r END)"


def episode_columns(**columns):
    """A query of columns built from (response, truth)."""

    def run(spark, sf_dir):
        rows = fx.episodes(spark, sf_dir)
        made = [build(F.col("response"), F.col("ground_truth")).alias(n) for n, build in columns.items()]
        return rows.select("episode_id", *made)

    return run


def shown_pairs(response, _):
    return F.array_join(
        F.transform(
            F.array_sort(rewards.line_cell_pairs(response)),
            lambda p: F.concat(p["lines"].cast("string"), F.lit(">"), p["cells"].cast("string")),
        ), ","
    )


query("rwd1", E + f" SELECT episode_id, array_to_string([p[1]::VARCHAR || '>' || p[2]::VARCHAR for p in list_sort({_PAIRS})], ',') AS pairs FROM episodes")(
    episode_columns(pairs=shown_pairs)
)
query("rwd2", E + f" SELECT episode_id, {_OUTCOME} AS reward FROM episodes")(
    episode_columns(reward=rewards.outcome)
)
query("rwd3", E + " SELECT episode_id, CASE WHEN form IN (0, 1) THEN rs::VARCHAR END AS last_rows, CASE form WHEN 1 THEN c::VARCHAR END AS last_cols FROM episodes")(
    episode_columns(
        last_rows=lambda response, _: rewards.last_dimension_values(response)["row"],
        last_cols=lambda response, _: rewards.last_dimension_values(response)["col"],
    )
)
# form 0 names its columns with "vertical", which the last-value pattern does not read
query("rwd4", E + """ SELECT episode_id, CASE WHEN form IN (0, 1) AND rs <> ra THEN 0.0 WHEN form = 1 AND c <> ca THEN 0.0 ELSE 1.0 END::DOUBLE AS consistency FROM episodes""")(
    episode_columns(consistency=lambda response, _: rewards.consistency(response))
)
_CONS = "(CASE WHEN form IN (0, 1) AND rs <> ra THEN 0.0 WHEN form = 1 AND c <> ca THEN 0.0 ELSE 1.0 END)::DOUBLE"
_SHARE = f"(len([p for p in {_PAIRS} if p[2] = p[1] - 1])::DOUBLE / len({_PAIRS}))"
_PROCESS = f"(CASE WHEN len({_PAIRS}) = 0 THEN {_OUTCOME} ELSE greatest({_OUTCOME}, 0.8::DOUBLE * {_OUTCOME} + 0.2::DOUBLE * {_SHARE} * {_CONS}) END)"
query("rwd5", E + f" SELECT episode_id, round({_PROCESS}, 9) AS reward FROM episodes")(
    episode_columns(reward=lambda *c: F.round(rewards.process(*c), 9))
)
query("rwd6", E + " SELECT episode_id, has_code FROM episodes")(
    episode_columns(has_code=lambda response, _: rewards.has_code(response))
)
query("rwd7", E + f" SELECT episode_id, {_CHECK} AS agrees FROM episodes")(
    episode_columns(agrees=rewards.tool_output_check)
)
query("rwd8", E + " SELECT episode_id, form = 2 AS fabricated FROM episodes")(
    episode_columns(fabricated=lambda response, _: rewards.fabricated(response))
)
_TOOL = f"""(CASE WHEN NOT has_code THEN {_OUTCOME} WHEN form = 2 THEN {_OUTCOME} * 0.7::DOUBLE WHEN {_CHECK} IS NULL OR {_OUTCOME} = 1 THEN {_OUTCOME}
   WHEN {_CHECK} THEN 0.5 ELSE 0.0 END)::DOUBLE"""
query("rwd9", E + f" SELECT episode_id, {_TOOL} AS reward FROM episodes")(
    episode_columns(reward=rewards.tool_use)
)


@query("udf4", E + " SELECT episode_id, length(response)::DOUBLE AS reward_brief FROM episodes")
def udf4(spark, sf_dir):
    """A reward of the user's own, added by name."""
    own = {"brief": lambda response, truth: F.length(response).cast("double")}
    return dg.add_rewards(fx.episodes(spark, sf_dir), registry=own).select("episode_id", "reward_brief")


# ---------------------------------------------------------------- checks

def profile(spark, sf_dir):
    return dg.profile(fx.episodes(spark, sf_dir))


_COUNTS = E + """, pred AS (SELECT coalesce(answer, 'UNPARSED') AS key, count(*) AS p, min(episode_id) AS seen FROM episodes GROUP BY ALL),
   truths AS (SELECT ground_truth AS key, count(*) AS q FROM episodes GROUP BY ALL), total AS (SELECT count(*) AS n FROM episodes)"""
_DIST = _COUNTS + """, top AS (SELECT string_agg(key || '=' || p::VARCHAR, ';' ORDER BY p DESC, seen) AS top_answers FROM (SELECT * FROM pred ORDER BY p DESC, seen LIMIT 10)),
   kl AS (SELECT sum(p::DOUBLE / n * ln((p::DOUBLE / n) / CASE WHEN q IS NULL THEN 1.0::DOUBLE / n ELSE q::DOUBLE / n END)) AS kl FROM pred LEFT JOIN truths USING (key), total),
   dist AS (SELECT n AS n_episodes, (SELECT count(*) FROM pred) AS n_unique, (SELECT key FROM pred ORDER BY p DESC, seen LIMIT 1) AS top_answer,
     (SELECT max(p) FROM pred)::DOUBLE / n AS top_share, kl, top_answers FROM total, kl, top)"""


@query("dia1", _DIST + " SELECT n_episodes, n_unique, top_answer, round_even(top_share, 3) AS top_fraction, top_share > 0.15 AS dominant, round_even(kl, 4) AS kl_divergence, top_answers FROM dist")
def dia1(spark, sf_dir):
    shown = F.array_join(
        F.transform("top_answers", lambda s: F.concat(s["answer"], F.lit("="), s["n"].cast("string"))), ";"
    )
    return dg.answer_distribution(profile(spark, sf_dir)).withColumn("top_answers", shown)


_TOPS = _COUNTS + " SELECT key AS answer, p AS n FROM pred ORDER BY p DESC, seen LIMIT 10"


@query("top3", _TOPS)
def top3(spark, sf_dir):
    top = dg.answer_distribution(profile(spark, sf_dir))
    return top.select(F.inline("top_answers"))


@query("set5", _COUNTS + " SELECT coalesce(a.key, b.key) AS key, coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM pred a FULL JOIN truths b USING (key)")
def set5(spark, sf_dir):
    """Predicted and true answers as one full outer join of two count tables."""
    prof = profile(spark, sf_dir)
    pred = prof.select(F.coalesce("answer", F.lit(dg.UNPARSED)).alias("key"), "n")
    return sets.counts_of_either(pred, prof.select(F.col("ground_truth").alias("key"), "n"))


_SIZES = E + """, sizes AS (SELECT ground_truth, round_even(avg((answer IS NOT DISTINCT FROM ground_truth)::INT), 3) AS accuracy, count(*) AS n FROM episodes GROUP BY ground_truth)"""


@query("dia2", _SIZES + """ SELECT count(*) AS n_sizes, round_even(CASE WHEN count(*) FILTER (WHERE n >= 3) >= 5 THEN stddev_pop(accuracy) FILTER (WHERE n >= 3) ELSE 0 END, 4) AS accuracy_std,
   count(*) FILTER (WHERE n >= 3) >= 5 AND stddev_pop(accuracy) FILTER (WHERE n >= 3) < 0.05 AS flat FROM sizes""")
def dia2(spark, sf_dir):
    return dg.size_accuracy(profile(spark, sf_dir))


@query("dia2_sizes", _SIZES + " SELECT * FROM sizes")
def dia2_sizes(spark, sf_dir):
    return dg.size_table(profile(spark, sf_dir))


@query("top4", _SIZES + """ SELECT *, 'low' AS side FROM (SELECT * FROM sizes ORDER BY accuracy, ground_truth LIMIT 5)
   UNION ALL SELECT *, 'high' FROM (SELECT * FROM sizes ORDER BY accuracy DESC, ground_truth DESC LIMIT 5)""")
def top4(spark, sf_dir):
    return dg.size_extremes(profile(spark, sf_dir))


_STEPS = f"""avg(({_CONS} = 1)::INT)"""


@query("dia3", E + f""" SELECT count(*) AS n_episodes, round_even({_STEPS}, 3) AS consistency_rate,
   round_even(avg((form = 1)::INT), 3) AS subtraction_rate, {_STEPS} < 0.70 AS low_consistency FROM episodes""")
def dia3(spark, sf_dir):
    """Form 0 puts a word between the number and *lines*, which this check does not read."""
    return dg.step_consistency(profile(spark, sf_dir))


_BUCKETS = fx.values_sql([(i, *b) for i, b in enumerate(dims.SIZE_BUCKETS)], "position, bucket, lo, hi")
_RATES = E + f""" SELECT bucket, position, round_even(coalesce(avg(has_code::INT), 0), 3) AS rate, count(e.episode_id) AS n,
   position = 0 AND coalesce(avg(has_code::INT), 0) > 0.30 AS overused FROM {_BUCKETS} LEFT JOIN episodes e ON greatest(r, c) BETWEEN lo AND hi GROUP BY bucket, position"""


def tool_rates(spark, sf_dir):
    return dg.tool_rates(profile(spark, sf_dir))


query("dia4", _RATES)(tool_rates)


@query("jn13", E + f""" SELECT bucket, count(e.episode_id) AS n FROM {_BUCKETS} LEFT JOIN episodes e ON greatest(r, c) BETWEEN lo AND hi GROUP BY bucket""")
def jn13(spark, sf_dir):
    """Ranges are matched on the row itself; the list of buckets only adds the empty ones."""
    buckets = dims.inline_table(spark, dims.SIZE_BUCKETS, "bucket, lo, hi").select("bucket")
    sides = F.transform(F.split("ground_truth", ","), lambda v: v.try_cast("int"))
    named = dg.bucket(F.array_max(sides), dims.SIZE_BUCKETS, closed=True)
    counted = fx.episodes(spark, sf_dir).groupBy(named.alias("bucket")).agg(F.count("*").alias("n"))
    return buckets.join(counted, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


_BINS = fx.values_sql(dims.CONFIDENCE_BINS, "confidence_bin, lo, hi")


@query("dia5", E + f""" SELECT confidence_bin, round_even(avg((answer IS NOT DISTINCT FROM ground_truth)::INT), 3) AS accuracy, count(*) AS n,
   confidence_bin = '0.9-1.0' AND count(*) >= 5 AND avg((answer IS NOT DISTINCT FROM ground_truth)::INT) < 0.7 AS overconfident
   FROM episodes JOIN {_BINS} ON conf >= lo AND conf < hi GROUP BY confidence_bin""")
def dia5(spark, sf_dir):
    return dg.calibration(profile(spark, sf_dir))


@query("dia5_status", E + " SELECT count(conf) AS n_with_confidence, CASE WHEN count(conf) = 0 THEN 'no_confidence_data' ELSE 'ok' END AS status FROM episodes")
def dia5_status(spark, sf_dir):
    return dg.calibration_status(profile(spark, sf_dir))


_FLAGS = _DIST + f""", facts AS (SELECT {_STEPS} AS cons, avg(has_code::INT) FILTER (WHERE greatest(r, c) BETWEEN 3 AND 8) AS easy,
     avg((answer IS NOT DISTINCT FROM ground_truth)::INT) FILTER (WHERE conf >= 0.9 AND conf < 1.01) AS top_bin,
     count(*) FILTER (WHERE conf >= 0.9 AND conf < 1.01) AS top_n FROM episodes),
   sizes AS (SELECT ground_truth, round_even(avg((answer IS NOT DISTINCT FROM ground_truth)::INT), 3) AS accuracy, count(*) AS n FROM episodes GROUP BY ground_truth),
   flat AS (SELECT count(*) FILTER (WHERE n >= 3) >= 5 AND stddev_pop(accuracy) FILTER (WHERE n >= 3) < 0.05 AS flat, stddev_pop(accuracy) FILTER (WHERE n >= 3) AS std FROM sizes),
   flags AS (SELECT list_filter([CASE WHEN top_share > 0.15 THEN 'DOMINANT PREDICTION: ''' || top_answer || ''' accounts for ' || round_even(round_even(top_share, 3) * 100, 0)::BIGINT::VARCHAR || '% of answers' END,
     CASE WHEN flat THEN 'FLAT ACCURACY: std=' || printf('%.4f', std) || ' across sizes (suspiciously uniform)' END,
     CASE WHEN cons < 0.70 THEN 'LOW COT CONSISTENCY: ' || round_even(round_even(cons, 3) * 100, 0)::BIGINT::VARCHAR || '% of CoT arithmetic matches final answer' END,
     CASE WHEN easy > 0.30 THEN 'TOOL OVERUSE on easy grids: ' || round_even(round_even(easy, 3) * 100, 0)::BIGINT::VARCHAR || '% tool-use rate for grids <= 8' END,
     CASE WHEN top_n >= 5 AND top_bin < 0.7 THEN 'OVERCONFIDENCE: high confidence (>0.9) with accuracy < 70%' END], lambda m: m IS NOT NULL) AS f FROM dist, facts, flat)"""


@query("dia6", _FLAGS + " SELECT array_to_string(f, ' / ') AS flags, len(f) AS n_flags FROM flags")
def dia6(spark, sf_dir):
    return dg.report(profile(spark, sf_dir)).select(
        F.array_join("flags", " / ").alias("flags"), F.col("n_flags").cast("bigint").alias("n_flags")
    )


@query("snk6", _FLAGS + " SELECT len(f) AS n_flags, n_episodes FROM flags, dist")
def snk6(spark, sf_dir):
    path = scratch_path(spark, "report")
    writers.write_report(profile(spark, sf_dir), path, scratch_path(spark, "report-sizes"))
    return spark.read.text(path).select(
        F.get_json_object("value", "$.n_flags").cast("bigint").alias("n_flags"),
        F.get_json_object("value", "$.answer_distribution.n_episodes").cast("bigint").alias("n_episodes"),
    )


@query("snk6_sizes", E + " SELECT ground_truth, round_even(avg((answer IS NOT DISTINCT FROM ground_truth)::INT), 3) AS accuracy, count(*) AS n FROM episodes GROUP BY ground_truth")
def snk6_sizes(spark, sf_dir):
    path, sizes = scratch_path(spark, "report"), scratch_path(spark, "report-sizes")
    writers.write_report(profile(spark, sf_dir), path, sizes)
    return spark.read.schema("ground_truth string, accuracy double, n bigint").json(sizes)


_VERIFY = E + f" SELECT episode_id, {_OUTCOME} AS reward_outcome, round({_PROCESS}, 9) AS reward_process, {_TOOL} AS reward_tool_use FROM episodes WHERE {_OUTCOME} < 1 OR {_PROCESS} < 1 OR {_TOOL} < 1"


@query("dia7", _VERIFY)
def dia7(spark, sf_dir):
    return dg.reward_failures(fx.episodes(spark, sf_dir)).select(
        "episode_id", "reward_outcome", F.round("reward_process", 9).alias("reward_process"), "reward_tool_use"
    )
