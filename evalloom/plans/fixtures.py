"""Question, answer, attempt and episode tables derived from the shared test tables.

Each table is a source table plus stages of added columns. A stage is written once in
the SQL both engines read, so Spark and the check engine see the same rows. ``ddb``
marks the few functions that are spelled differently there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom import dims
from evalloom.operators import evaluate as ev

Stage = dict[str, str]

TASKS = [
    "counting_grid", "pie_chart", "progress_bar", "colored_paths", "nested_squares",
    "hierarchy_depth", "scatter_plot", "realistic_table", "text_degradation",
    "touching_circles", "form_checkboxes", "arrow_following",
]
_IMAGE_ERRORS = [92, 30, 45, 60, 25, 10, 5, 88, 40, 3, 70, 55]
_TEXT_ERRORS = [5, 10, 45, 2, 0, 90, 8, 85, 55, 3, 20, 0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derive(df: DataFrame, stages: list[Stage], columns: list[str] | None = None) -> DataFrame:
    for stage in stages:
        df = df.selectExpr("*", *[f"{expr} AS {name}" for name, expr in stage.items()])
    return df if columns is None else df.select(*columns)


def derive_sql(source: str, stages: list[Stage], columns: list[str] | None = None) -> str:
    query = f"SELECT * FROM {source}"
    for stage in stages:
        added = ", ".join(f"{ddb(expr)} AS {name}" for name, expr in stage.items())
        query = f"SELECT *, {added} FROM ({query})"
    return query if columns is None else f"SELECT {', '.join(columns)} FROM ({query})"


def ddb(expr: str) -> str:
    return expr.replace("get_json_object(", "json_extract_string(")


def choose(by: str, values: list) -> str:
    """CASE over small integers."""
    shown = [f"'{v}'" if isinstance(v, str) else str(v) for v in values]
    arms = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(shown))
    return f"CASE {by} {arms} END"


def text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


NL = "chr(10)"

# --- responses: one model response per event -----------------------------------------
_RESPONSE_STAGES: list[Stage] = [
    {
        "k": "CAST(get_json_object(props, '$.k') AS BIGINT)",
        "ti": "user_id % 12",
        "is_text": "(user_id % 24 >= 12 AND user_id % 12 <> 11)",
    },
    {
        "base_task": choose("ti", TASKS),
        "threshold": f"CASE WHEN is_text THEN {choose('ti', _TEXT_ERRORS)} ELSE {choose('ti', _IMAGE_ERRORS)} END",
        "truth": "k % 10",
    },
    {
        "pred": "truth + CASE WHEN (event_id * 37 + ti * 11) % 100 >= threshold THEN 0 "
                "WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 2 "
                "WHEN truth > 0 THEN -1 ELSE 1 END",
        "first_share": "10 + k % 30",
    },
    {
        "line_no": "event_id",
        "sample_id": text("event_id"),
        "task_name": "CASE WHEN is_text THEN base_task || '_text' ELSE base_task END",
        "prompt": "'How many items are in picture ' || " + text("event_id") + " || '?'",
        "ground_truth": text("truth"),
        "parser": "'integer'",
        "scorer": "'integer_distance'",
        "params": "'{\"level\": ' || " + text("user_id % 5") + " || ', \"width\": ' || "
                  + text("event_id % 4") + " || ', \"name\": \"' || event_type || '\", \"size\": {\"w\": ' || "
                  + text("event_id % 3") + " || '}, \"path\": [' || CASE WHEN event_id % 2 = 0 THEN '1' ELSE '1, 2' END"
                  " || '], \"percentages\": [' || " + text("first_share") + " || ', ' || "
                  + text("first_share + event_id % 12") + " || ', ' || "
                  + text("100 - 2 * first_share - event_id % 12") + " || '], \"target_pct\": ' || "
                  + text("first_share") + " || '}'",
        "raw_response": "CASE WHEN event_id % 23 = 22 THEN 'no idea' "
                        "WHEN event_id % 5 = 0 THEN 'The answer is ' || " + text("pred")
                        + " WHEN event_id % 5 = 1 THEN 'I see ' || " + text("pred") + " || ' of them' "
                        "WHEN event_id % 5 = 2 THEN '{$' || " + text("pred") + " || '$}' "
                        "WHEN event_id % 5 = 3 THEN '7 then ' || " + text("pred")
                        + " ELSE 'Yes, ' || " + text("pred") + " END",
        "reasoning_mode": "CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END",
        "model": "'m' || " + text("event_id % 3"),
        "latency_s": "floor(value) + (event_id % 4) * 0.25E0",
        "input_tokens": "100 + k",
        "output_tokens": "10 + event_id % 50",
        "thinking_text": "CASE event_id % 4 WHEN 0 THEN repeat('step ', CAST(k % 7 AS INT)) || 'maybe ' || "
                         + text("pred") + " WHEN 1 THEN 'It appears to be ' || " + text("pred")
                         + " WHEN 2 THEN repeat('look  again ', CAST(40 + k % 9 AS INT)) END",
    },
]
RESPONSE_COLUMNS = [
    "line_no", "sample_id", "task_name", "prompt", "ground_truth", "parser", "scorer", "params",
    "raw_response", "reasoning_mode", "model", "latency_s", "input_tokens", "output_tokens",
    "thinking_text",
]


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(table(spark, sf_dir, "events"), _RESPONSE_STAGES, RESPONSE_COLUMNS)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.evaluate(responses(spark, sf_dir))


def parse_integer_sql(column: str) -> str:
    return (
        f"coalesce(nullif(regexp_extract({column}, '\\{{\\$?(\\d+)\\$?\\}}', 1), ''), "
        f"regexp_extract_all({column}, '\\b(\\d+)\\b', 1)[-1])"
    )


RESPONSES_SQL = f"responses AS ({derive_sql('events', _RESPONSE_STAGES, RESPONSE_COLUMNS)})"
RESULTS_SQL = (
    RESPONSES_SQL
    + f""", parsed AS (SELECT *, {parse_integer_sql('raw_response')} AS parsed_answer FROM responses),
results AS (SELECT *, CAST(parsed_answer AS BIGINT) - CAST(ground_truth AS BIGINT) AS error,
  abs(CAST(parsed_answer AS BIGINT) - CAST(ground_truth AS BIGINT)) AS abs_error,
  coalesce(CAST(parsed_answer AS BIGINT) = CAST(ground_truth AS BIGINT), false) AS correct,
  coalesce(1.0::DOUBLE / (1.0::DOUBLE + abs(CAST(parsed_answer AS BIGINT) - CAST(ground_truth AS BIGINT))), 0.0::DOUBLE) AS score
  FROM parsed)"""
)
TALLY_SQL = RESULTS_SQL + """, tally AS (SELECT task_name, count(*) AS n,
  count(*) FILTER (WHERE correct) AS n_correct, count(*) FILTER (WHERE parsed_answer IS NULL) AS n_unparsed,
  sum(error) AS error_sum, count(error) AS error_n,
  (count(*) FILTER (WHERE correct))::DOUBLE / count(*) AS acc FROM results GROUP BY task_name)"""


def values_sql(rows: list[tuple], columns: str) -> str:
    def shown(v: object) -> str:
        if v is None:
            return "NULL"
        return "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)

    body = ", ".join("(" + ", ".join(shown(v) for v in row) + ")" for row in rows)
    return f"(VALUES {body}) AS v({columns})"


TAXONOMY_SQL = (
    "taxonomy AS (SELECT * FROM "
    + values_sql(dims.TAXONOMY, "task_name, perception, reasoning, category") + ")"
)

# --- strategy results: every event judged under every strategy --------------------------
_STRATEGY_STAGES: list[Stage] = [
    {
        "sample_id": text("event_id"),
        "ti": "user_id % 12",
        "correct": "(event_id * (rank + 3) + user_id * 7) % 100 < 38 + 3 * rank + 5 * (user_id % 4)",
        "k": "CAST(get_json_object(props, '$.k') AS BIGINT)",
    },
    {
        "task_name": "CASE WHEN user_id % 24 >= 12 AND ti <> 11 THEN "
                     + choose("ti", [t + "_text" for t in TASKS]) + " ELSE " + choose("ti", TASKS) + " END",
        "ground_truth": text("k % 10"),
    },
    {"parsed_answer": text("k % 10 + CASE WHEN correct THEN 0 ELSE 1 END")},
]
STRATEGY_COLUMNS = [
    "sample_id", "task_name", "strategy", "rank", "ground_truth", "parsed_answer", "correct",
]


#: The columns that differ by strategy; the others are those of the event.
_JUDGED = ("correct", "parsed_answer")


def judged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the results of all strategies share, a row per event."""
    shared = [{c: e for c, e in stage.items() if c not in _JUDGED} for stage in _STRATEGY_STAGES]
    columns = ["event_id", "user_id", "k", "sample_id", "task_name", "ground_truth"]
    return derive(table(spark, sf_dir, "events"), shared, columns)


def results_of(events: DataFrame, strategy: str) -> DataFrame:
    """Results of one strategy from ``judged_events``: its rows of ``strategy_results``."""
    ranked = events.select("*", F.lit(list(dims.STRATEGIES).index(strategy)).alias("rank"), F.lit(strategy).alias("strategy"))
    own = [{c: e for c, e in stage.items() if c in _JUDGED} for stage in _STRATEGY_STAGES]
    return derive(ranked, own, STRATEGY_COLUMNS)


def strategy_results(spark: SparkSession, sf_dir: str, strategy: str | None = None) -> DataFrame:
    """Results of all strategies, or of one, which is then made alone."""
    if strategy is not None:
        return results_of(judged_events(spark, sf_dir), strategy)
    listed = F.array(*[F.lit(s) for s in dims.STRATEGIES])
    crossed = table(spark, sf_dir, "events").select("*", F.posexplode(listed).alias("rank", "strategy"))
    return derive(crossed, _STRATEGY_STAGES, STRATEGY_COLUMNS)


_STRATEGY_VALUES = values_sql(list(enumerate(dims.STRATEGIES)), "rank, strategy")
STRATEGY_SQL = (
    "strategy_results AS ("
    + derive_sql(f"(SELECT * FROM events CROSS JOIN {_STRATEGY_VALUES})", _STRATEGY_STAGES, STRATEGY_COLUMNS)
    + ")"
)

# --- attempts: the calls made under one strategy -----------------------------------------
CALLS = {
    "best_of_n": [("sample", i) for i in range(5)],
    "verify": [("full", 0), ("verify", 0)],
    "best_of_n_verify": [("sample", i) for i in range(5)] + [("verify", 0)],
    "crop_zoom": [("full", 0)] + [("crop", i) for i in range(4)],
    "decompose": [("sub", 0), ("sub", 1), ("final", 0)],
    "code_vision": [("code", 0), ("output", 0), ("final", 0)],
    "iterative_refine": [("round", i) for i in range(5)],
    "sketchpad": [("pass", 1), ("pass", 2)],
}
#: The same strategies with more calls than a run makes by default.
MANY_CALLS = CALLS | {
    "best_of_n": [("sample", i) for i in range(9)],
    "crop_zoom": [("full", 0)] + [("crop", i) for i in range(6)],
    "decompose": [("sub", i) for i in range(6)] + [("final", 0)],
    "iterative_refine": [("round", i) for i in range(7)],
}
_ATTEMPT_STAGES: list[Stage] = [
    {
        "guess": "(truth + (event_id * 7 + attempt_idx * (1 + event_id % 3)) % 5 % 3) % 10",
        "silent": "(event_id + attempt_idx * 2) % 11 = 0",
        "base": "choose_task",
    },
    {
        "said": "CASE WHEN silent THEN 'no idea' ELSE 'I see ' || " + text("guess") + " END",
        "final_parser": "CASE WHEN base = 'counting_grid' THEN 'row_col' ELSE 'integer' END",
    },
    {
        "parser": "CASE pass_kind WHEN 'final' THEN final_parser WHEN 'sub' THEN "
                  "(CASE WHEN base = 'counting_grid' THEN 'integer' END) "
                  "WHEN 'code' THEN NULL WHEN 'output' THEN NULL ELSE 'integer' END",
        "prompt": "repeat('Count part ', CAST(8 + attempt_idx * 4 AS INT))",
        "raw_response": "CASE pass_kind "
            "WHEN 'verify' THEN (CASE event_id % 4 WHEN 0 THEN 'Yes, that is correct' "
            "WHEN 1 THEN 'No, it is ' || " + text("guess") + " WHEN 2 THEN 'unsure' "
            "ELSE 'The right count is ' || " + text("guess") + " END) "
            "WHEN 'final' THEN (CASE WHEN silent OR event_id % 5 = 0 THEN 'unclear' "
            "WHEN final_parser = 'row_col' THEN 'rows=' || " + text("guess") + " || ' columns=3' "
            "ELSE 'I see ' || " + text("guess") + " END) "
            "WHEN 'code' THEN (CASE WHEN event_id % 2 = 0 THEN 'Try' || " + NL + " || '```python' || " + NL
            + " || 'print(' || " + text("guess") + " || ')' || " + NL + " || '```' ELSE ' print(1) ' END) "
            "WHEN 'output' THEN repeat('out ' || " + text("guess") + " || ' ', CAST(event_id % 200 AS INT)) "
            "WHEN 'pass' THEN (CASE WHEN attempt_idx = 1 THEN (CASE event_id % 4 "
            "WHEN 0 THEN 'TOOL(detect_boxes)' WHEN 1 THEN 'ANSWER: ' || " + text("guess")
            + " WHEN 2 THEN said ELSE 'TOOL(guess_it, 3) or ' || " + text("guess") + " END) "
            "ELSE (CASE WHEN event_id % 3 = 0 THEN 'TOOL(detect_edges)' ELSE 'ANSWER ' || " + text("guess") + " END) END) "
            "ELSE said END",
        "sample_id": text("event_id"),
        "task_name": "base",
        "latency_s": "floor(value) + attempt_idx * 0.5E0",
        "input_tokens": "100 + k",
        "output_tokens": "10 + event_id % 50 + attempt_idx",
    },
]
_ATTEMPT_STAGES[0]["base"] = choose("user_id % 12", TASKS)
_ATTEMPT_BASE: list[Stage] = [
    {"k": "CAST(get_json_object(props, '$.k') AS BIGINT)"},
    {"truth": "k % 10", "ground_truth": text("k % 10")},
]
ATTEMPT_COLUMNS = [
    "sample_id", "task_name", "parser", "pass_kind", "attempt_idx", "prompt", "raw_response",
    "latency_s", "input_tokens", "output_tokens", "ground_truth",
]


def attempts(spark: SparkSession, sf_dir: str, strategy: str, made: dict[str, list] = CALLS) -> DataFrame:
    """Calls of one strategy, with ``parsed_answer``."""
    calls = F.array(
        *[F.struct(F.lit(k).alias("pass_kind"), F.lit(i).alias("attempt_idx")) for k, i in made[strategy]]
    )
    crossed = (
        derive(table(spark, sf_dir, "events"), _ATTEMPT_BASE)
        .select("*", F.explode(calls).alias("call")).select("*", "call.*").drop("call")
    )
    return ev.extract_answers(derive(crossed, _ATTEMPT_STAGES, ATTEMPT_COLUMNS))


def attempts_of(spark: SparkSession, sf_dir: str, strategies: list[str], made: dict[str, list] = CALLS) -> DataFrame:
    """Calls of several strategies in one table with ``strategy``, each event read once."""
    calls = F.array(
        *[
            F.struct(F.lit(name).alias("strategy"), F.lit(k).alias("pass_kind"), F.lit(i).alias("attempt_idx"))
            for name in strategies for k, i in made[name]
        ]
    )
    crossed = (
        derive(table(spark, sf_dir, "events"), _ATTEMPT_BASE)
        .select("*", F.explode(calls).alias("call")).select("*", "call.*").drop("call")
    )
    return ev.extract_answers(derive(crossed, _ATTEMPT_STAGES, [*ATTEMPT_COLUMNS, "strategy"]))


def attempts_sql(strategy: str, made: dict[str, list] = CALLS) -> str:
    crossed = (
        f"(SELECT * FROM ({derive_sql('events', _ATTEMPT_BASE)}) CROSS JOIN "
        f"{values_sql(made[strategy], 'pass_kind, attempt_idx')})"
    )
    return f"""attempts AS (SELECT *, CASE parser WHEN 'integer' THEN {parse_integer_sql('raw_response')}
      WHEN 'row_col' THEN nullif(regexp_extract(raw_response, 'rows=(\\d+)', 1), '') || ',' ||
        nullif(regexp_extract(raw_response, 'columns=(\\d+)', 1), '') END AS parsed_answer
      FROM ({derive_sql(crossed, _ATTEMPT_STAGES, ATTEMPT_COLUMNS)}))"""


# --- episodes: worked grid-size answers with rewards to be computed --------------------------
_EPISODE_STAGES: list[Stage] = [
    {
        "r": "3 + o_custkey % 23",
        "c": "3 + o_orderkey % 23",
        "form": "o_orderkey % 7",
    },
    {
        "ra": "r + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END",
        "ca": "c + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END",
        # the size the worked steps or the tool output state
        "rs": "r + CASE WHEN o_orderkey % 13 = 0 THEN 1 ELSE 0 END",
    },
    {"final": f"{NL} || {NL} || 'rows=' || {text('ra')} || ' columns=' || {text('ca')}"},
    {
        "steps": f"CASE form WHEN 0 THEN {text('r + 1')} || ' horizontal lines → ' || {text('rs')} || ' rows. ' "
                 f"|| {text('c + 1')} || ' vertical lines → ' || {text('c')} || ' columns.' "
                 f"WHEN 1 THEN {text('r + 1')} || ' - 1 = ' || {text('rs')} || ' rows in all of it. ' || {text('c + 1')} "
                 f"|| ' - 1 = ' || {text('c')} || ' columns in all of it.' "
                 f"WHEN 2 THEN '```python' || {NL} || 'print(1)' || {NL} || '```' "
                 f"WHEN 3 THEN '```python' || {NL} || 'import numpy' || {NL} || '```' || {NL} || '```output' || {NL} "
                 f"|| {text('rs')} || ' rows, ' || {text('c')} || ' columns' || {NL} || '```' "
                 f"WHEN 4 THEN 'There are ' || {text('r + 1')} || ' lines in this picture, that is rows = ' || {text('rs')} "
                 f"WHEN 5 THEN '```python' || {NL} || 'go()' || {NL} || '```' || {NL} || '```output' || {NL} || 'done' "
                 f"|| {NL} || '```' "
                 "ELSE 'I cannot tell.' END",
    },
    {
        "episode_id": "o_orderkey",
        "ground_truth": f"{text('r')} || ',' || {text('c')}",
        "response": "CASE WHEN form = 6 THEN steps ELSE steps || final END",
        "confidence": "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 97 = 1 THEN 0.0E0 "
                      "ELSE floor(o_totalprice / 5000) / 100 END",
        "logprob": "CASE WHEN o_orderkey % 8 = 0 THEN -0.5E0 END",
    },
]
EPISODE_COLUMNS = ["episode_id", "ground_truth", "response", "confidence", "logprob"]
_EPISODE_PARTS = ["r", "c", "ra", "ca", "rs", "form", "steps"]


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = derive(table(spark, sf_dir, "orders"), _EPISODE_STAGES, EPISODE_COLUMNS)
    metadata = F.struct(
        F.split("ground_truth", ",")[0].cast("int").alias("rows"),
        F.split("ground_truth", ",")[1].cast("int").alias("cols"),
        F.lit("direct").alias("strategy"), "confidence", "logprob",
    )
    return flat.select("episode_id", "ground_truth", "response", metadata.alias("metadata"))


# The check side reads the parts the response was put together from.
EPISODES_SQL = f"""episodes AS (SELECT *,
   CASE WHEN form = 6 THEN NULL ELSE ra::VARCHAR || ',' || ca::VARCHAR END AS answer,
   CASE WHEN form IN (0, 1) AND rs <> ra THEN 0.0::DOUBLE WHEN form IN (0, 1) AND c <> ca THEN 0.0::DOUBLE
     ELSE 1.0::DOUBLE END AS consistent,
   form IN (0, 1) AS subtracts, form IN (2, 3, 5) AS has_code,
   coalesce(nullif(confidence, 0), logprob) AS conf
   FROM ({derive_sql('orders', _EPISODE_STAGES, EPISODE_COLUMNS + _EPISODE_PARTS)}))"""
