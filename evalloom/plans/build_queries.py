"""Queries that build rows: sampling, sweeps, multiple choice, worked answers, paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom import dims
from evalloom.operators import cot_text, generate as gen, sampling as sm
from evalloom.operators import diagnostics as dg
from evalloom.plans import fixtures as fx
from evalloom.plans.catalog import query
from evalloom.plans.fixtures import NL, choose, text
from evalloom.sources import paths as ph
from evalloom.sources import readers, writers
from evalloom.storage import scratch_path


def hash_sql(seed: object, *columns: str) -> str:
    return "md5(concat_ws('|', '" + str(seed) + "', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in columns) + "))"


def number_sql(seed: object, *columns: str) -> str:
    return f"CAST('0x' || substr({hash_sql(seed, *columns)}, 1, 8) AS BIGINT)"


def pick_sql(n: object, seed: object, *columns: str) -> str:
    return f"({number_sql(seed, *columns)} % {n})"


# ---------------------------------------------------------------- samples

@query("win1", f"""WITH {fx.RESPONSES_SQL} SELECT sample_id, task_name, ground_truth FROM responses
   QUALIFY row_number() OVER (PARTITION BY task_name, ground_truth ORDER BY {hash_sql(42, 'sample_id')}, sample_id) <= 20""")
def win1(spark, sf_dir):
    rows = fx.responses(spark, sf_dir).select("sample_id", "task_name", "ground_truth")
    return sm.balanced_sample(rows, ["task_name", "ground_truth"], 20, 42).drop("rank")


@query("win3", f"""WITH {fx.RESPONSES_SQL}, f AS (SELECT task_name || '/manifest' AS file, line_no, sample_id FROM responses)
   SELECT file, sample_id FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_no) AS rank FROM f) WHERE rank <= 2 ORDER BY file, rank LIMIT 25""")
def win3(spark, sf_dir):
    rows = fx.responses(spark, sf_dir).select(
        F.concat("task_name", F.lit("/manifest")).alias("file"), "line_no", "sample_id"
    )
    return sm.leading_per_file(rows, 25).select("file", "sample_id")


# Sweeps: the values each event type took on three axes, as found in the events.
_AXES = [("color", "chr(CAST(97 + user_id % 6 AS INT))"), ("level", text("user_id % 5")), ("width", text("event_id % 4"))]
_SWEEP_SQL = "sweep AS (" + " UNION ".join(
    f"SELECT event_type AS task_name, {i} AS axis_no, '{a}' AS axis, {v} AS value FROM events" for i, (a, v) in enumerate(_AXES)
) + ")"
_COMBOS_SQL = _SWEEP_SQL + """, v AS (SELECT *, row_number() OVER (PARTITION BY task_name, axis_no ORDER BY value) - 1 AS value_no, count(*) OVER (PARTITION BY task_name, axis_no) AS axis_n FROM sweep),
  combos AS (SELECT a.task_name, (a.value_no * b.axis_n + b.value_no) * c.axis_n + c.value_no AS combo, a.axis_n * b.axis_n * c.axis_n AS n_combos, a.value AS color, b.value AS level, c.value AS width
   FROM v a JOIN v b ON b.task_name = a.task_name AND b.axis_no = 1 JOIN v c ON c.task_name = a.task_name AND c.axis_no = 2 WHERE a.axis_no = 0)"""


def sweep(spark, sf_dir):
    axes = F.array(*[
        F.struct(F.lit(i).alias("axis_no"), F.lit(a).alias("axis"), F.expr(v).alias("value"))
        for i, (a, v) in enumerate(_AXES)
    ])
    values = fx.table(spark, sf_dir, "events").select(F.col("event_type").alias("task_name"), F.explode(axes).alias("x"))
    return values.select("task_name", "x.*", F.col("x.value").alias("value_no")).distinct()


def combos(spark, sf_dir):
    defaults = F.create_map(F.lit("width"), F.lit("9"), F.lit("font"), F.lit("mono"))
    axes = gen.sweep_axes(sweep(spark, sf_dir)).withColumn("defaults", defaults)
    return gen.sweep_combos(axes)


def shown_params(*names):
    return [F.try_element_at("params", F.lit(n)).alias(n) for n in names]


@query("gen1", "WITH " + _COMBOS_SQL + " SELECT task_name, combo, n_combos, color, level, width, 'mono' AS font FROM combos")
def gen1(spark, sf_dir):
    return combos(spark, sf_dir).select(
        "task_name", "combo", "n_combos", *shown_params("color", "level", "width", "font")
    )


@query("gen2", "WITH " + _COMBOS_SQL + " SELECT DISTINCT task_name, n_combos, least(greatest(1, ceil(500.0 / n_combos)), 20)::BIGINT AS n_per FROM combos")
def gen2(spark, sf_dir):
    return combos(spark, sf_dir).select("task_name", "n_combos").distinct().withColumn(
        "n_per", gen.replicas(F.col("n_combos"), 500, 20)
    )


@query("top5", "WITH " + _COMBOS_SQL + """ SELECT DISTINCT task_name, CASE WHEN n_combos * 5 > 300 THEN greatest(1, floor(300 / 5)) ELSE n_combos END::BIGINT AS keep FROM combos""")
def top5(spark, sf_dir):
    keep = gen.combos_to_keep(F.col("n_combos"), F.lit(5), 300)
    return combos(spark, sf_dir).select("task_name", "n_combos").distinct().select("task_name", keep.alias("keep"))


_KEY = ("task_name", "combo", "replica")


@query("gen3", "WITH " + _COMBOS_SQL + f""", r AS (SELECT *, unnest(range(0, 3)) AS replica FROM combos)
   SELECT task_name, combo, replica, substr({hash_sql('sample', *_KEY)}, 1, 8) AS sample_id, {number_sql('seed', *_KEY)} % 2147483648 AS seed FROM r""")
def gen3(spark, sf_dir):
    return gen.expand_replicas(combos(spark, sf_dir), F.lit(3)).select(*_KEY, "sample_id", "seed")


@query("prj11", "WITH " + _COMBOS_SQL + f""", r AS (SELECT *, unnest(range(0, 3)) AS replica FROM combos), s AS (SELECT *, substr({hash_sql('sample', *_KEY)}, 1, 8) AS sample_id FROM r)
   SELECT task_name, 'color=' || color || ';font=mono;level=' || level || ';width=' || width AS params_key, level AS ground_truth, min(sample_id) AS sample_id FROM s GROUP BY ALL""")
def prj11(spark, sf_dir):
    rows = gen.expand_replicas(combos(spark, sf_dir), F.lit(3))
    return gen.drop_repeats(rows.withColumn("ground_truth", F.try_element_at("params", F.lit("level"))))


@query("win10", "WITH " + _COMBOS_SQL + f""", h AS (SELECT *, {hash_sql(42, 'task_name', 'combo')} AS h FROM combos),
   vals AS (SELECT task_name, combo, h, unnest([0, 1, 2]) AS axis_no, unnest([color, level, width]) AS value FROM h),
   named AS (SELECT task_name, axis_no, value, arg_min(combo, h) AS combo FROM vals GROUP BY ALL),
   covers AS (SELECT task_name, combo, min(axis_no::VARCHAR || value) AS covers FROM named GROUP BY ALL)
   SELECT task_name, combo, color, level, width, covers IS NOT NULL AS for_coverage FROM h LEFT JOIN covers USING (task_name, combo)
   QUALIFY row_number() OVER (PARTITION BY task_name ORDER BY covers IS NULL, covers, h) <= 30""")
def win10(spark, sf_dir):
    return sm.coverage_sample(combos(spark, sf_dir), 30).select(
        "task_name", "combo", *shown_params("color", "level", "width"), "for_coverage"
    )


# ---------------------------------------------------------------- multiple choice

def choices(spark, sf_dir):
    """Parts: the price is the right value, the other values are made from it.

    The rows are dealt out first: millions of them fit a file of one split, and each takes long.
    """
    price = F.floor("p_retailprice")
    parts = fx.table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return parts.repartition("p_partkey").select(
        F.col("p_partkey").cast("string").alias("question_id"),
        F.concat(F.lit("What does part "), F.col("p_partkey").cast("string"), F.lit(" cost?")).alias("question"),
        F.when(F.col("p_partkey") % 50 == 0, 0.0).otherwise(price.cast("double")).alias("correct"),
        F.array((price + F.col("p_size") * 7).cast("double"), (price - 3).cast("double"), price.cast("double"),
                (price + F.col("p_size") * 11).cast("double")).alias("others"),
    )


_CHOICE_SQL = """q AS (SELECT CAST(p_partkey AS VARCHAR) AS question_id, CASE WHEN p_partkey % 50 = 0 THEN 0.0 ELSE floor(p_retailprice) END::DOUBLE AS correct,
    [floor(p_retailprice) + p_size * 7, floor(p_retailprice) - 3, floor(p_retailprice), floor(p_retailprice) + p_size * 11]::DOUBLE[] AS others FROM part),
  g AS (SELECT *, greatest((list_max(others || [correct]) - list_min(others || [correct])) * 0.15::DOUBLE, 1) AS least_gap,
    greatest(floor((list_max(others || [correct]) - list_min(others || [correct])) * 0.15::DOUBLE), 2) AS step FROM q),
  cand AS (SELECT *, [s.v for s in list_sort(list_transform(others, lambda v, i: {{'h': {h_other}, 'v': v}}))]
     || [round_even(CASE WHEN correct <> 0 THEN correct * (s.v + 1) ELSE s.v * 10 END, 0) for s in list_sort(list_transform({offsets}::DOUBLE[], lambda v, i: {{'h': {h_offset}, 'v': v}}))]
     || flatten([[correct + d * step, correct - d * step] for d in range(1, 20)]) AS cands FROM g),
  made AS (SELECT *, list_reduce([[correct]] || [[c] for c in cands], lambda acc, x: CASE WHEN len(acc) < 4 AND len([e for e in acc if abs(x[1] - e) < least_gap]) = 0 THEN acc || x ELSE acc END)[2:] AS wrong FROM cand)"""
_CHOICE_SQL = _CHOICE_SQL.format(
    h_other=hash_sql("42other", "question_id", "i - 1"), h_offset=hash_sql("42offset", "question_id", "i - 1"),
    offsets=str(dims.DISTRACTOR_OFFSETS),
)


def with_distractors(spark, sf_dir):
    wrong = gen.distractors(F.col("question_id"), F.col("correct"), F.col("others"))
    return choices(spark, sf_dir).withColumn("wrong", wrong)


@query("gen4", f"WITH {_CHOICE_SQL} SELECT question_id, array_to_string([w::BIGINT for w in wrong], ',') AS wrong FROM made")
def gen4(spark, sf_dir):
    shown = F.array_join(F.transform("wrong", lambda w: w.cast("bigint").cast("string")), ",")
    return with_distractors(spark, sf_dir).select("question_id", shown.alias("wrong"))


@query("gen5", f"""WITH {_CHOICE_SQL}, o AS (SELECT *, list_sort(list_transform([correct] || wrong, lambda v, i: {{'h': {hash_sql('42choice', 'question_id', 'i - 1')}, 'v': v, 'ok': i = 1}})) AS mixed FROM made)
   SELECT question_id, 'What does part ' || question_id || ' cost?' || chr(10) || array_to_string(list_transform(mixed, lambda s, i: '(' || ['A', 'B', 'C', 'D'][i] || ') ' || s.v::BIGINT::VARCHAR), chr(10)) || chr(10) || '{dims.CHOICE_CLOSING}' AS prompt,
   ['A', 'B', 'C', 'D'][list_position([s.ok for s in mixed], true)] AS letter FROM o""")
def gen5(spark, sf_dir):
    made = gen.choice_prompt(F.col("question_id"), F.col("question"), F.col("correct"), F.col("wrong"))
    return with_distractors(spark, sf_dir).select("question_id", made.alias("m")).select("question_id", "m.*")


@query("gen5_format", f"""WITH {_CHOICE_SQL}, o AS (SELECT *, list_sort(list_transform([correct] || wrong, lambda v, i: {{'h': {hash_sql('42choice', 'question_id', 'i - 1')}, 'v': v, 'ok': i = 1}})) AS mixed FROM made)
   SELECT question_id, 'What does part ' || question_id || ' cost?' || chr(10) || array_to_string(list_transform(mixed, lambda s, i: '(' || ['A', 'B', 'C', 'D'][i] || ') $' || format('{{:,}}', s.v::BIGINT)), chr(10)) || chr(10) || '{dims.CHOICE_CLOSING}' AS prompt,
   ['A', 'B', 'C', 'D'][list_position([s.ok for s in mixed], true)] AS letter FROM o""")
def gen5_format(spark, sf_dir):
    made = gen.choice_prompt(F.col("question_id"), F.col("question"), F.col("correct"), F.col("wrong"), value_format=gen.money)
    return with_distractors(spark, sf_dir).select("question_id", made.alias("m")).select("question_id", "m.*")


# ---------------------------------------------------------------- worked answers

_SEED = "o_orderkey % 50000"


def seeds(spark, sf_dir):
    """Seeds of the three strategies from the order keys, spread over their ranges."""
    rows = fx.table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 7919 % 50000).alias("seed")).distinct()
    return rows.withColumn("strategy", gen.sft_strategy(F.col("seed")))


_SEEDS_SQL = """seeds AS (SELECT DISTINCT o_orderkey * 7919 % 50000 AS seed FROM orders),
  kinds AS (SELECT seed, CASE WHEN seed < 20000 THEN 'direct' WHEN seed < 40000 THEN 'intermediate_repr' ELSE 'tool_use' END AS strategy,
    seed BETWEEN 40000 AND 40199 AS is_skip FROM seeds)"""
_KIND = "CASE WHEN is_skip THEN 'tool_use_skip' ELSE strategy END"
_LOW = f"CASE {_KIND} WHEN 'tool_use' THEN 12 ELSE 3 END"
_SIZE = f"CASE {_KIND} WHEN 'direct' THEN 10 WHEN 'intermediate_repr' THEN 13 WHEN 'tool_use' THEN 14 ELSE 6 END"
_SFT_SQL = _SEEDS_SQL + f""", sized AS (SELECT *, {_KIND} AS kind, {_LOW} + {number_sql('size', 'seed')} % (({_SIZE}) * ({_SIZE})) // ({_SIZE}) AS rows,
    {_LOW} + {number_sql('size', 'seed')} % (({_SIZE}) * ({_SIZE})) % ({_SIZE}) AS cols FROM kinds)"""


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def fill_sql(template: str, sketch: str) -> str:
    out = template
    for name, value in {
        "rows": "rows", "cols": "cols", "h_lines": "(rows + 1)", "v_lines": "(cols + 1)",
        "h_interior": "(rows - 1)", "v_interior": "(cols - 1)",
    }.items():
        out = f"replace({out}, '{{{name}}}', {value}::VARCHAR)"
    return f"replace(replace(replace({out}, '{{ascii_sketch}}', {sketch}), '{{{{', '{{'), '}}}}', '}}')"


_WIDE = "CASE WHEN cols > 8 THEN ' ...' ELSE '' END"
_BAR = f"('+' || repeat('---+', least(cols, 8)::INT) || {_WIDE})"
_CELLROW = f"('|' || repeat('   |', least(cols, 8)::INT) || {_WIDE})"
SKETCH_SQL = f"({_BAR} || repeat(chr(10) || {_CELLROW} || chr(10) || {_BAR}, least(rows, 8)::INT) || CASE WHEN rows > 8 THEN chr(10) || '  ...' ELSE '' END)"
_TEMPLATE = "CASE kind " + " ".join(
    f"WHEN '{kind}' THEN [" + ", ".join(sql_text(t) for t in texts) + f"][{number_sql('template', 'seed')} % {len(texts)} + 1]"
    for kind, texts in cot_text.TEMPLATES.items()
) + " END"
_NOTE = sql_text(cot_text.CORRECTION)
_COT_SQL = _SFT_SQL + f""", filled AS (SELECT *, {fill_sql(_TEMPLATE, SKETCH_SQL)} AS steps, strategy = 'direct' AND {pick_sql(100, 'correct', 'seed')} < 20 AS self_correction FROM sized),
  noted AS (SELECT *, string_split(steps, chr(10)) AS ls, replace(replace({_NOTE}, '{{h_lines}}', (rows + 1)::VARCHAR), '{{rows}}', rows::VARCHAR) AS note FROM filled),
  spot AS (SELECT *, list_min(list_filter(range(1, len(ls) + 1), lambda i: contains(lower(ls[i]), 'horizontal') AND contains(ls[i], (rows + 1)::VARCHAR))) AS pos FROM noted),
  done AS (SELECT *, CASE WHEN self_correction AND pos IS NOT NULL THEN array_to_string(ls[1:pos] || [note] || ls[pos + 1:], chr(10)) ELSE steps END AS chain_of_thought FROM spot)"""


@query("gen6", "WITH " + _SFT_SQL + f""" SELECT seed, strategy, is_skip, rows, cols, rows::VARCHAR || ',' || cols::VARCHAR AS ground_truth, 'rows=' || rows::VARCHAR || ' columns=' || cols::VARCHAR AS answer,
   CASE WHEN greatest(rows, cols) > 15 THEN [512, 768, 1024][{pick_sql(3, 'resolution', 'seed')} + 1] ELSE [384, 512, 768][{pick_sql(3, 'resolution', 'seed')} + 1] END::BIGINT AS resolution,
   {pick_sql(3, 'line', 'seed')} + 1 AS line_width, {pick_sql(31, 'padtop', 'seed')} AS pad_top, {pick_sql(31, 'padright', 'seed')} AS pad_right, {pick_sql(31, 'padbottom', 'seed')} AS pad_bottom,
   {pick_sql(31, 'padleft', 'seed')} AS pad_left, {pick_sql(4, 'background', 'seed')} AS background, round(0.85::DOUBLE + {pick_sql(3001, 'stretchwidth', 'seed')} / 10000.0::DOUBLE, 4) AS stretch_width,
   round(0.85::DOUBLE + {pick_sql(3001, 'stretchheight', 'seed')} / 10000.0::DOUBLE, 4) AS stretch_height FROM sized""")
def gen6(spark, sf_dir):
    return gen.training_rows(seeds(spark, sf_dir)).drop("prompt", "chain_of_thought", "self_correction")


@query("gen7", "WITH " + _COT_SQL + " SELECT seed, steps FROM done WHERE NOT self_correction")
def gen7(spark, sf_dir):
    rows = gen.training_rows(seeds(spark, sf_dir)).where(~F.col("self_correction"))
    return rows.select("seed", F.col("chain_of_thought").alias("steps"))


@query("gen8", "WITH " + _COT_SQL + " SELECT seed, chain_of_thought FROM done WHERE self_correction")
def gen8(spark, sf_dir):
    return gen.training_rows(seeds(spark, sf_dir)).where("self_correction").select("seed", "chain_of_thought")


@query("gen9", f"WITH g AS (SELECT o_orderkey, 3 + o_custkey % 23 AS rows, 3 + o_orderkey % 23 AS cols FROM orders) SELECT o_orderkey, {SKETCH_SQL} AS sketch FROM g")
def gen9(spark, sf_dir):
    rows, cols = 3 + F.col("o_custkey") % 23, 3 + F.col("o_orderkey") % 23
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", gen.grid_sketch(rows, cols).alias("sketch"))


_SPLIT_SQL = """s AS (SELECT o_orderkey * 104729 % 1100000 AS seed, CASE WHEN o_custkey % 200 = 0 THEN 'eval' END AS claimed FROM orders),
  d AS (SELECT seed, CASE WHEN seed < 100000 THEN 'sft' WHEN seed < 500000 THEN 'rl' WHEN seed < 510000 THEN 'eval' WHEN seed >= 999000 THEN 'verify' END AS own, claimed FROM s)"""


def split_rows(spark, sf_dir):
    seed = F.col("o_orderkey") * 104729 % 1100000
    return fx.table(spark, sf_dir, "orders").select(
        seed.alias("seed"), gen.seed_split(seed).alias("own"),
        F.when(F.col("o_custkey") % 200 == 0, "eval").alias("claimed"),
    )


@query("gen10", f"WITH {_SPLIT_SQL} SELECT seed, own AS split FROM d")
def gen10(spark, sf_dir):
    return split_rows(spark, sf_dir).select("seed", F.col("own").alias("split"))


@query("gen10_leaks", f"""WITH {_SPLIT_SQL}, u AS (SELECT seed, own AS split FROM d UNION ALL SELECT seed, claimed FROM d WHERE claimed IS NOT NULL)
   SELECT seed, min(split) AS first_split, max(split) AS last_split FROM u GROUP BY seed HAVING count(DISTINCT split) > 1""")
def gen10_leaks(spark, sf_dir):
    rows = split_rows(spark, sf_dir)
    named = F.explode(F.array_compact(F.array("own", "claimed")))
    return gen.seed_leaks(rows.select("seed", named.alias("split")))


@query("src5", "WITH " + _COT_SQL + " SELECT seed, strategy, is_skip, chain_of_thought FROM done")
def src5(spark, sf_dir):
    path = scratch_path(spark, "sft")
    rows = gen.training_rows(seeds(spark, sf_dir))
    writers.write_by_task(rows.select("seed", "strategy", "is_skip", "chain_of_thought", "answer", "ground_truth"), path, "strategy")
    return readers.read_training_rows(spark, path).select("seed", "strategy", "is_skip", "chain_of_thought")


@query("dia7_generated", "WITH " + _SEEDS_SQL + " SELECT count(*) AS n_rows, 0::BIGINT AS n_failures FROM seeds")
def dia7_generated(spark, sf_dir):
    """Every generated row must earn all three rewards in full."""
    scored = dg.add_rewards(dg.with_response(gen.training_rows(seeds(spark, sf_dir))), ["outcome", "process", "tool_use"])
    lowest = F.least("reward_outcome", "reward_process", "reward_tool_use")
    return scored.agg(F.count("*").alias("n_rows"), F.count_if(lowest < 1.0).alias("n_failures"))


# ---------------------------------------------------------------- paths

_DIR = choose("o_custkey % 5", ["sonnet3.5", "gpt", "sonnet-3.5", "alpha", "beta"])
_SET = choose("o_orderkey % 7", [f"set{i}" for i in range(7)])
_FILE = ("CASE o_orderkey % 5 WHEN 0 THEN 'pixels_' || " + text("o_custkey") + " || '_rotation_diagonal_diameter_0.5_distance_' || "
         "CASE WHEN o_custkey % 3 = 0 THEN '0.0' WHEN o_custkey % 3 = 1 THEN '-0.15' ELSE '0.25' END || '.png' "
         "WHEN 1 THEN 'nested_squares_depth_' || " + text("2 + o_custkey % 4") + " || '_image_' || " + text("o_orderkey") + " || '_thickness_2.png' "
         "WHEN 2 THEN 'grid_' || " + text("3 + o_custkey % 5") + " || 'x' || " + text("3 + o_orderkey % 5") + " || '_500_10.png' "
         "WHEN 3 THEN 'numCircles_' || " + text("5 + o_custkey % 4") + " || '_x.png' ELSE 'notes.txt' END")
_PATH = f"'file:/data/' || {_SET} || '/' || {_DIR} || '/' || CASE WHEN o_custkey % 11 = 0 THEN 'other' WHEN o_custkey % 2 = 0 THEN 'correct' ELSE 'incorrect' END || '/' || {text('o_orderkey')} || '_' || {_FILE}"
_PATHS_SQL = f"""paths AS (SELECT {_PATH} AS path FROM orders), named AS (SELECT path, list_last(string_split(path, '/')) AS f FROM paths),
  labelled AS (SELECT path AS image_path, substr({hash_sql('path', 'path')}, 1, 8) AS sample_id, CASE WHEN contains(f, 'pixels_') THEN 'touching_circle' WHEN contains(f, 'nested_') THEN 'nested_squares'
      WHEN contains(f, 'grid_') THEN 'counting_grid_paths' ELSE 'counting_circles' END AS task_name,
    CASE WHEN contains(f, 'pixels_') THEN CASE WHEN CAST(regexp_extract(f, 'distance_(-?[\\d.]+)\\.png', 1) AS DOUBLE) = 0 THEN 'Yes' ELSE 'No' END WHEN contains(f, 'nested_') THEN regexp_extract(f, 'depth_(\\d+)', 1)
      WHEN contains(f, 'grid_') THEN regexp_extract(f, 'grid_(\\d+)x', 1) || ',' || regexp_extract(f, 'grid_\\d+x(\\d+)', 1) ELSE regexp_extract(f, 'numCircles_(\\d+)', 1) END AS ground_truth FROM named WHERE NOT contains(f, 'notes'))"""


def image_paths(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").selectExpr(f"{_PATH} AS path")


@query("src7", f"WITH {_PATHS_SQL} SELECT sample_id, image_path, task_name, ground_truth, 'disk' AS source FROM labelled")
def src7(spark, sf_dir):
    rows = ph.label_paths(image_paths(spark, sf_dir), source="disk")
    return rows.select("sample_id", "image_path", "task_name", "ground_truth", "source")


@query("src7_sample", f"WITH {_PATHS_SQL} SELECT image_path, task_name, ground_truth FROM labelled QUALIFY row_number() OVER (PARTITION BY task_name, ground_truth ORDER BY {hash_sql(42, 'image_path')}, image_path) <= 20")
def src7_sample(spark, sf_dir):
    return ph.sample_paths(image_paths(spark, sf_dir)).select("image_path", "task_name", "ground_truth")


@query("src8", f"""WITH {_PATHS_SQL}, p AS (SELECT path, string_split(path, '/')[-4] AS image_set, string_split(path, '/')[-3] AS directory, string_split(path, '/')[-2] AS verdict FROM paths),
   ok AS (SELECT *, coalesce(list_position(['sonnet-3.5', 'Sonnet-3.5', 'sonnet3.5'], directory), 9) AS rank FROM p WHERE verdict IN ('correct', 'incorrect'))
   SELECT image_set, directory, verdict, path FROM ok QUALIFY dense_rank() OVER (PARTITION BY image_set ORDER BY rank, directory) = 1""")
def src8(spark, sf_dir):
    return ph.preferred_directories(image_paths(spark, sf_dir)).select("image_set", "directory", "verdict", "path")
