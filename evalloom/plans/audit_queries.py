"""Queries that recompute answer keys and check manifests, sets, graphs and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalloom.operators import audit, geometry as geo, graph, sets
from evalloom.plans import fixtures as fx
from evalloom.plans.catalog import query
from evalloom.plans.fixtures import choose, derive, derive_sql, text
from evalloom.sources import readers
from evalloom.storage import scratch_path
from evalloom.streaming.incremental import score_stream

# ---------------------------------------------------------------- answer keys from params
# One manifest row per order; the payload is made from the keys and the stored truth is
# wrong on every ninth row.

_A, _B = "o_orderkey", "o_custkey"


def letter(expr: str) -> str:
    return f"chr(CAST(65 + {expr} AS INT))"


def pair(a: str, b: str) -> str:
    return f"'[\"' || {letter(a)} || '\", \"' || {letter(b)} || '\"]'"


def joined(parts: list[str]) -> str:
    return " || ', ' || ".join(parts)


# five edges from lower to higher letters
_EDGES = [("0", "1 + o_orderkey % 3"), ("1", "2 + o_custkey % 3"), ("2", "3 + o_orderkey % 4"), ("3", "4 + o_custkey % 3"), ("o_orderkey % 3", "7")]
_ITEMS = ["Apple", "Bell", "Cup", "Drum", "Egg", "Fan"]
_REGIONS = ["Alpha", "Beta", "Gamma", "Alpha ∩ Beta", "Beta ∩ Gamma", "Alpha ∩ Beta ∩ Gamma", "Alpha ∩ Gamma"]


def region(i: int) -> str:
    return choose(f"(o_orderkey * {i + 1} + o_custkey) % 7", _REGIONS)


def series(i: int) -> list[str]:
    return [text(f"(o_orderkey * {p + 1 + i} + o_custkey * {i + 2}) % 5") for p in range(8)]


_AUDIT = {
    "arrow_following": (
        "'{\"start_box\": \"' || " + letter("o_custkey % 5") + " || '\", \"edges\": [' || " + joined([pair(a, b) for a, b in _EDGES]) + " || ']}'",
        "'Where does it lead?'",
    ),
    "venn_diagram": (
        "'{\"question_type\": \"' || " + choose("o_orderkey % 3", ["intersection", "exclusive", "union_minus"]) + " || '\", \"item_regions\": {' || "
        + joined([f"'\"{item}\": \"' || {region(i)} || '\"'" for i, item in enumerate(_ITEMS)]) + " || '}}'",
        choose("o_orderkey % 3", ["Which items are in BOTH Alpha AND Gamma?", "Which items are ONLY in Beta and not in any other set?", "Which items are in Alpha but NOT in Beta?"]),
    ),
    "line_chart_crossing": (
        "'{\"series_a\": [' || " + joined(series(0)) + " || '], \"series_b\": [' || " + joined(series(1)) + " || ']}'", "'How often do they cross?'",
    ),
    "counting_grid": (
        "'{\"question_type\": \"' || " + choose("o_orderkey % 3", ["grid_size", "total_cells", "merged_count"]) + " || '\", \"rows\": ' || "
        + text("3 + o_custkey % 9") + " || ', \"cols\": ' || " + text("3 + o_orderkey % 9") + " || ', \"merges\": [' || CASE WHEN o_custkey % 2 = 0 THEN '' ELSE '[0, 0, 1, 2], [1, 0, 2, ' || "
        + text("1 + o_orderkey % 2") + " || ']' END || ']}'", "'Count'",
    ),
    "table_cell_read": (
        "'{\"target_row\": ' || " + text("1 + o_orderkey % 2") + " || ', \"target_col\": ' || " + text("1 + o_custkey % 3") + " || ', \"table\": [[' || "
        + joined([text(f"o_orderkey + {i}") for i in range(3)]) + " || '], [' || " + joined([text(f"o_custkey + {i}") for i in range(3)]) + " || ']]}'", "'Read'",
    ),
    "merged_cell_read": (
        "'{\"merges\": [{\"r\": 0, \"c\": 1, \"sr\": 1, \"sc\": 2, \"label\": \"' || " + letter("o_custkey % 26") + " || '\"}, {\"r\": 1, \"c\": 0, \"sr\": 2, \"sc\": 1, \"label\": \"' || "
        + letter("o_orderkey % 26") + " || '\"}]}'",
        choose("o_orderkey % 2", ["What text is in the cell that spans columns 2-3 in row 1?", "What text is in the cell that spans rows 2-3 in column 1?"]),
    ),
    "form_checkboxes": ("'{\"checked_letters\": [\"' || " + letter("o_orderkey % 26") + " || '\", \"' || " + letter("o_custkey % 26") + " || '\"]}'", "'Which?'"),
    "strikethrough": ("'{\"struck_words\": [\"pear\", \"' || " + letter("o_orderkey % 26") + " || 'x\", \"' || " + letter("32 + o_custkey % 26") + " || 'y\"]}'", "'Which?'"),
    "colored_paths_text": (
        "'{\"path_details\": [' || " + joined([
            f"'{{\"color\": \"c{i}\", \"from\": \"' || {letter(f'(o_orderkey + {i}) % 2')} || '\", \"to\": \"' || {letter(f'2 + (o_custkey * {i}) % 2')} || '\"}}'" for i in range(1, 5)
        ]) + " || ']}'", "'How many direct paths connect A to C? Answer'",
    ),
    "touching_circles": ("'{\"distance\": ' || " + choose("o_custkey % 3", ["0", "-0.15", "0.2"]) + " || '}'", "'Touching?'"),
    "edge_crossing": (
        "'{\"query\": ' || " + pair("o_custkey % 4", "3 + o_orderkey % 3") + " || ', \"edges\": [' || " + joined([pair(b, a) for a, b in _EDGES]) + " || ']}'", "'Linked?'",
    ),
}


def audit_rows(spark, sf_dir, task):
    params, prompt = _AUDIT[task]
    return fx.table(spark, sf_dir, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS sample_id", f"'{task}' AS task_name", f"{params} AS params", f"{prompt} AS prompt",
        f"{_TRUTH} AS ground_truth",
    )


#: The stored truth, from the order's own columns: right for some rows of a task and wrong for others.
_TRUTH = f"""CASE o_orderkey % 4 WHEN 0 THEN {text('o_custkey % 5')} WHEN 1 THEN 'Yes'
   WHEN 2 THEN {text('3 + o_custkey % 9')} || ',' || {text('3 + o_orderkey % 9')} ELSE {letter('o_custkey % 3')} END"""


def audited(task):
    """Recomputed keys against the stored truth."""

    def run(spark, sf_dir):
        return audit.audit_manifest(audit_rows(spark, sf_dir, task)).select("sample_id", "expected", "matches")

    return run


def audit_sql(task: str, expected: str, extra: str = "") -> str:
    params, prompt = _AUDIT[task]
    return f"""WITH RECURSIVE m AS (SELECT *, CAST(o_orderkey AS VARCHAR) AS sample_id, {params} AS params, {prompt} AS prompt FROM orders){extra},
      e AS (SELECT sample_id, {expected} AS expected, {_TRUTH} AS truth FROM m) SELECT sample_id, expected, expected = truth AS matches FROM e"""


_EDGE_ROWS = " UNION ALL ".join(f"SELECT o_orderkey, {a} AS s, {b} AS d FROM orders" for a, b in _EDGES)
_WALK = f""", edges AS (SELECT o_orderkey, s::BIGINT AS s, d::BIGINT AS d FROM ({_EDGE_ROWS})),
   walk AS (SELECT o_orderkey, o_custkey % 5 AS node FROM orders UNION SELECT w.o_orderkey, e.d FROM walk w JOIN edges e ON e.o_orderkey = w.o_orderkey AND e.s = w.node),
   ends AS (SELECT o_orderkey, string_agg(chr(CAST(65 + node AS INT)), ',' ORDER BY node) AS t FROM walk w WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.o_orderkey = w.o_orderkey AND e.s = w.node) GROUP BY o_orderkey)"""
query("key1", audit_sql("arrow_following", "(SELECT t FROM ends WHERE ends.o_orderkey = m.o_orderkey)", _WALK))(audited("arrow_following"))

_IN = "list_contains(string_split(v, ' ∩ '), '{0}')"
_ITEM_LIST = "[" + ", ".join(f"{{'k': '{item}', 'v': {region(i)}}}" for i, item in enumerate(_ITEMS)) + "]"


def _items(condition: str) -> str:
    return f"array_to_string([s.k for s in {_ITEM_LIST} if {condition.replace(', v,', ', s.v,').replace('(v,', '(s.v,').replace('v =', 's.v =')}], ', ')"


_VENN = f"""coalesce(nullif(CASE o_orderkey % 3 WHEN 0 THEN {_items(_IN.format('Alpha') + ' AND ' + _IN.format('Gamma'))}
   WHEN 1 THEN {_items("v = 'Beta'")} ELSE {_items(_IN.format('Alpha') + ' AND NOT ' + _IN.format('Beta'))} END, ''), 'None')"""
query("key3", audit_sql("venn_diagram", _VENN))(audited("venn_diagram"))

_DIFFS = "[" + ", ".join(f"sign(({a})::INT - ({b})::INT)" for a, b in zip(series(0), series(1))) + "]"
_NONZERO = f"[d for d in {_DIFFS} if d <> 0]"
query("key4", audit_sql("line_chart_crossing", f"(len([i for i in range(2, len({_NONZERO}) + 1) if ({_NONZERO})[i] <> ({_NONZERO})[i - 1]]))::VARCHAR"))(audited("line_chart_crossing"))
query("key5", audit_sql("counting_grid", """CASE o_orderkey % 3 WHEN 0 THEN (3 + o_custkey % 9)::VARCHAR || ',' || (3 + o_orderkey % 9)::VARCHAR
   WHEN 1 THEN ((3 + o_custkey % 9) * (3 + o_orderkey % 9) - CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE 1 + 2 * (1 + o_orderkey % 2) - 1 END)::VARCHAR
   ELSE CASE WHEN o_custkey % 2 = 0 THEN '0' ELSE '2' END END"""))(audited("counting_grid"))
query("key6", audit_sql("table_cell_read", "(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE o_custkey END + o_custkey % 3)::VARCHAR"))(audited("table_cell_read"))
query("key6_merged", audit_sql("merged_cell_read", f"CASE WHEN o_orderkey % 2 = 0 THEN {letter('o_custkey % 26')} ELSE {letter('o_orderkey % 26')} END"))(audited("merged_cell_read"))
query("key7", audit_sql("form_checkboxes", f"array_to_string(list_sort([{letter('o_orderkey % 26')}, {letter('o_custkey % 26')}]), ',')"))(audited("form_checkboxes"))
query("key7_words", audit_sql("strikethrough", f"array_to_string([s.v for s in list_sort([{{'k': lower(w), 'v': w}} for w in ['pear', {letter('o_orderkey % 26')} || 'x', {letter('32 + o_custkey % 26')} || 'y']])], ',')"))(audited("strikethrough"))
query("key8", audit_sql("colored_paths_text", "(" + " + ".join(f"((o_orderkey + {i}) % 2 = 0 AND (o_custkey * {i}) % 2 = 0)::INT" for i in range(1, 5)) + ")::VARCHAR"))(audited("colored_paths_text"))
query("key10", audit_sql("touching_circles", "CASE WHEN o_custkey % 3 = 2 THEN 'No' ELSE 'Yes' END"))(audited("touching_circles"))
_Q = ("(o_custkey % 4)", "(3 + o_orderkey % 3)")
_LINKED = " OR ".join(f"({_Q[0]} = {a} AND {_Q[1]} = {b}) OR ({_Q[0]} = {b} AND {_Q[1]} = {a})" for a, b in _EDGES)
query("key12", audit_sql("edge_crossing", f"CASE WHEN {_LINKED} THEN 'Yes' ELSE 'No' END"))(audited("edge_crossing"))


@query("key11", """WITH s AS (SELECT p_partkey, [p_size, p_partkey % 37 + 1, p_partkey % 11 + 2]::BIGINT[] AS raw FROM part),
   p AS (SELECT p_partkey, [round_even(v::DOUBLE / list_sum(raw) * 100, 0)::BIGINT for v in raw] AS pct FROM s)
   SELECT p_partkey, (pct[1] + 100 - list_sum(pct))::BIGINT AS a, pct[2] AS b, pct[3] AS c, true AS adds_up FROM p""")
def key11(spark, sf_dir):
    raw = F.array(F.col("p_size").cast("bigint"), F.col("p_partkey") % 37 + 1, F.col("p_partkey") % 11 + 2)
    made = fx.table(spark, sf_dir, "part").select("p_partkey", audit.whole_percentages(raw).alias("pct"))
    made = made.withColumn("params", F.to_json(F.struct(F.col("pct").alias("percentages"))))
    return made.select(
        "p_partkey", *[F.col("pct")[i].alias(n) for i, n in enumerate("abc")], audit.percentages_add_up().alias("adds_up")
    )


_ROWCHECK: list = [{
    "sample_id": text("event_id - event_id % 7 % 2 * 3"), "prompt": "CASE WHEN event_id % 10 <> 0 THEN event_type END",
    "parser": choose("event_id % 4", ["integer", "mc4", "guess", "letter"]), "scorer": choose("event_id % 5", ["exact_match", "set_match", "row_col", "hunch", "set_member"]),
    "ground_truth": text("user_id % 4"), "task_name": "event_type",
}]
_ROWCHECK_COLUMNS = ["sample_id", "task_name", "prompt", "parser", "scorer", "ground_truth"]
_ROWCHECK_SQL = f"WITH m AS ({derive_sql('events', _ROWCHECK, _ROWCHECK_COLUMNS)})"


def manifest_rows(spark, sf_dir):
    return derive(fx.table(spark, sf_dir, "events"), _ROWCHECK, _ROWCHECK_COLUMNS)


@query("key13", _ROWCHECK_SQL + """ SELECT sample_id, task_name, concat_ws('; ', CASE WHEN prompt IS NULL THEN 'no prompt' END, CASE WHEN parser = 'guess' THEN 'unknown parser' END,
   CASE WHEN scorer = 'hunch' THEN 'unknown scorer' END) AS problems FROM m WHERE prompt IS NULL OR parser = 'guess' OR scorer = 'hunch'""")
def key13(spark, sf_dir):
    return audit.row_problems(manifest_rows(spark, sf_dir)).withColumn("problems", F.array_join("problems", "; "))


@query("key13_balance", _ROWCHECK_SQL + " SELECT task_name, ground_truth, count(*) AS n FROM m GROUP BY ALL")
def key13_balance(spark, sf_dir):
    return audit.class_balance(manifest_rows(spark, sf_dir))


@query("key13_ids", _ROWCHECK_SQL + " SELECT sample_id, count(*) AS n FROM m GROUP BY sample_id HAVING count(*) > 1")
def key13_ids(spark, sf_dir):
    return audit.repeated_ids(manifest_rows(spark, sf_dir))


# ---------------------------------------------------------------- sets

_MEMBERS = "mem AS (SELECT DISTINCT o_orderpriority AS s, o_custkey AS item FROM orders)"


def members(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("set"), F.col("o_custkey").alias("item"))


@query("set1", f"WITH {_MEMBERS} SELECT item FROM mem WHERE s = '1-URGENT' INTERSECT SELECT item FROM mem WHERE s = '2-HIGH'")
def set1(spark, sf_dir):
    return sets.in_all(members(spark, sf_dir), ["1-URGENT", "2-HIGH"])


@query("set2", f"WITH {_MEMBERS} SELECT item, max(s) AS only_set FROM mem GROUP BY item HAVING count(*) = 1")
def set2(spark, sf_dir):
    return sets.in_one_only(members(spark, sf_dir))


@query("set3", f"WITH {_MEMBERS} SELECT item FROM mem WHERE s = '1-URGENT' EXCEPT SELECT item FROM mem WHERE s = '2-HIGH'")
def set3(spark, sf_dir):
    return sets.in_first_only(members(spark, sf_dir), "1-URGENT", ["2-HIGH"])


# ---------------------------------------------------------------- graphs

def part_edges(spark, sf_dir):
    """k to 2k + 1 and 3k + 2, while those are parts."""
    keys = fx.table(spark, sf_dir, "part").select("p_partkey")
    made = keys.select(
        F.col("p_partkey").alias("src"), F.explode(F.array(F.col("p_partkey") * 2 + 1, F.col("p_partkey") * 3 + 2)).alias("dst")
    )
    return made.join(keys.select(F.col("p_partkey").alias("dst")), "dst", "left_semi").select("src", "dst")


_PART_EDGES = """edges AS (SELECT a.p_partkey AS src, b.p_partkey AS dst FROM part a JOIN part b ON b.p_partkey = 2 * a.p_partkey + 1
   UNION ALL SELECT a.p_partkey, b.p_partkey FROM part a JOIN part b ON b.p_partkey = 3 * a.p_partkey + 2)"""


_GRAPHS = """nodes AS (SELECT p_partkey % 25 AS graph, p_partkey // 25 AS node FROM part),
   edges AS (SELECT a.graph, a.node AS src, b.node AS dst FROM nodes a JOIN nodes b ON a.graph = b.graph AND (b.node = 2 * a.node + 1 OR b.node = 3 * a.node + 2))"""


@query("key1_graph", f"""WITH RECURSIVE {_GRAPHS}, walk AS (SELECT graph, min(node) AS start, min(node) AS node FROM nodes GROUP BY graph
     UNION SELECT w.graph, w.start, e.dst FROM walk w JOIN edges e ON e.graph = w.graph AND e.src = w.node)
   SELECT graph, start, node AS terminal FROM walk w WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.graph = w.graph AND e.src = w.node)""")
def key1_graph(spark, sf_dir):
    """Twenty-five graphs over the parts, each walked from its first node."""
    nodes = fx.table(spark, sf_dir, "part").selectExpr("p_partkey % 25 AS graph", "p_partkey div 25 AS node")
    made = nodes.select("graph", F.col("node").alias("src"), F.explode(F.array(F.col("node") * 2 + 1, F.col("node") * 3 + 2)).alias("dst"))
    edges = made.join(nodes.withColumnRenamed("node", "dst"), ["graph", "dst"], "left_semi")
    starts = nodes.groupBy("graph").agg(F.min("node").alias("start"))
    return graph.reachable_terminals(edges, starts, ("graph",))


_TREE = """nodes AS (SELECT o_custkey % 40 AS tree, o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) - 1 AS i FROM orders)"""


@query("key2", """WITH RECURSIVE nodes AS (SELECT o_orderkey % 40 AS tree, o_orderkey // 40 AS node, CASE WHEN o_orderkey // 40 = 0 THEN NULL ELSE (o_orderkey // 40 - 1) // (1 + o_orderkey % 40 % 3) END AS parent FROM orders),
   walk AS (SELECT tree, node, 1 AS level FROM nodes WHERE parent IS NULL UNION ALL SELECT n.tree, n.node, w.level + 1 FROM walk w JOIN nodes n ON n.tree = w.tree AND n.parent = w.node)
   SELECT tree, max(level)::BIGINT AS depth FROM walk GROUP BY tree""")
def key2(spark, sf_dir):
    """Forty trees over the order keys, with one, two or three children per node."""
    nodes = fx.table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey % 40 AS tree", "o_orderkey div 40 AS node",
        "CASE WHEN o_orderkey div 40 = 0 THEN NULL ELSE (o_orderkey div 40 - 1) div (1 + o_orderkey % 40 % 3) END AS parent",
    )
    return graph.tree_depth(nodes)


@query("jn12", f"WITH {_PART_EDGES}, q AS (SELECT p_partkey AS a, p_partkey * 2 + p_size % 3 AS b FROM part UNION SELECT p_partkey, p_partkey // 2 FROM part)"
       ", both_ways AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges) SELECT q.a, q.b FROM q JOIN both_ways USING (a, b)")
def jn12(spark, sf_dir):
    parts = fx.table(spark, sf_dir, "part")
    spread = parts.selectExpr("p_partkey AS a", "p_partkey * 2 + p_size % 3 AS b")
    half = parts.selectExpr("p_partkey AS a", "p_partkey div 2 AS b")
    return geo.adjacent(spread.union(half).distinct(), part_edges(spark, sf_dir), []).select("a", "b")


# ---------------------------------------------------------------- geometry and series

def segments(spark, sf_dir):
    """Each vector as a figure of segments, four components to a segment, all of them used."""
    vectors = fx.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("figure"), F.col("embedding").cast("array<double>").alias("v"))
    edges = vectors.select("figure", "v", F.explode(F.sequence(F.lit(0), F.floor(F.size("v") / 4) - 1)).alias("edge"))
    return edges.select(
        "figure", F.col("edge").cast("bigint").alias("edge"),
        *[F.get("v", F.col("edge").cast("int") * 4 + i).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))],
    )


@query("jn11", """WITH s AS (SELECT figure, edge, v[edge * 4 + 1]::DOUBLE AS x1, v[edge * 4 + 2]::DOUBLE AS y1, v[edge * 4 + 3]::DOUBLE AS x2, v[edge * 4 + 4]::DOUBLE AS y2
     FROM (SELECT vec_id AS figure, embedding AS v, unnest(range(len(embedding) // 4)) AS edge FROM embeddings)),
   p AS (SELECT a.figure, a.edge AS edge_a, b.edge AS edge_b, (a.x1 - a.x2) * (b.y1 - b.y2) - (a.y1 - a.y2) * (b.x1 - b.x2) AS den,
     (a.x1 - b.x1) * (b.y1 - b.y2) - (a.y1 - b.y1) * (b.x1 - b.x2) AS tn, -((a.x1 - a.x2) * (a.y1 - b.y1) - (a.y1 - a.y2) * (a.x1 - b.x1)) AS un FROM s a JOIN s b ON a.figure = b.figure AND a.edge < b.edge)
   SELECT figure, edge_a, edge_b FROM p WHERE abs(den) >= 1e-10 AND tn / den > 0.05::DOUBLE AND tn / den < 0.95::DOUBLE AND un / den > 0.05::DOUBLE AND un / den < 0.95::DOUBLE""")
def jn11(spark, sf_dir):
    return geo.crossing_segments(segments(spark, sf_dir), ["figure"]).select("figure", "edge_a", "edge_b")


_CELL_SQL = """cells AS (SELECT o_orderkey AS sheet, unnest([0, 1, 2, 3]) AS row, o_custkey % 5 AS col FROM orders),
   merges AS (SELECT o_orderkey AS sheet, 0 AS r, 1 AS c, 1 AS sr, 3 AS sc, 'top' AS label FROM orders UNION ALL SELECT o_orderkey, 1, o_custkey % 4, 2, 2, 'block' FROM orders)"""


@query("jn14", f"WITH {_CELL_SQL} SELECT sheet, row::BIGINT AS row, col, label FROM cells JOIN merges USING (sheet) WHERE row >= r AND row < r + sr AND col >= c AND col < c + sc")
def jn14(spark, sf_dir):
    orders = fx.table(spark, sf_dir, "orders")
    cells = orders.select(
        F.col("o_orderkey").alias("sheet"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("row"), (F.col("o_custkey") % 5).alias("col")
    )
    boxes = F.array(
        F.struct(*[F.lit(v).cast("bigint").alias(n) for n, v in (("r", 0), ("c", 1), ("sr", 1), ("sc", 3))], F.lit("top").alias("label")),
        F.struct(F.lit(1).cast("bigint").alias("r"), (F.col("o_custkey") % 4).alias("c"), F.lit(2).cast("bigint").alias("sr"), F.lit(2).cast("bigint").alias("sc"), F.lit("block").alias("label")),
    )
    merges = orders.select(F.col("o_orderkey").alias("sheet"), F.inline(boxes))
    return geo.covering_merge(cells, merges, ["sheet"])


_SERIES_SQL = """daily AS (SELECT l_suppkey AS supplier, date_diff('day', DATE '1990-01-01', l_shipdate::DATE) AS day,
   sum(CASE l_returnflag WHEN 'A' THEN l_quantity WHEN 'R' THEN -l_quantity ELSE 0 END) AS diff FROM lineitem GROUP BY ALL)"""


@query("win4", f"""WITH {_SERIES_SQL}, s AS (SELECT supplier, day, sign(diff) AS s FROM daily WHERE diff <> 0), l AS (SELECT *, lag(s) OVER (PARTITION BY supplier ORDER BY day) AS b FROM s)
   SELECT supplier, count(*) FILTER (WHERE b <> s) AS sign_changes FROM l GROUP BY supplier""")
def win4(spark, sf_dir):
    """Daily quantity of flag A less flag R per supplier, cut into stretches of 90 days."""
    signed = F.when(F.col("l_returnflag") == "A", F.col("l_quantity")).when(
        F.col("l_returnflag") == "R", -F.col("l_quantity")
    ).otherwise(0.0)
    daily = fx.table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("supplier"), F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).alias("day")
    ).agg(F.sum(signed).alias("diff"))
    return geo.sign_changes(daily, ["supplier"], "day", "diff", 90)


@query("key9", """WITH m AS (SELECT l_suppkey AS figure, l_returnflag AS series, max(l_quantity * 100 + l_linenumber) AS peak FROM lineitem GROUP BY ALL)
   SELECT figure, series, peak FROM m QUALIFY row_number() OVER (PARTITION BY figure ORDER BY peak DESC, series) = 1""")
def key9(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("figure"), F.col("l_returnflag").alias("series"), (F.col("l_quantity") * 100 + F.col("l_linenumber")).alias("value")
    )
    return geo.peak_series(rows, ["figure"])


@query("win5", """WITH b AS (SELECT p_brand AS brand, p_retailprice * 40 AS y, p_size AS h FROM part), lim AS (SELECT brand, greatest(avg(h) * 0.5, 15.0) AS gap FROM b GROUP BY brand),
   o AS (SELECT brand, y, y - lag(y) OVER (PARTITION BY brand ORDER BY y) > gap AS jump FROM b JOIN lim USING (brand)),
   l AS (SELECT brand, y, 1 + sum(coalesce(jump, false)::INT) OVER (PARTITION BY brand ORDER BY y ROWS UNBOUNDED PRECEDING) AS level FROM o)
   SELECT brand, level::BIGINT AS level, count(*) AS n, min(y) AS low, max(y) AS high FROM l GROUP BY ALL""")
def win5(spark, sf_dir):
    boxes = fx.table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("brand"), (F.col("p_retailprice") * 40).alias("y"), F.col("p_size").alias("height")
    )
    return geo.cluster_levels(boxes, ["brand"])


@query("win6", """SELECT o_custkey AS bar, max(o_custkey % 3000) AS target, sum(CASE WHEN o_orderkey <= o_custkey * 10 THEN o_orderkey % 97 ELSE 0 END)::BIGINT AS height FROM orders GROUP BY o_custkey""")
def win6(spark, sf_dir):
    """Orders stacked on their customer's bar, up to a target order."""
    stacked = fx.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("bar"), F.col("o_orderkey").alias("segment"), (F.col("o_orderkey") % 97).alias("value")
    )
    targets = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bar"), (F.col("o_custkey") * 10).alias("target")).distinct()
    return geo.height_up_to(stacked, targets, ["bar"]).select("bar", (F.col("target") / 10 % 3000).cast("bigint").alias("target"), "height")


# ---------------------------------------------------------------- streaming

@query("str1", f"WITH {fx.RESULTS_SQL} SELECT sample_id, task_name, parsed_answer, correct, score FROM results")
def str1(spark, sf_dir):
    """Three drops of response files, each repeating rows of those before; the stream starts anew for every drop."""
    rows = fx.responses(spark, sf_dir).drop("thinking_text")
    source, sink, marks = (scratch_path(spark, n) for n in ("incoming", "scored", "marks"))
    for first, last in ((0, 1), (1, 2), (0, 3)):
        rows.where((F.col("line_no") % 4).between(first, last)).drop("line_no").write.mode("append").json(source)
        score_stream(spark, source, sink, marks).awaitTermination()
    return spark.read.parquet(sink).select("sample_id", "task_name", "parsed_answer", "correct", "score")
