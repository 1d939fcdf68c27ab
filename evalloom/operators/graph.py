"""Reachability and depth over edge tables too large for one row.

Both run as rounds of equi-joins. Each round is written to the shared folder, so plans
stay short and a lost executor never restarts the walk.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.storage import scratch_path, stored


def _closure(spark: SparkSession, frontier: DataFrame, steps: DataFrame, on: str, to: str, name: str) -> DataFrame:
    """All rows that come of ``frontier`` by replacing ``on`` with the ``to`` of its steps, again and again.

    Only rows not met before are walked on, so shared paths are followed once and cycles end. The rounds
    are directories of one table.
    """
    columns = frontier.columns
    path, schema, number = scratch_path(spark, name), frontier.schema, 0
    shared = [c for c in steps.columns if c != to]
    while True:
        frontier.write.parquet(f"{path}/round={number}")
        frontier = spark.read.schema(schema).parquet(f"{path}/round={number}")
        found = spark.read.schema(schema).parquet(f"{path}/round=*")
        if frontier.isEmpty():
            return found
        moved = frontier.join(steps, shared).drop(on).withColumnRenamed(to, on).select(*columns).distinct()
        frontier, number = moved.join(found, columns, "left_anti"), number + 1


def reachable(edges: DataFrame, starts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Every ``(start, node)`` with a path from start to node, start included.

    With ``keys`` the tables hold many graphs, and paths stay within one. As many rows as there are
    such pairs are stored; where only dead ends are asked for, ``reachable_terminals`` stores less.
    """
    steps = edges.select(*keys, F.col("src").alias("node"), F.col("dst")).distinct()
    frontier = starts.select(*keys, "start", F.col("start").alias("node")).distinct()
    return _closure(edges.sparkSession, frontier, steps, "node", "dst", "reach")


def _followed(steps: DataFrame, keys: list[str]) -> DataFrame:
    """``node, end`` of every node with one way on: the first node on it that has none or several.

    Pointers are doubled, so a way of length d takes about log2(d) rounds. Nodes whose pointer never
    comes out of such nodes run into a cycle without an exit; their end is null.
    """
    single = steps.groupBy(*keys, "node").agg(F.count("*").alias("ways"), F.min("dst").alias("end")).where("ways = 1").drop("ways")
    state = stored(single, "followed")
    for _ in range(state.count().bit_length() + 1):
        onward = state.select(*keys, F.col("node").alias("end"), F.col("end").alias("_next"))
        moving = state.join(onward, [*keys, "end"], "left_semi")
        if moving.isEmpty():
            return state
        far = state.join(onward, [*keys, "end"], "left").select(*keys, "node", F.coalesce("_next", "end").alias("end"))
        state = stored(far, "followed")
    circling = state.select(*keys, F.col("node").alias("end"), F.lit(True).alias("_in"))
    return state.join(circling, [*keys, "end"], "left").select(*keys, "node", F.when(F.col("_in").isNull(), F.col("end")).alias("end"))


def reachable_terminals(edges: DataFrame, starts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Dead ends reachable from each start; a start without out-edges is its own.

    Nodes with one way on have the dead ends of where it leads to, so they are followed to the first node
    with none or several ways (``_followed``), and cycles without an exit go. In the graph that is left,
    the nodes that any start reaches are marked, and dead ends are passed backwards along its edges
    to marked nodes. So (node, dead end) pairs of these nodes are stored, whatever the number of starts.
    """
    spark, names = edges.sparkSession, list(keys)
    steps = stored(edges.select(*names, F.col("src").alias("node"), F.col("dst")).distinct(), "steps")
    ends = _followed(steps, names)

    def led(rows: DataFrame, column: str) -> DataFrame:
        """``column`` followed to its end; rows that lead into a cycle without an exit go."""
        known = ends.select(*names, F.col("node").alias(column), "end", F.lit(True).alias("_one"))
        end = F.when(F.col("_one").isNull(), F.col(column)).otherwise(F.col("end"))
        return rows.join(known, [*names, column], "left").withColumn(column, end).where(F.col(column).isNotNull()).drop("end", "_one")

    ways = steps.join(ends, [*names, "node"], "left_anti")  # nodes with several ways; those with one are followed
    several = stored(led(ways, "dst").where("node <> dst").distinct(), "condensed")
    asked = starts.select(*names, "start").distinct().withColumn("node", F.col("start"))
    asked = stored(led(asked, "node"), "starts")
    marked = _closure(spark, asked.select(*names, "node").distinct(), several, "node", "dst", "marked")
    dead = marked.join(steps, [*names, "node"], "left_anti").withColumn("terminal", F.col("node"))
    back = several.join(marked, [*names, "node"], "left_semi").select(*names, F.col("node").alias("before"), F.col("dst").alias("node"))
    pairs = _closure(spark, dead.select(*names, "node", "terminal"), back, "node", "before", "terminals")
    return asked.join(pairs, [*names, "node"]).select(*names, "start", "terminal")


#: Up to so many trees still being walked are named in filters; of more, all rows go on.
TREES = 1_000


def tree_depth(nodes: DataFrame) -> DataFrame:
    """Number of levels of each tree, from ``(tree, node, parent)`` with null parents at roots.

    Every node keeps a pointer to an ancestor and the distance to it. A round replaces
    the pointer by the ancestor's own, so depth d takes about log2(d) rounds; trees that have come to
    their roots are set aside. Nodes that still move after as many rounds as the number of all nodes
    allows lie on a cycle.

    Both sides of a round are shuffled: pointers compress to a byte a row or less, so that files of any number
    of them look small enough to broadcast.
    """
    first = nodes.select(
        "tree", "node", F.col("parent").alias("up"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("bigint").alias("dist"),
    )
    state, settled, walked = stored(first, "depth"), [], None
    for _ in range(state.count().bit_length() + 1):
        moving = state.where(F.col("up").isNotNull())
        trees = [r["tree"] for r in moving.where(F.col("tree").isNotNull()).select("tree").distinct().limit(TREES + 1).collect()]
        if not trees:  # without a tree no node has a parent
            whole = reduce(DataFrame.unionByName, [*settled, state])
            return whole.groupBy("tree").agg((F.max("dist") + 1).alias("depth"))
        if len(trees) <= TREES and len(trees) != walked:
            walked, going = len(trees), F.coalesce(F.col("tree").isin(trees), F.lit(False))
            settled.append(state.where(~going))
            state = state.where(going)
            moving = state.where(F.col("up").isNotNull())
        above = state.select(
            "tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("dist").alias("more")
        )
        # a parent that is not a node of the tree acts as a root
        moved = moving.join(above.hint("merge"), ["tree", "up"], "left").select(
            "tree", "node", F.col("next").alias("up"),
            (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist"),
        )
        state = stored(state.where(F.col("up").isNull()).unionByName(moved), "depth")
    raise RuntimeError("parent links form a cycle")
