"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is a line of words: its documents in an order drawn by hash, cut into blocks
of equal length. Its target says how many blocks are drawn: whole passes over the line, and a
part of one more. A binary tree over the output shards splits these exact quotas: at each
node the left half's slots receive a multivariate-hypergeometric draw of what the node
holds, so that each shard ends with exact quotas that look like a fair deal of the
whole. A shard then takes its own stretch of each source's permuted draws, which no other shard
has, and shuffles its documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from evalloom.llm import common
from evalloom.storage import stored

#: Words in a block at least, documents in a chunk of a line, draws in a shard.
BLOCK, CHUNK, DRAWS = 2_048, 4_096, 128
#: Blocks of all sources stay below this number, which the random generator can split; beyond it blocks grow.
MOST_BLOCKS = 1 << 29
#: Sources are dealt to so many groups; the tree splits groups first, then the sources within.
GROUPS = 64
#: Leaves that one task of the tree works out.
LEAVES = 1_024
SEED = 11
_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563)
_KEYS = 1 << 40


@dataclass
class Mix:
    kept: DataFrame  # row, size and the kept columns: one row per document
    documents: DataFrame  # row, doc_id, size, sid: one row per document
    sources: DataFrame  # sid, source, n_docs, source_size, weight, target, and what is drawn
    rows: DataFrame  # row, shard, position, epoch, first_word, words: the mixture


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: list[str]) -> DataFrame:
    """``row, doc_id, source, size`` and the kept columns; size is the number of words, 0 for a null text.

    ``_print`` tells rows of one id apart: a hash of the text, and of the row's number where the id is null.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("_id"),
        common.column_or_null(docs, source_col, "string").cast("string").alias("_source"),
        F.regexp_count(text, F.lit(common.WORD)).cast("long").alias("size"),
        F.xxhash64(text, F.when(F.col(f"`{id_col}`").cast("long").isNull(), F.monotonically_increasing_id())).alias("_print"),
        *[F.col(f"`{c}`").alias(f"_kept_{c}") for c in keep],
    )


def _in_order(df: DataFrame, keys: list[Column], sums: list[str], name: str) -> DataFrame:
    """``df`` with ``_rank``, from 0 in the order of ``keys``, and ``_before_x``: the sum of ``x`` over the rows before.

    Rows are sorted by ranges, numbered and summed up inside each; only one row a range meets in one task.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = stored(ranged, name).withColumn("_range", F.shiftright("_at", 33))
    totals = ranged.groupBy(F.col("_range").alias("r")).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in sums])
    earlier = Window.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda column, over: F.coalesce(F.sum(column).over(over), F.lit(0))
    totals = totals.select("r", before("_n", earlier).alias("_ranks"), *[before(f"_sum_{c}", earlier).alias(f"_upto_{c}") for c in sums])
    inside = Window.partitionBy("_range").orderBy("_at")
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(totals, F.col("_range") == F.col("r")).select(
        *df.columns, (F.col("_ranks") + F.row_number().over(inside) - 1).alias("_rank"),
        *[(F.col(f"_upto_{c}") + before(c, ahead)).alias(f"_before_{c}") for c in sums],
    )


def targets(sized: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """``sid, source, n_docs, source_size, weight, target`` per source.

    Sources take the weights in turn, by code point, null last. Their targets share ``share`` of
    all words by weight, and none exceeds ``most`` times its source: sources are passed in order
    of the level at which they reach that bound, and the first that does not sets the level of the rest.
    """
    sums = sized.groupBy(F.col("_source").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    known = stored(
        _in_order(sums, [F.col("source").asc_nulls_last()], [], "mix-names").withColumnRenamed("_rank", "sid").withColumn("weight", weight),
        "mix-sources",
    )
    total, all_weights = known.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    full = F.col("source_size") * F.lit(float(most))
    levels = _in_order(
        known.withColumn("bound", full / F.col("weight")), [F.col("bound").asc(), F.col("sid").asc()], ["source_size", "weight"], "mix-levels"
    )
    level = (F.lit(float(share * total)) - F.col("_before_source_size") * F.lit(float(most))) / (F.lit(all_weights) - F.col("_before_weight"))
    first = (
        levels.withColumn("level", level).where("bound > level")
        .orderBy("bound", "sid").select("level", "bound", "sid").first()
    )
    target = full
    if first is not None:
        after = (full / F.col("weight") > first["bound"]) | ((full / F.col("weight") == first["bound"]) & (F.col("sid") >= first["sid"]))
        target = F.when(after, F.col("weight") * F.lit(first["level"])).otherwise(full)
    return known.withColumn("target", target)


def _line(step: int, sid: int, epoch: int, blocks: int) -> tuple[int, int]:
    """Factor and shift of the permutation j -> (factor * j + shift) mod blocks; primes above ``blocks`` divide nothing of it."""
    return _PRIMES[(sid + epoch + step) % len(_PRIMES)] % blocks, (sid * 7919 + epoch * 104729 + step) % blocks


def _drawn(block: int):
    """Adds what is drawn of each source: ``blocks, draws, last_words`` (words the last draw takes)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = []
            for sid, size, target in zip(frame["sid"], frame["source_size"], frame["target"]):
                size, wanted = int(size), int(round(target))
                if not size or not wanted:
                    made.append((0, 0, 0))
                    continue
                blocks = -(-size // block)
                tail = size - (blocks - 1) * block
                epochs, rest = divmod(wanted, size)
                if not rest:
                    made.append((blocks, epochs * blocks, block))
                    continue
                factor, shift = _line(SEED, int(sid), epochs, blocks)
                place = (pow(factor, -1, blocks) * (blocks - 1 - shift)) % blocks if blocks > 1 else 0
                draws = -(-rest // block)
                if place < draws:  # the short block at the line's end is among them
                    draws = 1 + max(0, -(-(rest - tail) // block))
                before = (draws - 1) * block - (block - tail if place < draws - 1 else 0)
                made.append((blocks, epochs * blocks + draws, rest - before))
            blocks, draws, last = zip(*made) if made else ((), (), ())
            yield frame.assign(blocks=np.array(blocks, np.int64), draws=np.array(draws, np.int64), last_words=np.array(last, np.int64))

    return run


def split(counts: np.ndarray, slots: int, *seed: int) -> np.ndarray:
    """Of ``counts`` of each kind, how many fall among ``slots`` of all places; the same for equal seeds."""
    if not len(counts):
        return counts
    return np.random.default_rng([SEED, *seed]).multivariate_hypergeometric(counts, int(slots), method="marginals")


def leaf_quotas(
    groups: np.ndarray, group: int, members: np.ndarray, shards: int, lo: int, hi: int
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For shards lo..hi: quotas of the members of one group, and how many of each stand in earlier shards.

    The walk goes from the root to these leaves only; every node's draw depends on the node alone, so any
    task finds the same tree.
    """
    total = int(groups.sum())
    first = lambda leaf: leaf * total // shards
    waiting = [(0, shards, groups, members, np.zeros_like(members))]
    while waiting:
        a, b, held, own, before = waiting.pop()
        if b <= lo or a >= hi or not own.sum():
            continue
        if b - a == 1:
            yield a, own, before
            continue
        middle = (a + b) // 2
        left = split(held, first(middle) - first(a), a, b)
        own_left = split(own, left[group], a, b, group + 1)
        waiting.append((middle, b, held - left, own - own_left, before + own_left))
        waiting.append((a, middle, left, own_left, before))


QUOTAS = "sid long, shard long, start long, quota long"


def quotas(sources: DataFrame, shards: int) -> DataFrame:
    """``sid, shard, start, quota``: each shard's exact stretch of every source's draws.

    Only the sums of ``GROUPS`` groups reach the driver; the sources of a group, and leaves by the
    thousand, are worked out in tasks.
    """
    dealt = sources.select("sid", "draws", F.pmod(F.xxhash64("sid"), F.lit(GROUPS)).cast("int").alias("g")).where("draws > 0")
    groups = np.zeros(GROUPS, np.int64)
    for r in dealt.groupBy("g").agg(F.sum("draws").alias("n")).collect():
        groups[r["g"]] = r["n"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("sid")
        at, members, sid = int(frame["part"].iloc[0]), frame["draws"].to_numpy(np.int64), frame["sid"].to_numpy()
        parts = []
        for leaf, own, before in leaf_quotas(groups, int(frame["g"].iloc[0]), members, shards, at * LEAVES, (at + 1) * LEAVES):
            some = own > 0
            parts.append(pd.DataFrame({"sid": sid[some], "shard": leaf, "start": before[some], "quota": own[some]}))
        return pd.concat(parts) if parts else pd.DataFrame({n: np.zeros(0, np.int64) for n in ("sid", "shard", "start", "quota")})

    parts = -(-shards // LEAVES)
    return (
        dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        .groupBy("g", "part").applyInPandas(run, QUOTAS)
    )


def _permuted(t: Column) -> tuple[Column, Column]:
    """Epoch and block of a source's draw number t."""
    epoch = F.floor(t / F.col("blocks")).cast("long")
    j = t - epoch * F.col("blocks")
    primes = F.array(*[F.lit(p) for p in _PRIMES])
    factor = F.element_at(primes, ((F.col("sid") + epoch + SEED) % len(_PRIMES) + 1).cast("int")).cast("long") % F.col("blocks")
    shift = (F.col("sid") * 7919 + epoch * 104729 + SEED) % F.col("blocks")
    return epoch, (factor * j + shift) % F.col("blocks")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None,
) -> Mix:
    """A mixture of ``docs`` with the sources' shares set by weights, repeated up to ``most`` times.

    Taken words of a source are its target, rounded to a word: the last draw of a source ends within
    its block. A document that reaches over blocks stays whole where these are all drawn in the
    same pass, so cuts are found in the last pass alone. A null source is a source,
    documents without words are in no shard, repeated rows are documents each, and an empty
    table gives an empty mixture. Everything random is a hash of ids or seeded by the node
    of the tree, so reruns agree. Lines are placed by chunks of bounded size, so a source
    that holds a third of all rows is worked on by many tasks, also where ids are null or equal (rows of one id and text lie side by side).
    """
    sized = stored(sizes(docs, id_col, text_col, source_col, keep or []), "mix-sizes")
    known = targets(sized, list(weights), share, most)
    wanted = known.agg(F.sum("target")).first()[0] or 0.0
    block = max(BLOCK, math.ceil(wanted / MOST_BLOCKS))
    schema = StructType([*known.schema.fields, *[StructField(n, LongType()) for n in ("blocks", "draws", "last_words")]])
    sources = stored(known.mapInPandas(_drawn(block), schema), "mix-draws")

    documents = stored(
        sized.select("row", "_id", "_source", "size", "_print").join(
            sources.select("sid", "n_docs", F.col("source").alias("_s")), F.col("_source").eqNullSafe(F.col("_s"))
        ).drop("_s")
        .withColumn("_key", F.pmod(F.xxhash64("_id", "_print", F.lit(SEED)), F.lit(_KEYS)))
        .withColumn("_chunk", F.floor(F.col("_key") / F.lit(float(_KEYS)) * F.ceil(F.col("n_docs") / CHUNK)))
        .drop("n_docs", "_print"),
        "mix-documents",
    )
    chunks = documents.groupBy("sid", "_chunk").agg(F.sum("size").alias("words"))
    earlier = F.sum("words").over(Window.partitionBy("sid").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0))
    chunks = stored(chunks.select(F.col("sid").alias("s"), F.col("_chunk").alias("c"), (earlier - F.col("words")).alias("before")), "mix-chunks")
    inside = Window.partitionBy("sid", "_chunk").orderBy("_key", "_id", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = documents.select("row", "_id", "sid", "size", "_key", "_chunk", (F.sum("size").over(inside) - F.col("size")).alias("_in"))
    placed = placed.where("size > 0").join(chunks, (F.col("sid") == F.col("s")) & (F.col("_chunk") == F.col("c")))
    at = F.col("before") + F.col("_in")
    pieces = placed.select("row", "sid", "size", at.alias("at"), F.explode(F.sequence(F.floor(at / block), F.floor((at + F.col("size") - 1) / block))).alias("block")).select(
        "row", "sid", "block", F.greatest(F.lit(0), F.col("block") * block - F.col("at")).alias("first_word"),
        F.greatest(F.lit(0), F.col("at") - F.col("block") * block).alias("offset"),
        (F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("at", F.col("block") * block)).alias("words"),
    )

    draws = sources.agg(F.sum("draws")).first()[0] or 0
    shards = max(1, -(-draws // DRAWS))
    drawn = quotas(sources, shards).join(sources.select(F.col("sid").alias("s"), "blocks", "draws", "last_words"), F.col("sid") == F.col("s"))
    drawn = drawn.select("sid", "shard", "blocks", "draws", "last_words", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("quota") - 1)).alias("t"))
    epoch, number = _permuted(F.col("t"))
    taken = F.when(F.col("t") == F.col("draws") - 1, F.col("last_words")).otherwise(F.lit(block))
    drawn = drawn.select(F.col("sid").alias("s"), number.alias("b"), "shard", "t", epoch.alias("epoch"), taken.alias("limit"))

    rows = pieces.join(drawn, (F.col("sid") == F.col("s")) & (F.col("block") == F.col("b"))).withColumn(
        "words", F.least("words", F.col("limit") - F.col("offset"))
    ).where("words > 0")
    # what a document gives to neighbouring blocks of one pass is one stretch, in the shard of the first
    line = Window.partitionBy("row", "epoch").orderBy("first_word")
    rows = rows.withColumn("_new", (F.lag(F.col("first_word") + F.col("words")).over(line) != F.col("first_word")).cast("long"))
    rows = rows.withColumn("_run", F.sum(F.coalesce("_new", F.lit(0))).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy("row", "epoch", "_run").agg(
        F.min_by(F.struct("shard", "t"), "first_word").alias("_first"), F.min("first_word").alias("first_word"), F.sum("words").alias("words")
    ).select("row", "epoch", "_first.*", "first_word", "words")
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64("shard", "t", "row"), "t", "row")
    rows = rows.withColumn("position", F.row_number().over(shuffled) - 1).select(
        "row", "shard", "position", "epoch", "first_word", "words"
    )
    return Mix(sized.drop("_id", "_source", "_print"), documents, sources, rows)


def taken_words(mixed: Mix) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    sums = mixed.rows.groupBy(F.col("row").alias("r")).agg(F.sum("words").alias("taken"))
    sources = mixed.sources.select(F.col("sid").alias("s"), "source_size", "target")
    return (
        mixed.documents.select("row", "_id", "size", "sid").join(sums, F.col("row") == F.col("r"), "left")
        .join(sources, F.col("sid") == F.col("s"))
        .select(F.col("_id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
    )


def mixed_documents(
    mixed: Mix, text_col: str, columns: list[str], place: str = "place", changed: str = "cut"
) -> DataFrame:
    """The mixture as documents: a row per stretch taken, its text cut to these words with their white space.

    ``mix`` must have kept ``columns``. Rows carry their ``place`` (shard and position in it) besides,
    and whether their text is ``cut``.
    """
    each = F.struct("shard", "position", "first_word", "words")
    places = mixed.rows.groupBy(F.col("row").alias("r")).agg(F.collect_list(each).alias("places"))
    text = F.col(f"`_kept_{text_col}`")
    parts = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + common.WORD), F.lit(0))
    cut = F.array_join(F.slice(parts, (F.col("first_word") + 1).cast("int"), F.col("words").cast("int")), "")
    joined = mixed.kept.join(places, F.col("row") == F.col("r"))
    opened = joined.select("size", *[f"_kept_{c}" for c in columns], F.inline("places"))
    return opened.select(
        *[(F.when(F.col("words") == F.col("size"), text).otherwise(cut) if c == text_col else F.col(f"`_kept_{c}`")).alias(c) for c in columns],
        F.struct("shard", "position").alias(place), (F.col("words") < F.col("size")).alias(changed),
    )
