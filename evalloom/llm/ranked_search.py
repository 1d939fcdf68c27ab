"""Ranked lexical search of many items at once, sharing what the items have in common.

An item is a set of terms, and its score of a document is a sum over them, so items that
share terms share parts of their sums. Terms that the same items hold form one class; from the
classes, pairs that occur together in the most items become a new node of a graph, again and
again, until no pair is in two items (``share``). For a block of documents the accumulator of every
node is made once, level by level, and an item adds up the few nodes left to it.

Documents are read once per pass: lengths and the counts of the items' terms are stored, and
statistics and scores come from there. A pass takes items of ``TERMS`` terms together at most
(or one item), so what travels with the tasks has that bound whatever the number of items.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.storage import stored

#: Terms of the items of one pass, and shared classes of an item that are paired with each other at first.
TERMS, PAIRED = 100_000, 64
#: Accumulator cells held at once: documents of a block times nodes.
CELLS = 1 << 22

#: ASCII letters (small) and digits and every byte of other characters stay; all else parts terms.
_BYTES = bytes(c if c > 0x7F or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())

POSTINGS = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "item_id long, doc_id long, score long"


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text in order, with repeats."""
    return text.translate(_BYTES).split()


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item_id, term``: each term of an item once; rows of one id are one item, rows without id none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [(i, t) for i, text in zip(*batch.to_pydict().values()) for t in set(terms(text))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in held], pa.int64()), pa.array([t for _, t in held], pa.binary())], names=["item_id", "term"]
            )

    ids, text = F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string").cast("binary")
    asked = items.select(ids.alias("item_id"), text.alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    return asked.mapInArrow(run, "item_id long, term binary").distinct()


def passes(pairs: DataFrame, limit: int) -> DataFrame:
    """Adds ``pass``: so many that one has items of ``limit`` terms together at most, or a single item."""
    n = max(1, -(-pairs.count() // limit))
    while True:
        dealt = pairs.withColumn("pass", F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int"))
        sizes = dealt.groupBy("pass", "item_id").count().groupBy("pass").agg(F.sum("count").alias("terms"), F.count("*").alias("items"))
        if sizes.where((F.col("terms") > limit) & (F.col("items") > 1)).isEmpty():
            return dealt
        n *= 2


class Shared:
    """The query-sharing graph: leaves are classes of terms, a node adds two others, an item adds its nodes.

    ``class_of`` gives the leaf of a term, ``levels`` the nodes by depth as arrays (made, left, right),
    ``parts`` the nodes that an item is the sum of.
    """

    def __init__(self, class_of: np.ndarray, levels: list, parts: list[np.ndarray], nodes: int):
        self.class_of, self.levels, self.parts, self.nodes = class_of, levels, parts, nodes


def share(items: list[list[int]], n_terms: int) -> Shared:
    """Mine the term sets that items share. Every sum stays whole: only the order of additions is chosen here."""
    holders: list[list[int]] = [[] for _ in range(n_terms)]
    for i, held in enumerate(items):
        for t in held:
            holders[t].append(i)
    classes: dict[tuple, int] = {}
    class_of = np.array([classes.setdefault(tuple(h), len(classes)) for h in holders], np.int64)
    where = {c: set(h) for h, c in classes.items()}
    groups = [set(class_of[held].tolist()) if held else set() for held in items]
    pairs: Counter = Counter()
    for g in groups:
        widest = sorted((c for c in g if len(where[c]) > 1), key=lambda c: (-len(where[c]), c))[:PAIRED]
        pairs.update(combinations(sorted(widest), 2))
    heap = [(-n, a, b) for (a, b), n in pairs.items() if n > 1]
    heapq.heapify(heap)
    depth, made, nodes = defaultdict(int), defaultdict(list), len(classes)
    while heap:
        n, a, b = heapq.heappop(heap)
        both = where[a] & where[b]
        if len(both) < 2:
            continue
        if len(both) < -n:  # some of its items have used one of the two since
            heapq.heappush(heap, (-len(both), a, b))
            continue
        depth[nodes] = 1 + max(depth[a], depth[b])
        made[depth[nodes]].append((nodes, a, b))
        where[a], where[b], where[nodes] = where[a] - both, where[b] - both, both
        beside: Counter = Counter()
        for i in both:
            groups[i] -= {a, b}
            beside.update(c for c in groups[i] if len(where[c]) > 1)
            groups[i].add(nodes)
        for c, m in beside.items():
            if m > 1:
                heapq.heappush(heap, (-m, c, nodes))
        nodes += 1
    levels = [tuple(np.array(x, np.int64) for x in zip(*made[d])) for d in sorted(made)]
    return Shared(class_of, levels, [np.array(sorted(g), np.int64) for g in groups], nodes)


def postings(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Per document its terms with repeats (``n``), and the counts of the terms asked for. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for batch in batches:
            n, ends, held, counts = [], [0], [], []
            for text in batch.column(1):
                words = terms(text.as_py() or b"")
                found = Counter(map(get, words))
                found.pop(None, None)
                n.append(len(words))
                held.extend(found)
                counts.extend(found.values())
                ends.append(len(held))
            offsets = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (held, counts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    text = F.col(f"`{text_col}`").cast("string").cast("binary")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, POSTINGS)


def document_frequencies(held: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term; every task counts its own and sends one row per term it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], names=["term", "df"])

    counted = held.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    made = np.zeros(n_terms, np.int64)
    for row in counted.collect():  # n_terms rows at most
        made[row["term"]] = row["df"]
    return made


def length_factor(n: np.ndarray, n_docs: int, n_all: int) -> np.ndarray:
    """m of each document: 10 + (90 * n * N) div L; in exact integers also where 64 bits would overflow."""
    if 90 * n_docs * int(n.max(initial=0)) >= 1 << 63:
        return (10 + 90 * n.astype(object) * n_docs // n_all).astype(np.int64)
    return 10 + 90 * n * n_docs // n_all


class Best:
    """The k best documents of each item so far; equal scores by ascending id, documents without one last."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.held = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * n_items

    def add(self, item: int, ids: np.ndarray, missing: np.ndarray, scores: np.ndarray) -> None:
        old = self.held[item]
        least = max(1, old[2][-1]) if len(old[2]) == self.k else 1
        new = np.flatnonzero(scores >= least)
        if not len(new):
            return
        merged = [np.concatenate([a, b[new]]) for a, b in zip(old, (ids, missing, scores))]
        top = np.lexsort((merged[0], merged[1], -merged[2]))[: self.k]
        self.held[item] = tuple(x[top] for x in merged)


def _scored(held: DataFrame, shared: Shared, weights: np.ndarray, item_ids: list[int], n_docs: int, n_all: int, k: int) -> DataFrame:
    """``item_id, doc_id, score``: k documents per item and task at most."""
    block = max(16, CELLS // max(1, shared.nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(item_ids), k)
        for whole in batches:
            for at in range(0, whole.num_rows, block):
                batch = whole.slice(at, block)
                ids = batch.column(0).fill_null(0).to_numpy()
                missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
                m = length_factor(batch.column(1).to_numpy(), n_docs, n_all)
                row = np.repeat(np.arange(len(ids)), np.diff(batch.column(2).offsets.to_numpy()))
                term, tf = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy().astype(np.int64)
                sums = np.zeros((shared.nodes, len(ids)), np.int64)
                np.add.at(sums, (shared.class_of[term], row), weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row])))
                for made, left, right in shared.levels:
                    sums[made] = sums[left] + sums[right]
                for item, parts in enumerate(shared.parts):
                    best.add(item, ids, missing, sums[parts].sum(axis=0))
        asked = np.repeat(np.array(item_ids, np.int64), [len(h[0]) for h in best.held])
        join = lambda j, kind: np.concatenate([h[j] for h in best.held] or [np.zeros(0, kind)])
        doc_ids = pa.array(join(0, np.int64), pa.int64(), mask=join(1, bool))
        yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), doc_ids, pa.array(join(2, np.int64), pa.int64())], names=["item_id", "doc_id", "score"])

    return held.where(F.size("terms") > 0).mapInArrow(run, FOUND)


def _one_pass(docs: DataFrame, items: dict[int, list[bytes]], k: int, id_col: str, text_col: str) -> DataFrame:
    vocabulary: dict[bytes, int] = {}
    numbered = [[vocabulary.setdefault(t, len(vocabulary)) for t in sorted(held)] for held in items.values()]
    held = stored(postings(docs, vocabulary, id_col, text_col), "search-postings")
    totals = held.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = document_frequencies(held, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * totals["docs"] + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    return _scored(held, share(numbered, len(vocabulary)), weights, list(items), totals["docs"], totals["terms"], k)


def top_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", limit: int = TERMS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of highest score above 0 of every item.

    Terms are runs of ASCII letters, digits and all characters beyond ASCII; only A-Z are
    lower-cased. Equal scores go by ascending ``doc_id``, documents without an id last; repeated rows
    are documents of their own. Null and empty texts have no terms and count nowhere. Rows of one
    item id are one item with the terms of all; an item without id or terms gets no rows.
    """
    pairs = stored(passes(stored(item_terms(items, item_col, item_text_col), "search-terms"), limit), "search-passes")
    found = docs.sparkSession.createDataFrame([], FOUND)
    for number in sorted(r[0] for r in pairs.select("pass").distinct().collect()):
        asked: dict[int, list[bytes]] = defaultdict(list)
        for row in pairs.where(F.col("pass") == number).collect():  # ``limit`` rows at most, or one item
            asked[row["item_id"]].append(bytes(row["term"]))
        found = found.unionByName(_one_pass(docs, dict(sorted(asked.items())), k, id_col, text_col))
    ranked = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", ranked).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
