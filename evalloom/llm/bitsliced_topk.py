"""Exact top-k inner products over a bit-sliced index.

Vectors become integers per component. A block of rows is stored as bit slices: for every
component and binary digit, one bitmap over the block's rows. A query's score for all
rows of a block is a sum of slices, shifted by the digits of the query and added by bitwise full
adders, so that the result is again a bit-sliced number. Its slices are walked from the most significant
downwards to keep the k best rows; rows that tie at the boundary are settled by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.storage import stored

#: Rows in a block, and queries and blocks that meet in one group of work.
BLOCK, QUERIES, BLOCKS = 1 << 15, 512, 4
#: A component of this size or more has no 64-bit integer to score with; such a vector takes no part.
LIMIT = 1 << 62

BLOCK_SCHEMA = "block long, ids binary, low binary, bits binary, slices binary"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``vec_id, v``: components as floor(scale * x). Null ids, null vectors, and null, non-finite or beyond 64-bit components drop a row."""
    x = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda x: x * F.lit(float(scale)))
    usable = F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float(LIMIT)))
    return vectors.where(F.col(f"`{id_col}`").isNotNull() & F.coalesce(usable, F.lit(False))).select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(x, lambda y: F.floor(y)).alias("v")
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    made = np.zeros((len(column), width), np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    made[np.repeat(np.arange(len(column)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return made


def sliced(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per component its least value and number of digits; and the bitmaps, one row of 64-bit words per digit."""
    low = matrix.min(axis=0)
    above = (matrix - low).astype(np.uint64)
    bits = np.array([int(c.max()).bit_length() for c in above.T], np.int64)
    pad = -len(matrix) % 64
    maps = []
    for column, n in zip(above.T, bits):
        for d in range(n):
            bitmap = np.packbits((column >> np.uint64(d) & np.uint64(1)).astype(np.uint8), bitorder="little")
            maps.append(np.pad(bitmap, (0, (len(matrix) + pad) // 8 - len(bitmap))).view(np.uint64))
    return low, bits, np.array(maps, np.uint64).reshape(len(maps), (len(matrix) + pad) // 64)


def index(rows: DataFrame) -> DataFrame:
    """Blocks of up to ``BLOCK`` rows of (vec_id, v), built within the tasks that read them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            ids, column = table.column(0).to_numpy(), table.column(1).combine_chunks()
            width = max(1, int(np.diff(column.offsets.to_numpy()).max()))
            order = np.argsort(ids, kind="stable")
            low, bits, maps = sliced(_matrix(column, width)[order])
            row = [int(ids.min()), ids[order].astype(np.int64).tobytes(), low.tobytes(), bits.tobytes(), maps.tobytes()]
            return pa.RecordBatch.from_arrays(
                [pa.array([row[0]], pa.int64())] + [pa.array([x], pa.binary()) for x in row[1:]],
                names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")],
            )

        for batch in batches:
            while batch.num_rows:
                space = BLOCK - sum(b.num_rows for b in held)
                held.append(batch.slice(0, space))
                batch = batch.slice(space)
                if sum(b.num_rows for b in held) == BLOCK:
                    yield block()
                    held = []
        if held:
            yield block()

    return rows.mapInArrow(run, BLOCK_SCHEMA)


class Block:
    """One block, ready for queries."""

    def __init__(self, ids: bytes, low: bytes, bits: bytes, slices: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.low, self.bits = np.frombuffer(low, np.int64), np.frombuffer(bits, np.int64)
        words = -(-len(self.ids) // 64)
        self.maps = np.frombuffer(slices, np.uint64).reshape(int(self.bits.sum()), words)
        self.all = np.zeros(words, np.uint64)
        self.all[:] = ~np.uint64(0)
        if over := len(self.ids) % 64:
            self.all[-1] = np.uint64((1 << over) - 1)
        self.inverse = self.maps ^ self.all
        self.first = np.concatenate(([0], np.cumsum(self.bits)))

    def total(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """The scores of all rows as slices, least significant first, and the constant to add.

        A negative factor is applied to the complement of a component's digits, so that only
        non-negative numbers are added.
        """
        waiting: list[list[np.ndarray]] = []
        constant = 0
        ends = [max(abs(int(a)), abs(int(a) + (1 << int(n)) - 1)) for a, n in zip(self.low, self.bits)]
        if sum(abs(int(q)) * e for q, e in zip(query, ends)) >= 1 << 61:  # sums of slices stay below 2**64
            raise OverflowError("a score may be beyond 64 bits")
        for c in range(min(len(query), len(self.low))):
            factor, n = int(query[c]), int(self.bits[c])
            constant += factor * int(self.low[c])
            if not factor or not n:
                continue
            maps = self.maps if factor > 0 else self.inverse
            if factor < 0:
                constant += factor * ((1 << n) - 1)
                factor = -factor
            while len(waiting) < n + factor.bit_length():
                waiting.append([])
            for d in range(factor.bit_length()):
                if factor >> d & 1:
                    for k in range(n):
                        waiting[d + k].append(maps[self.first[c] + k])
        made, place = [], 0
        while place < len(waiting):
            stack = waiting[place]
            while len(stack) > 1:
                a, b = stack.pop(), stack.pop()
                if place + 1 == len(waiting):
                    waiting.append([])
                half = a ^ b
                if stack:  # a full adder: three slices become one here and one above
                    c = stack.pop()
                    stack.insert(0, half ^ c)
                    waiting[place + 1].append((a & b) | (half & c))
                else:
                    stack.append(half)
                    waiting[place + 1].append(a & b)
            made.append(stack[0] if stack else np.zeros_like(self.all))
            place += 1
        return made, constant

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but those with the query's own id; ties to smaller ids."""
        slices, constant = self.total(query)
        candidates = self.all.copy()
        a, b = np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, side="right")
        for row in range(a, b):
            candidates[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        taken, count = np.zeros_like(candidates), 0
        for s in reversed(slices):
            ones = candidates & s
            n = int(np.bitwise_count(ones).sum())
            if count + n > k:
                candidates = ones
            else:
                taken |= ones
                count += n
                candidates &= ~s
                if count == k:
                    break
        rows = np.flatnonzero(np.unpackbits(taken.view(np.uint8), bitorder="little"))
        if count < k:  # all left score alike: rows are in order of id
            more = np.flatnonzero(np.unpackbits(candidates.view(np.uint8), bitorder="little"))
            rows = np.concatenate([rows, more[: k - count]])
        at, bit = rows >> 6, (rows & 63).astype(np.uint64)
        scores = np.full(len(rows), constant, np.int64)
        for place, s in enumerate(slices):
            scores += ((s[at] >> bit) & np.uint64(1)).astype(np.int64) << place
        return self.ids[rows], scores


FOUND = "query_id long, vec_id long, score long"


def _searched(blocks: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    made = [Block(*row) for row in blocks[["ids", "low", "bits", "slices"]].itertuples(index=False)]
    ids, vec_ids, scores = [], [], []
    for own, v in zip(queries["vec_id"], queries["v"]):
        query = np.asarray(v, np.int64)
        found = [b.best(query, own, k) for b in made]
        if not found:
            continue
        got, score = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        top = np.lexsort((got, -score))[:k]
        ids.append(np.full(len(top), own, np.int64))
        vec_ids.append(got[top])
        scores.append(score[top])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pd.DataFrame({"query_id": join(ids), "vec_id": join(vec_ids), "score": join(scores)})


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k rows of ``vectors`` with the highest integer inner product, per query.

    Ties go to smaller ids; a query with fewer candidates gets all of them. Rows with the query's
    own id are no candidates. Where scores may not fit a long, the job fails. Vectors of unequal length are compared as if the shorter ended in
    zeros. Repeated rows are candidates each; of repeated query ids one, the least vector, asks.
    Query blocks meet index blocks in a grid whose cells are tasks of bounded size, and each
    cell returns k rows per query, so work follows queries times rows and nothing else.
    """
    rows = quantised(vectors, id_col, vector_col, scale)
    blocks = stored(index(rows).withColumn("_place", F.monotonically_increasing_id()), "sliced-index")
    asked = stored(
        quantised(queries, id_col, vector_col, scale).groupBy("vec_id").agg(F.min("v").alias("v")), "sliced-queries"
    )
    across, down = max(1, -(-blocks.count() // BLOCKS)), max(1, -(-asked.count() // QUERIES))
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks.withColumn("b", F.pmod(F.xxhash64("_place"), F.lit(across)).cast("int")).withColumn("q", grid(down))
    right = asked.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(down)).cast("int")).withColumn("b", grid(across))
    found = (
        left.select("b", "q", "ids", "low", "bits", "slices").groupBy("b", "q")
        .cogroup(right.select("b", "q", "vec_id", "v").groupBy("b", "q"))
        .applyInPandas(lambda x, y: _searched(x, y, k), FOUND)
    )
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
