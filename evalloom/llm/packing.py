"""Packing tokenized documents into sequences of fixed length by local search.

Documents are cut only where they exceed a sequence. The cut pieces are spread evenly over
buckets of bounded size; each is packed best-fit, then improved: documents move, swap one
for one, or two for one, from emptier into fuller underfull bins, which raises the sum
of squared fills until bins run empty. What stays underfull in a bucket is gathered over
buckets and packed once more.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm.token_ids import encoder
from evalloom.storage import stored

#: Pieces in a bucket, and passes of the search over it.
BUCKET, PASSES = 8_000, 6
#: Bins filled to less than this share are packed again across buckets.
REPACKED = 0.97

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """The token pieces of whole texts: ``doc_id, piece, start, length, ids_crc32`` and, if asked, ``ids``.

    A document is its ids and ``end_id``; a null text is empty. A document longer than ``capacity``
    is cut into pieces of that length, of which the first takes the remainder. ``ids_crc32``
    is over the ids as unsigned 32-bit little-endian integers.
    """
    schema = PIECES + (", ids array<int>" if keep_ids else "")

    def cut(n: int) -> list[tuple[int, int]]:
        first = n if n <= capacity else n % capacity or capacity
        return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        encode = encoder(tokenizer).encode

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [[]] * (6 if keep_ids else 5)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                for number, (start, length) in enumerate(cut(len(ids) // 4)):
                    part = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, number, start, length, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4").astype(np.int32)) if keep_ids else row)
                    held += length
                if held > 1 << 20:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return texts.mapInArrow(run, schema)


class Bins:
    """Bins of one bucket: which items lie in each, and the fill."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that takes it."""
        room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        open_rooms = 0  # bit r is set while a bin has r tokens left
        for i in sorted(range(len(self.lengths)), key=lambda i: -self.lengths[i]):
            n = self.lengths[i]
            fitting = open_rooms >> n
            if fitting:
                r = n + (fitting & -fitting).bit_length() - 1
                b = room[r].pop()
                if not room[r]:
                    open_rooms &= ~(1 << r)
                self.bins[b].append(i)
            else:
                b, r = len(self.bins), self.capacity
                self.bins.append([i])
                self.fill.append(0)
            self.fill[b] += n
            if left := r - n:
                room[left].append(b)
                open_rooms |= 1 << left

    def improve(self) -> bool:
        """One pass over the underfull bins, fullest first, taking from emptier ones; whether anything changed."""
        order = sorted((b for b in range(len(self.bins)) if 0 < self.fill[b] < self.capacity), key=lambda b: -self.fill[b])
        holders: dict[int, set[int]] = defaultdict(set)  # length: emptier bins that hold one
        present = 0
        for b in order:
            for i in self.bins[b]:
                holders[self.lengths[i]].add(b)
                present |= 1 << self.lengths[i]

        def forget(b: int, n: int) -> None:
            nonlocal present
            if not any(self.lengths[i] == n for i in self.bins[b]):
                holders[n].discard(b)
                if not holders[n]:
                    present &= ~(1 << n)

        def most(limit: int) -> int:
            """The longest item of an emptier bin that is at most so long, or 0."""
            return (present & ((1 << (limit + 1)) - 1)).bit_length() - 1 if limit > 0 and present & ((1 << (limit + 1)) - 2) else 0

        changed = False
        for b in order:
            if not self.fill[b]:
                continue
            for n in {self.lengths[i] for i in self.bins[b]}:
                holders[n].discard(b)
                if not holders[n]:
                    present &= ~(1 << n)
            while (left := self.capacity - self.fill[b]) and present:
                own = sorted({self.lengths[i] for i in self.bins[b]})
                options = [(most(left), (), (most(left),))]  # a move
                for k, y in enumerate(own):
                    x = most(y + left)
                    options.append((x - y, (y,), (x,)))  # one for one
                    for z in own[k + 1 :]:
                        x = most(y + z + left)
                        options.append((x - y - z, (y, z), (x,)))  # one for two
                    x = most(y + left - 1)
                    rest = most(y + left - x) if x else 0
                    if rest and (rest != x or len(holders[x]) > 1):
                        options.append((x + rest - y, (y,), (x, rest)))  # two for one
                gain, out, into = max(options, key=lambda o: o[0])
                if gain <= 0:
                    break
                self._exchange(b, out, into, holders, forget)
                for a, n in self._returned:
                    holders[n].add(a)
                    present |= 1 << n
                changed = True
        kept = [k for k in range(len(self.bins)) if self.fill[k]]
        self.bins, self.fill = [self.bins[k] for k in kept], [self.fill[k] for k in kept]
        return changed

    def _exchange(self, b: int, out: tuple, into: tuple, holders, forget) -> None:
        """Takes items of the lengths ``into`` from emptier bins, and gives those of ``out`` to the last of these."""
        self._returned = []
        a = b
        for n in into:
            a = max(holders[n])  # bins made last are emptier as a rule
            i = next(i for i in self.bins[a] if self.lengths[i] == n)
            self.bins[a].remove(i)
            self.bins[b].append(i)
            self.fill[a] -= n
            self.fill[b] += n
            forget(a, n)
        for n in out:
            i = next(i for i in self.bins[b] if self.lengths[i] == n)
            self.bins[b].remove(i)
            self.fill[b] -= n
            if self.fill[a] + n > self.capacity:  # cannot follow from one for one; two bins gave
                self.bins.append([])
                self.fill.append(0)
                a = len(self.bins) - 1
            self.bins[a].append(i)
            self.fill[a] += n
            self._returned.append((a, n))


def pack_lengths(lengths: list[int], capacity: int, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and bin fill of every item."""
    packed = Bins(lengths, capacity)
    packed.best_fit()
    before = len(packed.bins)
    first = ([list(b) for b in packed.bins], list(packed.fill))
    for _ in range(passes):
        if not packed.improve():
            break
    if len(packed.bins) > before:
        packed.bins, packed.fill = first
    where, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
    for k, items in enumerate(packed.bins):
        at = 0
        for i in items:
            where[i], offset[i], fill[i] = k, at, packed.fill[k]
            at += lengths[i]
    return where, offset, fill


def _packed(df: DataFrame, n_buckets: int, capacity: int, level: int) -> DataFrame:
    """``row, length`` packed in buckets by a hash of the row: adds ``sequence_id, offset, fill``."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", kind="stable")
        where, offset, fill = pack_lengths(group["length"].tolist(), capacity)
        first = ((int(group["bucket"].iloc[0]) * 2 + level) << 24) if len(group) else 0
        return pd.DataFrame({"row": group["row"], "length": group["length"], "sequence_id": first + where, "offset": offset, "fill": fill})

    spread = df.select("row", "length", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(n_buckets)).alias("bucket"))
    return spread.groupBy("bucket").applyInPandas(run, "row long, length long, sequence_id long, offset long, fill long")


def pack(items: DataFrame, capacity: int = 2048, bucket: int = BUCKET) -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset``: places in sequences of at most ``capacity``.

    ``items`` needs a ``length`` from 1 to ``capacity``; its other columns are kept, but for any of
    the two names. Rows are told apart by their place in a stored table, so repeated rows
    are packed like others and no key can crowd a bucket. Items of full length are sequences
    by themselves. Only row numbers and lengths are shuffled for the search.
    """
    items = items.drop("sequence_id", "offset")
    kept = items.columns
    rows = stored(items.withColumn("_row", F.monotonically_increasing_id()), "pack-items")
    whole = rows.where(F.col("length") == capacity).select(
        *kept, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    parts = rows.where(F.col("length") < capacity).select(F.col("_row").alias("row"), F.col("length").cast("long").alias("length"))
    first = stored(_packed(parts, max(1, math.ceil(parts.count() / bucket)), capacity, 0), "pack-first")
    loose = first.where(F.col("fill") < REPACKED * capacity)
    again = _packed(loose, max(1, math.ceil(loose.count() / bucket)), capacity, 1)
    places = stored(
        first.where(F.col("fill") >= REPACKED * capacity).unionByName(again).select(F.col("row").alias("_r"), "sequence_id", "offset"),
        "pack-places",
    )
    placed = rows.join(places, F.col("_row") == F.col("_r")).select(*kept, "sequence_id", "offset")
    return whole.unionByName(placed)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids, doc_ids``, from pieces with ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids")
    )
