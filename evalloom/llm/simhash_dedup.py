"""Near-duplicate documents by SimHash, with a hash family that misses no close pair.

Covering locality-sensitive hashing: each bit position gets a non-zero vector of
``radius + 1`` bits, and for each non-zero vector v a table keeps the positions whose vector has
an odd product with v. Any ``radius`` positions leave some v orthogonal to all of them, so two
fingerprints that differ there only agree on that table's mask: every pair within the radius
collides in one of the ``2 ** (radius + 1) - 1`` tables. Buckets too large to compare
directly are hashed again on their free bits by the same rule, which stays exact; after three
masks at most 6 bits are free, so a bucket of distinct fingerprints holds 64 at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.storage import stored

BITS = 64
SEED = 42
#: Buckets of up to so many fingerprints are compared directly, larger ones are split again.
DIRECT = 64


def simhash(text: bytes, seed: int = SEED) -> int:
    """The fingerprint of UTF-8 text, over all its three-word shingles, repeats included."""
    words = text.lower().split()  # bytes: only A-Z are lowered, only the six ASCII white spaces split
    if not words:
        return 0
    if len(words) < 3:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:-2].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(line[a:b], seed) for a, b in zip(starts, ends[2:].tolist())), np.uint64, len(starts)
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long; zero for texts without words, null ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [simhash(t or b"") for t in batch.column(1).to_pylist()]
            fp = pa.array(np.array(made, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fp], names=["doc_id", "fp"])

    df = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")
    )
    return df.mapInArrow(run, "doc_id long, fp long")


def covering_masks(free: list[int], radius: int) -> list[int]:
    """Bit masks over the free positions, such that any ``radius`` of these miss some mask."""
    tables = 2 ** (radius + 1) - 1
    vector = {bit: 1 + i % tables for i, bit in enumerate(free)}
    return [
        sum(1 << bit for bit in free if (vector[bit] & v).bit_count() % 2)
        for v in range(1, tables + 1)
    ]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _linked(radius: int):
    """Of each bucket, links to the smallest fingerprint of every local component: n - 1 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for bucket in batch.column(0).to_pylist():
                fps = np.unique(np.array(bucket, np.int64))
                near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= radius
                root = np.arange(len(fps))
                while True:
                    low = np.where(near, root[None, :], len(fps)).min(axis=1)
                    if (low == root).all():
                        break
                    root = low[low]
                for i in np.flatnonzero(root != np.arange(len(fps))):
                    a.append(int(fps[i]))
                    b.append(int(fps[root[i]]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def links(fps: DataFrame, radius: int = 2, direct: int = DIRECT) -> DataFrame:
    """``a, b``: links that connect distinct fingerprints (``fp``) exactly as all pairs within the radius do."""
    found = []
    paths = {0: (list(range(BITS)), 0)}  # of each chain of tables: free positions, mask so far
    rows = fps.select(F.lit(0).alias("path"), "fp")
    for level in range(1, 4):
        children = {}
        options = []
        for path, (free, mask) in paths.items():
            own = covering_masks(free, radius)
            for v, extra in enumerate(own):
                child = path * len(own) + v
                children[child] = ([bit for bit in free if not extra >> bit & 1], mask | extra)
            options.append([_signed(mask | extra) for extra in own])
        tables = len(options[0])
        masks = F.array(*[F.array(*[F.lit(m) for m in own]) for own in options])
        keyed = rows.select("path", "fp", F.posexplode(F.element_at(masks, F.col("path") + 1)).alias("v", "mask")).select(
            (F.col("path") * tables + F.col("v")).alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp"
        )
        sizes = stored(
            keyed.groupBy("path", "key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
            .where("n > 1"),
            "simhash-buckets",
        )
        found.append(sizes.where(f"n = 2 AND bit_count(a ^ b) <= {radius}").select("a", "b"))
        if sizes.where("n > 2").isEmpty():
            break
        small = direct if level < 3 else 1 << 62
        crowd = sizes.where("n > 2").select(F.col("path").alias("p"), F.col("key").alias("k"), "n")
        shared = stored(
            keyed.join(crowd, (F.col("path") == F.col("p")) & (F.col("key") == F.col("k"))).select("path", "key", "fp", "n"),
            "simhash-shared",
        )
        buckets = shared.where(F.col("n") <= small).groupBy("path", "key").agg(F.collect_list("fp").alias("fps"))
        found.append(buckets.select("fps").mapInArrow(_linked(radius), "a long, b long"))
        rows = shared.where(F.col("n") > small).select("path", "fp")
        paths = children
        if level == 3 or rows.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: of each node of the edges (a, b), the smallest node it is connected with.

    Every round takes the smallest label among neighbours, then the label of that label, so
    paths shorten by halves; it ends when no label changes. Each round is a stored table.
    """
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        heard = (
            both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("heard"))
        )
        near = stored(
            labels.join(heard, labels["node"] == heard["a"]).select("node", F.least("label", "heard").alias("label"), F.col("label").alias("was")),
            "labels-near",
        )
        far = near.select(F.col("node").alias("n"), F.col("label").alias("l"))
        after = stored(near.join(far, near["label"] == far["n"]).select("node", F.col("l").alias("label"), "was"), "labels")
        if after.where("label <> was").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``; other columns are ignored.

    ``component_id`` is the smallest id reachable over links of at most ``radius`` differing bits.
    Documents without words share fingerprint zero and are linked like any others. A null
    id is never smallest: a component of null ids only has a null ``component_id``. Repeated
    rows stay repeated; an empty table gives an empty result. The texts are read once;
    links are sought between distinct fingerprints, and a group of equal ones of any size
    is one of these.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    firsts = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprint-firsts")
    labels = components(links(firsts, radius))
    joined = labels.join(firsts, labels["node"] == firsts["fp"])
    lowest = joined.groupBy(F.col("label").alias("l")).agg(F.min("first").alias("component_id"))
    groups = stored(labels.join(lowest, F.col("label") == F.col("l")).select("node", "component_id"), "fingerprint-groups")
    known = stored(
        firsts.join(groups, firsts["fp"] == groups["node"], "left")
        .select(F.col("fp").alias("f"), F.coalesce("component_id", "first").alias("component_id")),
        "fingerprint-components",
    )
    return prints.join(known, prints["fp"] == known["f"]).select("doc_id", "fp", "component_id")
