"""Toxicity by compression distance: which of two dictionaries shortens a text's windows more.

Two zstandard dictionaries are trained on labelled texts, one on passages of toxic texts and
one on windows of ordinary ones. Both end in the same passages of ordinary language, so that
what both know costs the same under both. Most of a toxic text is ordinary language too, so
its passages are contrasted first: toxic texts are dealt to a few parts, and of each part's
passages those stay that a dictionary of the other parts shortens more than an ordinary one
does, which are passages that recur in toxic texts and not in ordinary ones, whatever words
they are made of. Every window of a text is compressed with both dictionaries, and the
differences in length feed a calibrated threshold: a logistic curve over the largest ones.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm import common
from evalloom.storage import stored

#: Words in a window and in a passage of the toxic dictionary, bytes of the shared end, compression level.
WINDOW, PASSAGE, SHARED, LEVEL = 24, 4, 160_000, 9
#: The fit takes so many toxic and ordinary texts at most, whole; the trainer sees about so many of their windows.
TOXIC_TEXTS, ORDINARY_TEXTS, TRAINER_ROWS = 3_000, 5_000, 200_000
#: Tasks that the sampled texts are dealt to.
FIT_TASKS = 24
#: Parts of the toxic texts, bytes of the dictionaries that contrast them, bytes that a passage must save to stay, and
#: how many bytes of passages that stayed make one byte of the dictionaries, of ``LEAST`` bytes at least.
PARTS, FIRST, SAVES, PER_BYTE, LEAST = 4, 60_000, 2, 20, 4_000
FEATURES = 6


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: list[float]  # bias first
    centre: list[float]
    scale: list[float]
    constant: float | None = None  # the score of every text, where labels of one kind only exist


def window_segments(texts: list[bytes], size: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Texts in lower case with single spaces, windows as (offset, length), and their number per text."""
    parts, segments, counts, at = [], [], np.zeros(len(texts), np.int64), 0
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) + at
        starts = np.concatenate(([at], ends[:-1]))[::size]
        stops = np.append(ends[size - 1 :: size][: len(starts) - 1], ends[-1]) + 1
        segments.append(np.stack([starts, stops - starts], axis=1))
        counts[i] = len(starts)
        parts.append(b" " + b" ".join(words) + b" ")
        at += len(parts[-1])
    made = np.concatenate(segments) if segments else np.zeros((0, 2), np.int64)
    return b"".join(parts), made.astype(np.uint64), counts


class Meter:
    """Window lengths under the two dictionaries, as features of texts."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.compressors = []
        for content in (toxic, ordinary):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.compressors.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
                )
            )

    def gains(self, buffer: bytes, segments: np.ndarray) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one, per window."""
        if not len(segments):
            return np.zeros(0, np.int64)
        windows = zstandard.BufferWithSegments(buffer, segments.tobytes())
        sizes = []
        for compressor in self.compressors:
            out = compressor.multi_compress_to_buffer(windows, threads=1)
            sizes.append(np.fromiter((len(x) for x in out), np.int64, len(out)))
        return sizes[1] - sizes[0]

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Per text: the three largest gains, the share and number of windows that gain, the number of windows."""
        made = np.zeros((len(texts), FEATURES))
        buffer, segments, counts = window_segments(texts, WINDOW)
        gains = np.clip(self.gains(buffer, segments), -8, 16)
        ends = np.cumsum(counts)
        for i in np.flatnonzero(counts):
            own = np.sort(gains[ends[i] - counts[i] : ends[i]])[::-1]
            made[i, : min(3, len(own))] = own[:3]
            much = (own >= 2).sum()
            made[i, 3:] = much / len(own), math.log1p(much), math.log1p(len(own))
        return made


def _trained(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """Dictionary content from zstandard's trainer; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def passages(texts: DataFrame, kind: int, size: int) -> DataFrame:
    """``part, passage``: the distinct windows of ``size`` words of all whole texts of a kind.

    A text belongs to one of ``PARTS`` parts by its id, a passage to the lowest part that has
    it; so copies count once and no passage is in two parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                buffer, segments, _ = window_segments([text.as_py()], size)
                found = list({buffer[a : a + n] for a, n in segments.tolist()})
                arrays = [pa.array([part] * len(found), pa.int32()), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["part", "passage"])

    part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int").alias("part")
    each = texts.where(F.col("toxic") == kind).select(part, "text").mapInArrow(run, "part int, passage binary")
    once = each.groupBy("passage").agg(F.min("part").alias("part")).select("part", "passage")
    return stored(once.repartition(FIT_TASKS, "passage"), "toxicity-passages")


def telling(found: DataFrame, pairs: list[tuple[bytes, bytes]]) -> DataFrame:
    """The rows of ``part, passage`` that the toxic dictionary for their part shortens by ``SAVES`` bytes more.

    ``pairs`` holds for each part the toxic and the ordinary dictionary, made without that part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meters = [Meter(*pair) for pair in pairs]
        for batch in batches:
            parts, held = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist()
            keep = np.zeros(len(held), bool)
            for part, meter in enumerate(meters):
                at = np.flatnonzero(parts == part)
                own = [held[i] for i in at]
                lengths = np.fromiter(map(len, own), np.int64, len(own))
                segments = np.stack([np.cumsum(lengths) - lengths, lengths], axis=1).astype(np.uint64)
                keep[at] = meter.gains(b"".join(own), segments) >= SAVES
            yield batch.filter(pa.array(keep))

    return stored(found.mapInArrow(run, "part int, passage binary"), "toxicity-telling")


def _collected(found: DataFrame) -> list[tuple[int, bytes]]:
    """All of ``part, passage``, or about ``TRAINER_ROWS`` rows from all places alike, in an order of no meaning."""
    n = max(1, found.count())
    rows = found.where(F.pmod(F.xxhash64("passage"), F.lit(n)) < TRAINER_ROWS).collect()
    return sorted(((r["part"], bytes(r["passage"])) for r in rows), key=lambda r: (zlib.crc32(r[1]), r[1]))


def dictionaries(texts: DataFrame) -> tuple[bytes, bytes]:
    """The toxic and the ordinary dictionary, of equal size and with equal ends, from ``id, text, toxic`` rows.

    Where no passage of toxic texts stays, all of them make the toxic dictionary.
    """
    plain = [passage for _, passage in _collected(passages(texts, 0, WINDOW))]
    shared = _trained(plain, SHARED, 64, 8)

    def pair(samples: list[bytes], size: int, k: int) -> tuple[bytes, bytes]:
        first = _trained(samples, size, k, 8)
        second = _trained(plain, max(LEAST, len(first)), 48, 6)
        least = min(len(first), len(second))
        return first[len(first) - least :] + shared, second[len(second) - least :] + shared

    found = passages(texts, 1, PASSAGE)
    held = _collected(found)
    stay = _collected(telling(found, [pair([x for part, x in held if part != p], FIRST, 24) for p in range(PARTS)]))
    chosen = [x for _, x in stay or held]
    return pair(chosen, max(LEAST, sum(map(len, chosen)) // PER_BYTE) if stay else FIRST, 32)


def measured(texts: DataFrame, toxic: bytes, ordinary: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the whole texts of ``id, text, toxic`` rows, by id."""
    names = [f"f{i}" for i in range(FEATURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(toxic, ordinary)
        for batch in batches:
            made = np.concatenate([meter.features([t.as_py()]) for t in batch.column(2)] or [np.zeros((0, FEATURES))])
            arrays = [*batch.columns[:2], *[pa.array(np.ascontiguousarray(c)) for c in made.T]]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "toxic", *names])

    schema = "id long, toxic int, " + ", ".join(f"{n} double" for n in names)
    rows = sorted(texts.select("id", "toxic", "text").mapInArrow(run, schema).collect())
    return np.array([r[2:] for r in rows], float), np.array([r["toxic"] for r in rows], float)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a penalised logistic regression, bias first, by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(labelled: DataFrame | None, toxic_share: float) -> Model:
    """Dictionaries from two thirds of the labelled texts, the curve from the other third.

    ``toxic_share`` is the share of toxic labels in all labelled rows; texts are weighed so that
    the curve gives probabilities at that share.
    """
    found = {(r["toxic"], r["probe"]) for r in labelled.select("toxic", "probe").distinct().collect()} if labelled is not None else ()
    if len(found) < 4:
        return Model(b"", b"", [], [], [], toxic_share)
    toxic, ordinary = dictionaries(labelled.where(~F.col("probe")))
    x, y = measured(labelled.where("probe"), toxic, ordinary)
    weight = np.where(y == 1, toxic_share / y.sum(), (1 - toxic_share) / (1 - y).sum()) * len(y)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    w = _logistic((x - centre) / scale, y, weight)
    return Model(toxic, ordinary, w.tolist(), centre.tolist(), scale.tolist())


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame | None, float]:
    """``id, toxic, probe, text`` of at most ``TOXIC_TEXTS`` and ``ORDINARY_TEXTS`` labelled texts, and the toxic share.

    They are the lowest by hash of their id, and whole; of every three one is for the curve. Only
    ids whose crc32 modulo 4 is not 2 are used; rows without a label or id are passed over.
    """
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (common.id_remainder(F.col("doc_id"), 4) != 2)
    )
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = {
        r["doc_id"]: (kind, i % 3 == 0)
        for kind, most in ((1, TOXIC_TEXTS), (0, ORDINARY_TEXTS))
        for i, r in enumerate(usable.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect())
    }
    if not ids:
        return None, 0.0
    spark = docs.sparkSession
    rows = [(i, *x) for i, x in ids.items()]  # TOXIC_TEXTS + ORDINARY_TEXTS rows at most
    wanted = spark.createDataFrame(rows, "wanted long, toxic int, probe boolean")
    texts = (
        docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
        .join(F.broadcast(wanted), F.col("id") == F.col("wanted"))
        .groupBy("id", "toxic", "probe").agg(F.coalesce(F.min("text"), F.lit("")).cast("binary").alias("text"))
        .repartition(FIT_TASKS, "id")
    )
    return stored(texts, "toxicity-sample"), counts.get(1, 0) / sum(counts.values())


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1 of each whole text; a column of that name is replaced.

    Null and empty texts have no windows and score as such; equal texts score equally. Rows are
    handled alone, in batches of a few MB of text.
    """
    docs = docs.drop(score_col, "_text")
    names = [*docs.columns, score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meter = Meter(model.toxic, model.ordinary) if model.constant is None else None
        weights, centre, scale = (np.array(x) for x in (model.weights, model.centre, model.scale))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            made, at = [], 0
            while at < len(texts):
                held, size = [], 0
                while at < len(texts) and size < 1 << 22:
                    held.append(texts[at].as_py() or b"")
                    size += len(held[-1])
                    at += 1
                if meter is None:
                    made.append(np.full(len(held), model.constant))
                else:
                    z = (meter.features(held) - centre) / scale @ weights[1:] + weights[0]
                    made.append(1 / (1 + np.exp(-np.clip(z, -50, 50))))
            column = pa.array(np.concatenate(made) if made else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=names)

    schema = docs.withColumn(score_col, F.lit(0.0)).schema
    return docs.withColumn("_text", F.col(f"`{text_col}`").cast("string").cast("binary")).mapInArrow(run, schema)


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``score`` with a model fitted to the labels. Without labels of both kinds, every score is their toxic share."""
    labelled, share = labelled_sample(docs, labels, id_col, text_col)
    return score(docs, fit(labelled, share), text_col, score_col)
