"""Token ids in files: every document compressed alone, with one shared zstandard dictionary.

A written set is a folder of four Parquet tables, so any store Spark reaches will do:

* ``dictionary``: hash and content of the dictionary, trained on serialized id arrays;
* ``chunks``: ``shard, chunk`` and ``data``, the compressed documents one after the other in
  ascending order of id, with the dictionary's hash, the width of an id in bytes, and for
  every document its id, offset, size and number of tokens;
* ``starts``: the number of tokens before each chunk;
* ``index``: where each document lies, so that a short one is read without its neighbours.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalloom.llm.token_ids import encoder

#: Bytes of compressed data in a chunk, and documents in it at most.
CHUNK, CHUNK_DOCS = 1 << 22, 4096
#: The dictionary is fitted to so many whole documents at most, cut to blocks of so many ids, of which so many are kept.
FIT_TEXTS, FIT_IDS, FIT_BLOCKS, DICTIONARY = 2_000, 2_048, 4_000, 64_000
LEVEL = 3

CHUNKS = (
    "shard int, chunk int, dictionary_hash long, width int, n_tokens long, data binary, "
    "doc_ids array<long>, offsets array<long>, sizes array<long>, tokens array<long>"
)
DOCUMENTS = "shard int, chunk int, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def serialized(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train(docs: DataFrame, tokenizer: str, width: int) -> bytes:
    """The dictionary, from the documents of lowest hashed id; empty where they are too few to train on.

    Tasks encode these documents whole; of their blocks, from all places, those of lowest hash are
    collected: ``FIT_BLOCKS`` of ``FIT_IDS`` ids at most.
    """
    ids = [r[0] for r in docs.select("doc_id").where("doc_id IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_TEXTS).collect()]
    if not ids:
        return b""
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], "wanted long")  # FIT_TEXTS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = serialized(encode(text.as_py() or ""), width)
                step = FIT_IDS * width
                blocks = [ids[i : i + step] for i in range(0, len(ids), step)]
                made = [[doc_id] * len(blocks), list(range(len(blocks))), blocks]
                kinds = [pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds)], names=["doc_id", "at", "ids"])

    blocks = (
        docs.join(F.broadcast(wanted), F.col("doc_id") == F.col("wanted"), "left_semi")
        .groupBy("doc_id").agg(F.min("text").alias("text"))
        .mapInArrow(run, "doc_id long, at long, ids binary")
        .orderBy(F.xxhash64("doc_id", "at"), "doc_id", "at").limit(FIT_BLOCKS).collect()
    )
    samples = [bytes(r["ids"]) for r in blocks]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(content: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(content)} if content else {}


def write(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode whole texts, append ``end_id``, and write them to ``path`` in ascending order of id.

    A null text is empty, a null id comes first, and repeated rows are written each. Texts are
    split among tasks by ranges of their ids (rows of one id may be split too), so every
    task writes its own stretch of the order.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    width = 2 if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    content = train(texts, tokenizer, width)
    digest = xxhash.xxh64_intdigest(content) >> 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False, **_codec(content))
        end, shard, chunk = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        frames: list[bytes] = []
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            doc_ids, offsets, sizes, tokens = (list(c) for c in zip(*rows))
            row = {
                "shard": shard, "chunk": chunk, "dictionary_hash": digest, "width": width, "n_tokens": sum(tokens),
                "data": b"".join(frames), "doc_ids": doc_ids, "offsets": offsets, "sizes": sizes, "tokens": tokens,
            }
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                frame = compressor.compress(serialized(ids, width))
                if rows and (size + len(frame) > CHUNK or len(rows) == CHUNK_DOCS):
                    yield flush()
                    frames, rows, size, chunk = [], [], 0, chunk + 1
                rows.append((doc_id, size, len(frame), len(ids) // 4))
                frames.append(frame)
                size += len(frame)
        if rows:
            yield flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        texts.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "_row")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_row").drop("_row")
    )
    spark.createDataFrame([(digest, content)], "hash long, content binary").coalesce(1).write.parquet(f"{path}/dictionary")
    ordered.mapInArrow(run, CHUNKS).write.parquet(f"{path}/chunks")
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks")
    _starts(chunks).write.parquet(f"{path}/starts")
    starts = spark.read.parquet(f"{path}/starts")
    each = F.inline(F.arrays_zip("doc_ids", "offsets", "sizes", "tokens", "ends"))
    running = F.aggregate(
        "tokens", F.array(F.lit(0).cast("long")), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n))
    )
    (
        chunks.withColumn("ends", F.slice(running, F.lit(1), F.size("tokens"))).select("shard", "chunk", each)
        .join(starts, ["shard", "chunk"])
        .select(
            F.col("doc_ids").alias("doc_id"), "shard", "chunk", F.col("offsets").alias("offset"), F.col("sizes").alias("size"),
            F.col("tokens").alias("n_tokens"), (F.col("start") + F.col("ends")).alias("start"),
        )
        .write.parquet(f"{path}/index")
    )


_ARROW = pa.schema(
    [("shard", pa.int32()), ("chunk", pa.int32()), ("dictionary_hash", pa.int64()), ("width", pa.int32()), ("n_tokens", pa.int64()), ("data", pa.binary())]
    + [(name, pa.list_(pa.int64())) for name in ("doc_ids", "offsets", "sizes", "tokens")]
)


def _starts(chunks: DataFrame) -> DataFrame:
    """``shard, chunk, start``: tokens before each chunk. Only the totals of shards, a row per write task, meet in one window."""
    sizes = chunks.select("shard", "chunk", "n_tokens")
    shards = sizes.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = shards.select(
        F.col("shard").alias("s"),
        (F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("before"),
    )
    inside = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0))
    return sizes.withColumn("inside", inside - F.col("n_tokens")).join(before, F.col("shard") == F.col("s")).select(
        "shard", "chunk", (F.col("before") + F.col("inside")).alias("start")
    )


def _dictionary(spark: SparkSession, path: str) -> tuple[int, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()  # one row, DICTIONARY bytes
    return row["hash"], bytes(row["content"])


def _ids(decompressor, frame: bytes, width: int) -> np.ndarray:
    return np.frombuffer(decompressor.decompress(frame), "<u2" if width == 2 else "<u4").astype("<u4")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a written set, from its files: ``doc_id, start, n_tokens, ids_crc32``.

    Every document is decompressed. A set whose chunks name another dictionary than the one
    beside them is refused.
    """
    digest, content = _dictionary(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor(**_codec(content))
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_hash"] != digest:
                    raise ValueError("a chunk was written with another dictionary")
                rows, at = [], 0
                for doc_id, offset, size in zip(row["doc_ids"], row["offsets"], row["sizes"]):
                    ids = _ids(decompressor, row["data"][offset : offset + size], row["width"])
                    rows.append((row["shard"], row["chunk"], doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
                names = [x.split()[0] for x in DOCUMENTS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    documents = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").mapInArrow(run, DOCUMENTS)
    starts = spark.read.parquet(f"{path}/starts")
    return documents.join(starts, ["shard", "chunk"]).select(
        "doc_id", (F.col("start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def fetch(spark: SparkSession, path: str, doc_ids: DataFrame) -> DataFrame:
    """``doc_id, ids`` of the wanted documents (``doc_id``), each decompressed alone by the offset index."""
    digest, content = _dictionary(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompressor = zstandard.ZstdDecompressor(**_codec(content))
        for batch in batches:
            rows = batch.to_pylist()
            if any(r["dictionary_hash"] != digest for r in rows):
                raise ValueError("a chunk was written with another dictionary")
            ids = [_ids(decompressor, r["frame"], r["width"]).astype(np.int32) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"]
            )

    places = spark.read.parquet(f"{path}/index").join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").select("shard", "chunk", "data", "dictionary_hash", "width")
    frames = places.join(chunks, ["shard", "chunk"]).select(
        "doc_id", "dictionary_hash", "width", F.substring("data", (F.col("offset") + 1).cast("int"), F.col("size").cast("int")).alias("frame")
    )
    return frames.mapInArrow(run, "doc_id long, ids array<int>")
