"""From raw documents to packed sequences: five stages, each written as Parquet and read by the next.

Every stage but the last returns the columns of its input. Rows stand for themselves: ids may
be null or repeated, and other columns are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import common, mixing, packing, secret_scan, simhash_dedup, toxicity
from evalloom.storage import scratch_path, stored

#: Documents that score at least this are rejected.
TOXIC = 0.3
TOKENIZER = "byte_bpe_50k.json"


def _with_text(columns: DataFrame, changed: Column, text: str) -> list[Column]:
    """The columns with the text from the column ``text``, and its length where there are lengths and the text changed."""
    new = {"text": F.col(text)}
    if "n_chars" in columns.columns:
        kind = columns.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.char_length(text).cast(kind)).otherwise(F.col("n_chars"))
    return [new.get(c, F.col(f"`{c}`")).alias(c) for c in columns.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose toxicity reaches ``TOXIC``, by a model fitted to the labels beside them."""
    common.text_batches(spark)
    rated = toxicity.rate(docs, common.table(spark, sf_dir, "labels"), score_col="_pipeline_score")
    return rated.where(F.col("_pipeline_score") < TOXIC).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates keeps one: that of the smallest id, or the first read where ids are null or equal."""
    common.text_batches(spark)
    rows = stored(docs.withColumn("_pipeline_row", F.monotonically_increasing_id()), "pipeline-rows")
    found = simhash_dedup.near_duplicates(rows, id_col="_pipeline_row").select(F.col("doc_id").alias("_r"), "component_id")
    ids = rows.select("_pipeline_row", F.col("doc_id").alias("_id")).join(found, F.col("_pipeline_row") == F.col("_r"))
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_pipeline_row")).alias("first"))
    chosen = stored(first.select(F.col("first._pipeline_row").alias("_keep")), "pipeline-chosen")
    # rejected rows are fewer than kept ones, and the side of the join that may be small enough to send around
    others = ids.select(F.col("_pipeline_row").alias("_other")).join(chosen, F.col("_other") == F.col("_keep"), "left_anti")
    rejected = stored(others, "pipeline-rejected")
    kept = rows.join(rejected, F.col("_pipeline_row") == F.col("_other"), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret found in a text by a mark; all documents stay."""
    found = secret_scan.scan(docs, names=("_pipeline_base", "_pipeline_spans"))
    spans = F.col("_pipeline_spans")
    found = found.withColumn("_pipeline_text", secret_scan.redacted(F.col("text"), spans))
    return found.select(*_with_text(docs, F.size(spans) > 0, "_pipeline_text"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources: a row for every stretch of a document that it takes, so documents may recur or be cut."""
    mixed = mixing.mixed_documents(mixing.mix(docs, keep=docs.columns), "text", docs.columns, changed="_pipeline_cut")
    return mixed.select(*_with_text(docs, F.col("_pipeline_cut"), "text"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 2048 tokens."""
    common.text_batches(spark)
    return packing.pack(packing.pieces(docs, public_tokenizers.path(TOKENIZER)))


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: Fitted models, hashes and searches: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
