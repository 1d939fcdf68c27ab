"""The registered queries of the operators in this package, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.llm import bitsliced_topk, chat_windows, common, html_text, lm_score, mixing, packing, quality_rules, ranked_search, secret_scan, simhash_dedup, token_files, toxicity, whitening
from evalloom.storage import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

#: A file of public_tokenizers, found on every machine by that package.
TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            common.text_batches(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


_OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), twice AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), rules AS (
  SELECT d.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN lines USING (doc_id)
), failing AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM rules
), hosts AS (
  SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CAST(base_failed AS BIGINT)) AS DOUBLE) AS k
  FROM failing GROUP BY source
), moments AS (
  SELECT sum(k) / sum(n) AS m, sum(k * k / n) - sum(n) * (sum(k) / sum(n)) ** 2 AS scatter,
         sum(n) - sum(n * n) / sum(n) AS spread, count(*) AS hosts FROM hosts
), betweens AS (
  SELECT *, CASE WHEN spread > 0 THEN (scatter - (hosts - 1) * m * (1 - m)) / spread ELSE 0 END AS b FROM moments
), prior AS (
  SELECT m, CASE WHEN b <= 0 THEN 1e6 ELSE least(1e6, greatest(1.0, m * (1 - m) / b - 1)) END AS weight FROM betweens
), verdicts AS (
  SELECT source, (k + m * weight) / (n + weight) > 0.5 AS host_failed FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failed AS kept
FROM failing JOIN verdicts ON failing.source IS NOT DISTINCT FROM verdicts.source
"""


@query("op8_quality_rules", _OP8_SQL)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = quality_rules.host_quality(common.table(spark, sf_dir, "documents"))
    return rated.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _op4_sql() -> str:
    """Each kind's matches and the pieces between them; lengths of both place the matches."""
    kinds = [(i, *kind) for i, kind in enumerate((*secret_scan.KINDS, secret_scan.LOOSE))]
    quoted = {name: pattern.replace("'", "''") for _, name, pattern, _, _ in kinds}
    blank = "t"
    for _, name, _, _, _ in kinds[:-1]:
        pieces = f"string_split_regex({blank}, '{quoted[name]}')"
        whole = f"list_append(regexp_extract_all({blank}, '{quoted[name]}', 0), '')"
        blank = f"array_to_string(list_transform(list_zip({pieces}, {whole}), lambda z: z[1] || repeat(' ', length(z[2]))), '')"
    parts = []
    for i, name, _, group, least in kinds:
        text = blank if i == len(kinds) - 1 else "t"
        mixed = "AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')"
        parts.append(
            f"""SELECT doc_id, owner, {i} AS kind, '{name}' AS name, start, start + length(whole) AS stop, value FROM (
            SELECT doc_id, owner, m[j] AS whole, g[j] AS value,
                   list_sum(list_transform(b[1:j], lambda x: length(x)))
                   + coalesce(list_sum(list_transform(m[1:j - 1], lambda x: length(x))), 0) AS start
            FROM (SELECT *, unnest(range(1, len(m) + 1)) AS j FROM (
              SELECT doc_id, owner, regexp_extract_all(x, '{quoted[name]}', 0) AS m,
                     regexp_extract_all(x, '{quoted[name]}', {group}) AS g, string_split_regex(x, '{quoted[name]}') AS b
              FROM (SELECT doc_id, owner, {text} AS x FROM d))))
            WHERE length(value) >= {least} {mixed if i == len(kinds) - 1 else ""}"""
        )
    span = "name || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, source AS owner, coalesce(text, '') AS t FROM documents),
found AS ({" UNION ALL ".join(parts)}),
places AS (SELECT DISTINCT value, owner, doc_id FROM found),
owners AS (SELECT value, count(DISTINCT coalesce(owner, chr(0))) AS n, count(*) AS repos FROM places GROUP BY value),
spans AS (SELECT found.*, n <= 2 AND repos <= 10 * n AS live FROM found JOIN owners USING (value)),
made AS (
  SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
         count(*) FILTER (WHERE kind = 2) AS n_hex,
         string_agg({span}, ',' ORDER BY start, kind) FILTER (WHERE kind < 3) AS base,
         string_agg({span}, ',' ORDER BY start, kind) FILTER (WHERE kind < 3 OR live) AS spans,
         count(*) FILTER (WHERE live) AS n_live
  FROM spans GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN made USING (doc_id)
"""


@query("op4_secret_scan", _op4_sql())
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = secret_scan.scan(docs, keep_text=False)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.span_text(F.col("base_spans")), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("all_spans")).alias("spans"),
        F.size(F.filter("all_spans", lambda s: s["live"])).cast("bigint").alias("n_live"),
    )


@query("op3_simhash_dedup")
def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    rated = toxicity.rate(docs, common.table(spark, sf_dir, "labels"))
    return rated.select(
        "doc_id", (common.id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"),
        F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"),
    )


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(common.table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return packing.pack(cut)


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER))
    return token_files.read(spark, path)


@query("op10_lm_score")
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(common.table(spark, sf_dir, "documents"))


@query("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_text(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select(
        "page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("bigint").alias("n_chars")
    )


_OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scores
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


@query("op5_bitsliced_topk", _OP5_SQL)
def op5_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return bitsliced_topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


@query("op2_source_mixing")
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(mixing.mix(common.table(spark, sf_dir, "documents")))


_OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), sizes AS (
  SELECT doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0
), totals AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY doc_id, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals
), asked AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
), scores AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scores WHERE score > 0
)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM ranked WHERE r <= 10
"""


@query("op13_ranked_search", _OP13_SQL)
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search.top_documents(docs, common.table(spark, sf_dir, "benchmark"), k=10)


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    # a sum of squares beyond a long (from some millions of rows on) has no value in this column; the operator gives it whole
    deviation = F.col("deviation").try_cast("bigint").alias("deviation")
    return white.select(F.col("id").alias("vec_id"), "component", "n", deviation, "whitened", "explained", "identity_error")


@query("op12_chat_windows")
def op12_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    path = scratch_path(spark, "chat-windows")
    chat_windows.windows(held.unionByName(more), public_tokenizers.path(TOKENIZER)).write.parquet(path)
    return chat_windows.read_back(spark.read.parquet(path))
