"""Rules on the text of a document, and verdicts on whole hosts from their documents' failures.

Everything here is built-in Spark functions. A document fails when it is short or when
most of its words lie in repeated three-word windows. Failures are summed per host, each
host's rate is drawn towards the common rate by a beta prior fitted to all hosts by
moments, and a host whose shrunken rate is too high is rejected with all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.llm import common
from evalloom.operators.columns import with_fields
from evalloom.storage import stored

#: Up to so many repeated windows are looked up one after the other; more are searched by halving.
SCANNED = 16


def _windows(words: Column, n: Column) -> Column:
    """A 64-bit hash of each three-word window, in order."""
    made = F.transform(
        F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    return F.when(n >= 3, made).otherwise(F.array().cast("array<bigint>"))


def _repeated(sorted_hashes: Column) -> Column:
    """The values found twice or more, ascending."""
    again = F.filter(sorted_hashes, lambda x, i: (i > 0) & (x == F.get(sorted_hashes, i - 1)))
    return F.array_distinct(again)


def _is_in(values: Column, steps: Column, x: Column) -> Column:
    """Whether ascending ``values`` hold x; ``steps`` halvings find the last value not above x."""
    further = lambda pos, k: pos + F.call_function("shiftleft", F.lit(1), k)
    at = F.aggregate(
        F.sequence(steps, F.lit(0)),
        F.lit(0),
        lambda pos, k: F.when(F.get(values, further(pos, k)) <= x, further(pos, k)).otherwise(pos),
    )
    return F.get(values, at) == x


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Counts per document: ``doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``.

    A null text has no words. Windows are compared by a 64-bit hash of their three words.
    Rows with equal ids are rated one by one, and other columns of ``docs`` are ignored.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    df = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        common.column_or_null(docs, host_col, "string").cast("string").alias("host"),
        F.col(f"`{text_col}`").alias("_text"),
    )
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(common.SPACE)) != "")
    df = with_fields(df, _words=common.words(text), _lines=lines)
    bare = F.translate(text, common.SPACE, "")
    df = with_fields(
        df,
        n_words=F.size("_words"),
        word_chars=F.char_length(bare).cast("bigint"),
        n_symbols=(F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", ""))).cast("bigint"),
        n_dup_lines=(F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        _hashes=_windows(F.col("_words"), F.size("_words")),
    ).drop("_words", "_lines", "_text")
    df = with_fields(df, _sorted=F.sort_array("_hashes"))
    df = with_fields(df, _twice=_repeated(F.col("_sorted"))).drop("_sorted")
    found = F.size("_twice")
    steps = F.ceil(F.log2(F.greatest(found, F.lit(2)))).cast("int")
    df = with_fields(
        df,
        _flags=F.when(found == 0, F.array().cast("array<boolean>"))
        .when(found <= SCANNED, F.transform("_hashes", lambda x: F.array_contains("_twice", x)))
        .otherwise(F.transform("_hashes", lambda x: _is_in(F.col("_twice"), steps, x))),
    ).drop("_hashes", "_twice")
    hit = lambda i: F.coalesce(F.get("_flags", i), F.lit(False))
    covered = F.size(
        F.filter(F.sequence(F.lit(0), F.col("n_words") - 1), lambda i: hit(i) | hit(i - 1) | hit(i - 2))
    )
    df = with_fields(df, n_repeat_words=F.when(F.size("_flags") == 0, F.lit(0)).otherwise(covered).cast("bigint"))
    return df.select(
        "doc_id", "host", F.col("n_words").cast("bigint").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def host_rates(rules: DataFrame) -> DataFrame:
    """``host, n_docs, n_failed``: one row per host (null is a host of its own), summed before the shuffle."""
    return rules.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("bigint")).alias("n_failed")
    )


def beta_prior(rates: DataFrame) -> tuple[float, float]:
    """Alpha and beta of the prior, by the moments of the hosts' rates.

    The mean is weighed by documents; the variance between hosts is what is left of the
    weighted variance after the binomial noise expected within hosts. Without hosts, or
    without variance between them, the prior is a firm one of 1,000,000 documents.
    """
    sums = rates.agg(
        F.sum("n_docs").alias("n"), F.sum("n_failed").alias("k"), F.count(F.lit(1)).alias("hosts"),
        F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("kk"),
        F.sum(F.col("n_docs") * F.col("n_docs")).alias("nn"),
    ).first()
    if not sums["n"]:
        return 1.0, 1.0
    n, mean = float(sums["n"]), sums["k"] / sums["n"]
    scatter = sums["kk"] - n * mean * mean
    spread = n - sums["nn"] / n
    noise = (sums["hosts"] - 1) * mean * (1 - mean)
    between = (scatter - noise) / spread if spread > 0 else 0.0
    weight = 1e6 if between <= 0 else min(1e6, max(1.0, mean * (1 - mean) / between - 1))
    return max(mean * weight, 1e-9), max((1 - mean) * weight, 1e-9)


def host_quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5
) -> DataFrame:
    """``document_rules`` with ``host_rate``, ``host_failed`` and ``kept``.

    ``host_rate`` is (failed + alpha) / (documents + alpha + beta); a host above
    ``max_rate`` fails, and with it every document of it. The text is read once: the counts
    are stored, summed per host, and joined with the hosts' verdicts. An empty table
    gives an empty result.
    """
    rules = stored(document_rules(docs, id_col, text_col, host_col), "quality-rules")
    rates = stored(host_rates(rules), "host-rates")
    alpha, beta = beta_prior(rates)
    rate = (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
    verdicts = rates.select(F.col("host").alias("_host"), rate.alias("host_rate"), (rate > max_rate).alias("host_failed"))
    return (
        rules.join(verdicts, rules["host"].eqNullSafe(verdicts["_host"]), "left").drop("_host")
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
    )
