"""Directives in model replies, code blocks, and prompt planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom import dims
from evalloom.functions import text as tx

# --- fixed values: directive patterns ------------------------------------------
TOOL_CALL = r"(?U)TOOL\((\w+)(?:,\s*(.+?))?\)"
ANSWER_TEXT = r"(?sU)ANSWER\s*[:]?\s*(.+)"
FENCED_CODE = r"(?sU)```(?:python)?\s*\n(.*?)```"
# -------------------------------------------------------------------------------


def _unquote(text: Column) -> Column:
    return tx.strip_chars(tx.strip_chars(tx.strip(text), '"'), "'")


def directive(response: Column) -> Column:
    """Struct ``(action, value, args)``: a tool call, an answer, or the whole text.

    ``args`` maps argument names to values; a bare value is given the name its tool
    expects.
    """
    tool = tx.first_match(response, TOOL_CALL, 1)
    raw_args = _unquote(tx.first_match(response, TOOL_CALL, 2))
    pairs = F.transform(
        F.split(raw_args, ","),
        lambda part: F.struct(
            _unquote(F.substring_index(part, "=", 1)).alias("key"),
            _unquote(F.regexp_replace(part, r"^[^=]*=?", "")).alias("value"),
        ),
    )
    # a repeated name keeps its last value
    distinct = tx.let(
        pairs,
        lambda ps: F.filter(
            ps,
            lambda p, i: ~F.array_contains(
                F.transform(F.slice(ps, i + 2, F.array_size(ps)), lambda q: q["key"]), p["key"]
            ),
        ),
    )
    bare_name = tx.lookup(tool, dims.POSITIONAL_ARGUMENTS, "arg")
    args = (
        F.when(raw_args.isNull() | (raw_args == ""), F.create_map().cast("map<string,string>"))
        .when(F.contains(raw_args, F.lit("=")), F.map_from_entries(distinct))
        .otherwise(F.create_map(bare_name, raw_args))
    )
    answer = tx.strip(tx.first_match(response, ANSWER_TEXT))
    return F.struct(
        F.when(tool.isNotNull(), "tool").when(answer.isNotNull(), "answer")
        .otherwise("unknown").alias("action"),
        F.coalesce(tool, answer, tx.strip(response)).alias("value"),
        F.when(tool.isNotNull(), args).alias("args"),
    )


def code_text(response: Column) -> Column:
    """The first fenced code block, else the whole text."""
    fenced = tx.strip(F.regexp_extract(response, FENCED_CODE, 1))
    return F.when(tx.has(response, FENCED_CODE), fenced).otherwise(tx.strip(response))


def plan(prompt: Column, task: Column) -> Column:
    """Struct ``(category, steps)``: the task's own plan, else the first keyword rule."""
    lowered = F.lower(prompt)

    def entry(category: str, steps: str) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(steps).alias("steps"))

    chain: Column | None = None
    for name, steps in dims.TASK_PLANS.items():
        value = entry("task:" + name, steps)
        chain = F.when(task == name, value) if chain is None else chain.when(task == name, value)
    for pattern, category, steps in dims.PLAN_RULES:
        chain = chain.when(tx.has(lowered, "(?U)" + pattern), entry(category, steps))
    return chain.otherwise(entry(*dims.FALLBACK_PLAN))


def sub_questions(prompt: Column, task: Column) -> Column:
    """The task's fixed split, else the parts around the word *and* of a question."""
    lowered = F.lower(prompt)
    parts = F.filter(
        F.transform(F.split(prompt, r"(?iU)\band\b"), tx.strip), lambda p: F.length(p) > 10
    )
    asked = F.transform(parts, lambda p: F.concat(F.rtrim(p, F.lit("?")), F.lit("?")))
    splits = (
        F.contains(lowered, F.lit(" and "))
        & F.contains(prompt, F.lit("?"))
        & tx.has(prompt, r"(?iU)\band\b")
    )
    chain: Column | None = None
    for name, questions in dims.QUESTION_SPLITS.items():
        value = F.array(*[F.lit(q) for q in questions])
        chain = F.when(task == name, value) if chain is None else chain.when(task == name, value)
    return chain.when(splits, asked).otherwise(F.array(prompt))


def explode_questions(prompts: DataFrame) -> DataFrame:
    """One row per sub-question, numbered from 1."""
    return prompts.select(
        "sample_id", "task_name",
        F.posexplode(sub_questions(F.col("prompt"), F.col("task_name"))).alias("i", "question"),
    ).select("sample_id", "task_name", (F.col("i") + 1).alias("number"), "question")
