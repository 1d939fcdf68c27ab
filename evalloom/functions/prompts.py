"""Follow-up prompt texts, built as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalloom import dims
from evalloom.functions import text as tx


def fill(template: str, **values: Column) -> Column:
    """Put columns into a ``{name}`` template."""
    pieces: list[Column] = []
    rest = template
    while rest:
        at = min((rest.find("{" + n + "}") for n in values if "{" + n + "}" in rest), default=-1)
        if at < 0:
            pieces.append(F.lit(rest))
            break
        if at:
            pieces.append(F.lit(rest[:at]))
        name = rest[at + 1 : rest.index("}", at)]
        pieces.append(values[name])
        rest = rest[at + len(name) + 2 :]
    return F.concat(*pieces)


def verify(task: Column, question: Column, answer: Column) -> Column:
    """Second-look prompt; null without a first answer, since there is nothing to check."""
    levels = fill(dims.VERIFY_LEVELS_PROMPT, question=question, answer=answer)
    other = fill(dims.VERIFY_PROMPT, question=question, answer=answer)
    return F.when(task == "hierarchy_depth", levels).otherwise(other)


def check_consensus(question: Column, answer: Column) -> Column:
    return fill(dims.CONSENSUS_PROMPT, question=question, answer=answer)


def numbered(items: Column, label: str) -> Column:
    """``label 1: first``, one line each."""
    return F.array_join(
        F.transform(
            items,
            lambda item, i: F.concat(F.lit(label + " "), (i + 1).cast("string"), F.lit(": "), item),
        ),
        "\n",
    )


def decompose_final(question: Column, observations: Column) -> Column:
    return fill(
        dims.DECOMPOSE_PROMPT, question=question, history=numbered(observations, "Observation")
    )


def refine(task: Column, question: Column, answers: Column) -> Column:
    """Next refinement round: the answers so far and the task's critique."""
    critique = tx.lookup(task, dims.CRITIQUES, dims.DEFAULT_CRITIQUE)
    return fill(
        dims.REFINE_PROMPT,
        rounds=F.array_size(answers).cast("string"),
        question=question,
        history=numbered(answers, "  Round"),
        critique=critique,
    )


def sketch(question: Column, findings: Column, round_number: Column) -> Column:
    """Sketchpad prompt from findings ``array<struct<question, steps, text>>``."""
    listed = F.array_join(
        F.transform(
            findings,
            lambda f, i: F.concat(
                F.lit("\nSub-Q"), (i + 1).cast("string"), F.lit(": "), f["question"],
                F.lit("\n  Primitives used: "), f["steps"],
                F.lit("\n  Findings: "), f["text"], F.lit("\n"),
            ),
        ),
        "",
    )
    return fill(
        dims.SKETCH_PROMPT,
        round=round_number.cast("string"), history=listed, question=question,
        menu=F.lit(dims.SKETCH_TOOL_MENU),
    )
