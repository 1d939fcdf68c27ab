"""Folding the attempts made on a sample into one answer.

The input is one row per model call (``schemas.ATTEMPTS`` plus ``parsed_answer``). A table
may hold the calls of several strategies and models: a fold groups by sample, strategy
and model, as far as these columns are there, and carries them through. Every row is
a call that was made and counts, repeated ones too; calls are ordered by ``attempt_idx``, equal
indexes by kind and content. The calls of one key meet in one array, which is as long as the
answers a fold reports; counts that need no order (``majority_vote``) are combined
before the shuffle instead.

The folds of this module are columns over that array (``ColumnFold``), so a table of many strategies is
read and gathered once, whatever the number of strategies in it: ``fold_all`` picks the
column by the row's strategy.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom import dims
from evalloom.functions import text as tx
from evalloom.functions.directives import code_text, directive
from evalloom.functions.extract import parse_by_name
from evalloom.operators.accuracy import TEXT_SUFFIX

KEY = ("sample_id", "strategy", "model")
_CALL = ["attempt_idx", "pass_kind", "parsed_answer", "raw_response", "latency_s", "input_tokens", "output_tokens", "task_name", "parser"]
#: Fields a fold may give, and their types.
FIELDS = {
    "raw_response": "string", "parsed_answer": "string", "latency_s": "double", "input_tokens": "bigint", "output_tokens": "bigint",
    "strategy_n": "int", "strategy_votes": "map<string,bigint>", "strategy_all_answers": "array<string>",
    "strategy_full_answer": "string", "strategy_crop_answers": "array<string>", "strategy_initial_answer": "string",
    "strategy_verify_response": "string", "strategy_verify_confirmed": "boolean", "strategy_final_changed": "boolean",
    "strategy_consensus": "string", "strategy_sub_responses": "array<struct<prompt:string,response:string>>", "strategy_steps": "int",
    "strategy_code": "string", "strategy_code_output": "string", "strategy_rounds": "int", "strategy_converged": "boolean",
    "strategy_passes": "int", "strategy_findings": "string", "strategy_sub_questions": "int",
}
_COMMON = ("raw_response", "parsed_answer", "latency_s", "input_tokens", "output_tokens")

Fold = Callable[[DataFrame], DataFrame]
FOLDS: dict[str, Fold] = {}


def register_fold(name: str, fold: Fold) -> None:
    """Make a strategy known to ``fold_all``; a later registration of a name replaces the earlier.

    A ``ColumnFold`` shares the one gathering of ``fold_all``; any other function over attempts gets
    the rows of its strategy and reads them by itself.
    """
    FOLDS[name] = fold


def _keys(attempts: DataFrame) -> list[str]:
    return [c for c in KEY if c in attempts.columns]


def _gather(attempts: DataFrame, extra: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per key with all its calls in order, and the task; columns that are not there are null.

    ``extra`` names further columns and the kinds of calls that carry them. Calls are dealt out by sample as they are and
    gathered behind the shuffle: gathered before it, a task sorts all calls it reads and spills them, and
    a sample's calls side by side compress to a fraction. A sample has few calls.
    """
    named = [F.col(c) if c in attempts.columns else F.lit(None).cast("string").alias(c) for c in _CALL if c != "task_name"]
    for c, kinds in (extra or {}).items():
        carried = F.when(F.col("pass_kind").isin(*kinds), F.col(c)) if c in attempts.columns else F.lit(None).cast("string")
        named.append(carried.alias(c))
    task = F.col("task_name") if "task_name" in attempts.columns else F.lit(None).cast("string")
    calls = attempts.select(*_keys(attempts), task.alias("task_name"), F.struct(*named).alias("_call")).repartition("sample_id")
    return calls.groupBy(*_keys(attempts)).agg(F.array_sort(F.collect_list("_call")).alias("_all"), F.min("task_name").alias("task_name"))


def _opened(gathered: DataFrame, made: Column, fields: tuple[str, ...], strategy: Column) -> DataFrame:
    """The key, the task and the fields of ``made`` where it is not null; made in one projection, which nothing copies."""
    carried = ["sample_id", "task_name", "strategy", *[c for c in ("model",) if c in gathered.columns]]
    staged = gathered.withColumn("strategy", strategy).select(*carried, made.alias("_made"))
    opened = staged.select(*carried, F.inline(F.array_compact(F.array("_made"))))
    return opened.select(*carried, *fields)


def result(**fields: Column) -> Column:
    """A struct of all ``FIELDS``; those not given are null."""
    return F.struct(*[(fields[n] if n in fields else F.lit(None)).cast(t).alias(n) for n, t in FIELDS.items()])


@dataclass(frozen=True)
class ColumnFold:
    """A fold as a column: from the ordered calls of a key and its task to a ``result``, or null where there is none.

    Called with attempts it gives a row per key with its own ``fields``. ``extra`` names further
    columns of the attempts, and the kinds of calls that carry them.
    """

    name: str
    made: Callable[[Column, Column], Column]
    fields: tuple[str, ...]
    extra: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __call__(self, attempts: DataFrame) -> DataFrame:
        gathered = _gather(attempts, self.extra)
        strategy = F.col("strategy") if "strategy" in gathered.columns else F.lit(self.name)
        return _opened(gathered, self.made(F.col("_all"), F.col("task_name")), self.fields, strategy)


def column_fold(*fields: str, **extra: tuple[str, ...]) -> Callable[[Callable[[Column, Column], Column]], ColumnFold]:
    """Registers a column function as the fold of its name, with these fields beside the common ones."""

    def keep(made: Callable[[Column, Column], Column]) -> ColumnFold:
        fold = ColumnFold(made.__name__, made, (*_COMMON, *fields), extra)
        register_fold(fold.name, fold)
        return fold

    return keep


def _of(calls: Column, kind: str) -> Column:
    """The calls of a kind, in order."""
    return F.filter(calls, lambda c: c["pass_kind"] == kind)


def _first(calls: Column, kind: str) -> Column:
    """The first call of a kind; null when there was none."""
    return F.get(_of(calls, kind), F.lit(0))


def _usage(calls: Column) -> dict[str, Column]:
    """Latency (2 decimals) and tokens summed over an array of calls."""

    def total(field: str, zero: Column) -> Column:
        return F.aggregate(
            calls, zero, lambda acc, c: acc + F.coalesce(c[field], zero)
        )

    return {
        "latency_s": F.round(total("latency_s", F.lit(0.0)), 2),
        "input_tokens": total("input_tokens", F.lit(0).cast("bigint")),
        "output_tokens": total("output_tokens", F.lit(0).cast("bigint")),
    }


def _answers(calls: Column) -> Column:
    return F.transform(calls, lambda c: c["parsed_answer"])


def _vote_counts(answers: Column) -> Column:
    def count(given: Column) -> Column:
        return F.transform(
            F.array_distinct(given),
            lambda a: F.struct(
                a.alias("answer"),
                F.array_size(F.filter(given, lambda b: b == a)).cast("bigint").alias("votes"),
            ),
        )

    return tx.let(F.array_compact(answers), count)


def vote(answers: Column) -> Column:
    """Most frequent non-null answer of an array; ties go to the first seen."""
    none = F.struct(F.lit(None).cast("string").alias("answer"), F.lit(0).cast("bigint").alias("votes"))
    return F.aggregate(
        _vote_counts(answers), none,
        lambda best, c: F.when(c["votes"] > best["votes"], c).otherwise(best),
    )["answer"]


def majority_vote(attempts: DataFrame) -> DataFrame:
    """Majority answer per key for any number of attempts.

    Counts are made per (key, answer) first, so votes are combined before both
    shuffles; ties go to the answer seen first.
    """
    keys = _keys(attempts)
    counts = attempts.groupBy(*keys, "parsed_answer").agg(
        F.count("*").alias("c"), F.min("attempt_idx").alias("first")
    )
    given = F.col("parsed_answer").isNotNull()
    best = F.max(F.when(given, F.struct("c", (-F.col("first")).alias("first"), "parsed_answer")))
    return counts.groupBy(*keys).agg(
        best["parsed_answer"].alias("parsed_answer"),
        F.coalesce(best["c"], F.lit(0)).alias("votes"),
        F.sum("c").alias("attempts"),
    )


@column_fold()
def baseline(calls: Column, task: Column) -> Column:
    """The first plain attempt."""
    return tx.let(
        _first(calls, "full"),
        lambda one: F.when(one.isNotNull(), result(**{f: one[f] for f in _COMMON})),
    )


def _consensus(calls: Column, body: Callable[[Column, Column, Column], Column]) -> Column:
    """``body`` of the samples taken, their majority answer and the first call that gave it; null without samples."""

    def voted(taken: Column, winner: Column) -> Column:
        # with no valid answer the first call matches, as every answer is null
        won = F.get(F.filter(taken, lambda c: c["parsed_answer"].eqNullSafe(winner)), F.lit(0))
        return tx.let(won, lambda w: body(taken, winner, w))

    return tx.let(
        _of(calls, "sample"),
        lambda taken: F.when(F.array_size(taken) > 0, tx.let(vote(_answers(taken)), lambda winner: voted(taken, winner))),
    )


@column_fold("strategy_n", "strategy_votes", "strategy_all_answers")
def best_of_n(calls: Column, task: Column) -> Column:
    """Majority vote over all samples taken, with votes and all answers."""
    return _consensus(
        calls,
        lambda taken, winner, won: result(
            raw_response=won["raw_response"], parsed_answer=winner, **_usage(taken), strategy_n=F.array_size(taken),
            strategy_votes=F.map_from_entries(_vote_counts(_answers(taken))), strategy_all_answers=_answers(taken),
        ),
    )


@column_fold("strategy_full_answer", "strategy_crop_answers", "strategy_all_answers")
def crop_zoom(calls: Column, task: Column) -> Column:
    """Whole picture and crops combined by the task's rule: a vote or the largest number."""

    def made(full: Column, crops: Column) -> Column:
        everything = F.concat(F.array(full), crops)
        return tx.let(everything, lambda seen: combined(full, crops, seen))

    def combined(full: Column, crops: Column, seen: Column) -> Column:
        answers = _answers(seen)
        rule = tx.lookup(task, dims.CROP_RULES, dims.DEFAULT_CROP_RULE)
        largest = F.array_max(F.transform(answers, tx.to_int)).cast("string")
        return result(
            raw_response=full["raw_response"],
            parsed_answer=F.when(rule == "max", F.coalesce(largest, full["parsed_answer"])).otherwise(vote(answers)),
            **_usage(seen), strategy_full_answer=full["parsed_answer"], strategy_crop_answers=_answers(crops),
            strategy_all_answers=answers,
        )

    return tx.let(
        _first(calls, "full"),
        lambda full: F.when(full.isNotNull(), tx.let(_of(calls, "crop"), lambda crops: made(full, crops))),
    )


def confirms(reply: Column) -> Column:
    """Whether a second look agrees (substring match, so *incorrect* agrees too)."""
    return tx.has(F.lower(reply), "|".join(dims.CONFIRM_WORDS))


def _second_look(first: Column, second: Column, body: Callable[[dict[str, Column]], Column]) -> Column:
    """``body`` of the final answer and whether it is confirmed and changed. Without a first answer nothing is looked at."""

    def final(confirmed: Column) -> Column:
        other = second["parsed_answer"].isNotNull() & ~confirmed
        answer = F.when(first.isNotNull(), F.when(other, second["parsed_answer"]).otherwise(first))
        return tx.let(
            answer, lambda a: body({"parsed_answer": a, "strategy_verify_confirmed": confirmed, "strategy_final_changed": a != first})
        )

    return tx.let(F.when(first.isNotNull(), confirms(second["raw_response"])), final)


@column_fold("strategy_initial_answer", "strategy_verify_response", "strategy_verify_confirmed", "strategy_final_changed")
def verify(calls: Column, task: Column) -> Column:
    """First answer, replaced when the second look gives another one and does not confirm."""

    def made(one: Column, two: Column) -> Column:
        first = one["parsed_answer"]
        used = F.when(first.isNotNull(), F.array_compact(F.array(one, two))).otherwise(F.array(one))
        return _second_look(
            first, two,
            lambda looked: result(
                raw_response=one["raw_response"], **looked, **_usage(used), strategy_initial_answer=first,
                strategy_verify_response=F.when(first.isNotNull(), two["raw_response"]),
            ),
        )

    return tx.let(
        _first(calls, "full"),
        lambda one: F.when(one.isNotNull(), tx.let(_first(calls, "verify"), lambda two: made(one, two))),
    )


@column_fold("strategy_consensus", "strategy_verify_confirmed", "strategy_final_changed")
def best_of_n_verify(calls: Column, task: Column) -> Column:
    """Majority vote over all samples taken, then a second look at the consensus."""

    def made(taken: Column, winner: Column, won: Column, two: Column) -> Column:
        used = F.when(winner.isNotNull(), F.concat(taken, F.array_compact(F.array(two)))).otherwise(taken)
        return _second_look(
            winner, two, lambda looked: result(raw_response=won["raw_response"], **looked, **_usage(used), strategy_consensus=winner)
        )

    return _consensus(
        calls, lambda taken, winner, won: tx.let(_first(calls, "verify"), lambda two: made(taken, winner, won, two))
    )


@column_fold("strategy_sub_responses", "strategy_steps", prompt=("sub",))
def decompose(calls: Column, task: Column) -> Column:
    """The final answer; for grid sizes a failed one is rebuilt from the line counts.

    The first two numbers among the sub-answers are line counts, one more than the cells.
    """

    def made(final: Column, subs: Column) -> Column:
        rows, cols = (tx.to_int(F.get(F.array_compact(_answers(subs)), F.lit(i))) - 1 for i in (0, 1))
        rebuilt = F.when(
            (task == "counting_grid") & (final["parser"] == "row_col") & (rows > 0) & (cols > 0),
            F.concat(rows.cast("string"), F.lit(","), cols.cast("string")),
        )
        return result(
            raw_response=final["raw_response"], parsed_answer=F.coalesce(final["parsed_answer"], rebuilt),
            **_usage(F.concat(subs, F.array(final))),
            strategy_sub_responses=F.transform(
                subs,
                lambda c: F.struct(
                    F.substring(c["prompt"], 1, 100).alias("prompt"),
                    F.substring(c["raw_response"], 1, 200).alias("response"),
                ),
            ),
            strategy_steps=F.array_size(subs) + 1,
        )

    return tx.let(
        _first(calls, "final"),
        lambda final: F.when(final.isNotNull(), tx.let(_of(calls, "sub"), lambda subs: made(final, subs))),
    )


@column_fold("strategy_code", "strategy_code_output", "strategy_steps")
def code_vision(calls: Column, task: Column) -> Column:
    """The final answer with the code and its output, each cut to 500 characters."""

    def made(final: Column, code: Column) -> Column:
        return result(
            raw_response=final["raw_response"], parsed_answer=final["parsed_answer"],
            **_usage(F.array_compact(F.array(code, final))),
            strategy_code=F.substring(code_text(code["raw_response"]), 1, 500),
            strategy_code_output=F.substring(_first(calls, "output")["raw_response"], 1, 500),
            strategy_steps=F.lit(3),
        )

    return tx.let(
        _first(calls, "final"),
        lambda final: F.when(final.isNotNull(), tx.let(_first(calls, "code"), lambda code: made(final, code))),
    )


def convergence_round(calls: Column) -> Column:
    """Number of rounds up to the first that repeats the round before; null if none does."""
    repeats = F.filter(
        F.sequence(F.lit(1), F.array_size(calls)),
        lambda i: (i > 1)
        & (F.get(calls, i - 1)["parsed_answer"] == F.get(calls, i - 2)["parsed_answer"]),
    )
    return F.get(repeats, F.lit(0))


def convergence(attempts: DataFrame) -> DataFrame:
    """The round in which each key's answers converged; keys that did not are left out."""
    gathered = _gather(attempts).withColumn("rounds", _of(F.col("_all"), "round"))
    at = convergence_round(F.col("rounds")).cast("bigint")
    return gathered.select(*_keys(attempts), at.alias("converged_round")).where(F.col("converged_round").isNotNull())


@column_fold("strategy_rounds", "strategy_all_answers", "strategy_converged")
def iterative_refine(calls: Column, task: Column) -> Column:
    """Rounds up to convergence; the answer is the last one that could be read."""

    def made(kept: Column, stop: Column) -> Column:
        answers = _answers(kept)
        return result(
            raw_response=F.try_element_at(kept, F.lit(-1))["raw_response"],
            parsed_answer=F.try_element_at(F.array_compact(answers), F.lit(-1)), **_usage(kept),
            strategy_rounds=F.array_size(kept), strategy_all_answers=answers, strategy_converged=stop.isNotNull(),
        )

    def stopped(rounds: Column, stop: Column) -> Column:
        return tx.let(F.slice(rounds, F.lit(1), F.coalesce(stop, F.array_size(rounds))), lambda kept: made(kept, stop))

    return tx.let(
        _of(calls, "round"),
        lambda rounds: F.when(F.array_size(rounds) > 0, tx.let(convergence_round(rounds), lambda stop: stopped(rounds, stop))),
    )


@column_fold("strategy_passes", "strategy_findings", "strategy_sub_questions", prompt=("plan",), findings=("plan", "pass"))
def sketchpad(calls: Column, task: Column) -> Column:
    """Passes up to the first that answers; a known tool call goes on to the next pass.

    Findings are a column of the calls (``findings``): calls of kind ``plan`` hold those made before the
    first pass, with the sub-question as ``prompt``, and a pass holds that of the tool it asked for.
    They are listed as ``[question] finding``, each finding cut to 100 characters and the
    list to 500, and ``strategy_sub_questions`` counts them.
    """
    known = lambda d: (d["action"] == "tool") & d["value"].isin(*dims.SKETCH_TOOLS)

    def ended(passes: Column, read: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.array_size(read)), lambda i: ~known(F.get(read, i - 1)))
        return tx.let(F.coalesce(F.get(ends, F.lit(0)), F.array_size(read)), lambda n: made(passes, read, n))

    def made(passes: Column, read: Column, n: Column) -> Column:
        last, used = F.get(read, n - 1), F.slice(passes, F.lit(1), n)
        said = F.when(last["action"].isin("answer", "unknown"), last["value"]).otherwise(F.get(passes, n - 1)["raw_response"])
        planned = F.transform(_of(calls, "plan"), lambda c: F.struct(F.coalesce(c["prompt"], F.lit("")).alias("q"), c["findings"].alias("f")))
        asked = F.transform(
            used, lambda c, i: F.struct(F.concat(F.lit("Model-requested (pass "), (i + 1).cast("string"), F.lit(")")).alias("q"), c["findings"].alias("f"))
        )
        found = F.filter(F.concat(planned, asked), lambda x: x["f"].isNotNull())
        listed = F.array_join(
            F.transform(found, lambda x: F.concat(F.lit("["), x["q"], F.lit("] "), F.substring(x["f"], 1, 100))), "; "
        )
        parser = F.array_min(F.transform(passes, lambda c: c["parser"]))
        return tx.let(
            said,
            lambda text: result(
                raw_response=text, parsed_answer=parse_by_name(parser, text), **_usage(used), strategy_passes=n + 1,
                strategy_findings=F.substring(listed, 1, 500), strategy_sub_questions=F.array_size(found),
            ),
        )

    return tx.let(
        _of(calls, "pass"),
        lambda passes: F.when(
            F.array_size(passes) > 0,
            tx.let(F.transform(passes, lambda c: directive(c["raw_response"])), lambda read: ended(passes, read)),
        ),
    )


def routed_strategy(task: Column) -> Column:
    """The strategy a task is sent to; a text control follows its base task."""
    base = F.regexp_replace(task, TEXT_SUFFIX + "$", "")
    return tx.lookup(base, dims.ROUTES, dims.DEFAULT_ROUTE)


def adaptive(strategy_results: DataFrame) -> DataFrame:
    """Keep, per sample, the row of the strategy its task is routed to.

    The route is computed on the row itself, so this is a filter and not a join.
    """
    route = routed_strategy(F.col("task_name"))
    return (
        strategy_results.where(F.col("strategy") == route)
        .withColumn("strategy_selected", F.col("strategy"))
        .withColumn("strategy", F.lit("adaptive"))
    )


def fold_all(attempts: DataFrame, folds: dict[str, Fold] | None = None) -> DataFrame:
    """Each strategy's calls folded by its own fold, in one table; fields a fold does not make are null.

    The attempts are read and gathered once for all column folds, and a row's result is made by
    the column of its strategy alone. A strategy without a fold fails the job, as leaving its samples
    out would go unseen.
    """
    folds = FOLDS if folds is None else folds
    columns = {name: fold for name, fold in folds.items() if isinstance(fold, ColumnFold)}
    others = {name: fold for name, fold in folds.items() if name not in columns}
    strategy = F.col("strategy")
    unknown = F.raise_error(F.concat(F.lit("no fold for strategy "), F.coalesce("strategy", F.lit("null"))))
    rest = attempts.where(~F.coalesce(strategy.isin(*others), F.lit(False))) if others else attempts
    if columns:
        extra: dict[str, tuple[str, ...]] = {}
        for fold in columns.values():
            for c, kinds in fold.extra.items():
                extra[c] = tuple(sorted({*extra.get(c, ()), *kinds}))
        gathered = _gather(rest, extra)
        made = None
        for name, fold in columns.items():
            one = fold.made(F.col("_all"), F.col("task_name"))
            made = F.when(strategy == name, one) if made is None else made.when(strategy == name, one)
        names = {f for fold in columns.values() for f in fold.fields}
        out = _opened(gathered, made.otherwise(unknown), tuple(f for f in FIELDS if f in names), strategy)
    else:
        out = rest.select("sample_id", unknown.cast("string").alias("strategy"))
    for name, fold in others.items():
        out = out.unionByName(fold(attempts.where(strategy == name)), allowMissingColumns=True)
    return out


def fold_routed(attempts: DataFrame, folds: dict[str, Fold] | None = None) -> DataFrame:
    """``adaptive`` from the calls themselves: only those of a task's routed strategy are folded."""
    return adaptive(fold_all(attempts.where(F.col("strategy") == routed_strategy(F.col("task_name"))), folds))
