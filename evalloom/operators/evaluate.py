"""From manifests and raw responses to scored results."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalloom.batches import Batches
from evalloom.functions import scoring, text as tx
from evalloom.functions.extract import PARSERS, ColumnParser, parse_by_name
from evalloom.operators.columns import remembered, with_fields, with_struct
from evalloom.storage import scratch_path


def _answer(responses: DataFrame, registry: dict[str, ColumnParser] | None) -> Column:
    def build() -> Column:
        return parse_by_name(F.col("parser"), F.col("raw_response"), registry)

    return remembered(responses, ("answer", *PARSERS.items()), build) if registry is None else build()


def extract_answers(
    responses: DataFrame, registry: dict[str, ColumnParser] | None = None
) -> DataFrame:
    """Add ``parsed_answer`` using the parser each row names."""
    return with_fields(responses, parsed_answer=_answer(responses, registry))


def score_answers(
    answers: DataFrame, registry: dict[str, scoring.ColumnScorer] | None = None
) -> DataFrame:
    """Add the score fields using the scorer each row names."""
    def build() -> Column:
        return scoring.score_by_name(F.col("scorer"), F.col("parsed_answer"), F.col("ground_truth"), registry)

    # what is registered may change; registries of a call's own are not kept
    key = ("score", *scoring.SCORERS.items())
    fields = remembered(answers, key, build) if registry is None else build()
    return with_struct(answers, fields, list(scoring.SCORE_FIELDS))


def evaluate(
    responses: DataFrame,
    parsers: dict[str, ColumnParser] | None = None,
    scorers: dict[str, scoring.ColumnScorer] | None = None,
) -> DataFrame:
    """Extract and score. Rows that cannot be judged carry an ``error_message``.

    ``parsers`` and ``scorers`` are used in place of the registered ones where they are given.
    """
    problem = (
        F.when(F.col("raw_response").isNull(), "missing response")
        .when(F.col("ground_truth").isNull(), "missing ground truth")
    )
    answer = _answer(responses, parsers)
    judged = with_fields(
        responses, parsed_answer=F.when(problem.isNull(), answer), error_message=problem
    )
    return score_answers(judged, scorers)


def pending(manifest: DataFrame, completed: DataFrame) -> DataFrame:
    """Manifest rows that have no result yet (both sides are hashed on sample_id)."""
    done = completed.select("sample_id").distinct()
    return manifest.join(done.hint("merge"), "sample_id", "left_anti")  # files of ids look smaller than they are


def _with_errors(model: Callable[[pd.DataFrame], pd.DataFrame], names: list[str]):
    """The model over batches; where it raises on one, it is called on parts, and rows that fail alone become error rows.

    A part that goes well doubles the next, one that fails is halved and tried again: few failing
    rows cost few calls, and many do not cost a call for each row that is good.
    """

    def attempt(batch: pd.DataFrame) -> pd.DataFrame:
        try:
            return model(batch).assign(error_message=None)
        except Exception as error:  # noqa: BLE001  any failed call is a row of the result, not the end of the run
            failed = error
        made, ids, messages = [], [], []
        start, size = 0, max(1, len(batch) // 2)
        while start < len(batch):
            if len(batch) > 1:
                part = batch.iloc[start : start + size]
                try:
                    made.append(model(part))
                    start, size = start + len(part), size * 2
                    continue
                except Exception as error:  # noqa: BLE001
                    failed = error
                if len(part) > 1:
                    size = len(part) // 2
                    continue
            ids.append(batch["sample_id"].iloc[start])
            messages.append(f"{type(failed).__name__}: {failed}")
            start += 1
        good = [pd.concat(made).assign(error_message=None)] if made else []
        return pd.concat([*good, pd.DataFrame({"sample_id": ids, "error_message": messages})])

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = attempt(batch)
            yield made.reindex(columns=names).astype(object).where(lambda x: x.notna(), None)

    return call


def run_model(
    manifest: DataFrame,
    completed: DataFrame | None,
    model: Callable[[pd.DataFrame], pd.DataFrame],
    response_schema: T.StructType | str,
    rows_per_task: int = 2_000,
    n_rows: int | None = None,
) -> DataFrame:
    """Call a user function over the unfinished rows, a batch at a time.

    The function gets a pandas batch of manifest rows and returns rows of
    ``response_schema``, which ``error_message`` is added to: a call that raises gives a row with
    its message and no answer. Tasks hold ``rows_per_task`` rows, so that a lost one
    repeats little; how many run at once is up to the executors' cores. The backlog is counted
    for that, unless ``n_rows`` says how many rows there are.
    """
    todo = manifest if completed is None else pending(manifest, completed)
    schema = response_schema if isinstance(response_schema, T.StructType) else T.StructType.fromDDL(response_schema)
    fields = [f for f in schema.fields if f.name != "error_message"]
    schema = T.StructType([*fields, T.StructField("error_message", T.StringType())])
    tasks = max(1, -(-(todo.count() if n_rows is None else n_rows) // rows_per_task))
    return todo.repartition(tasks).mapInPandas(_with_errors(model, schema.names), schema)


#: Waves are run together so that there are about so many rounds, as long as a round has no more rows than this.
ROUNDS, ROUND_ROWS = 24, 2_000_000


def _rounds(notes: dict[str, dict]) -> list[tuple[str, dict]]:
    """The committed rounds in the order they were made, with what is noted of each of their waves."""
    made = []
    for name, note in notes.items():
        _, wave, _, run = name.split(".")
        if "waves" not in note:  # a wave of its own
            note = {"at": int(run), "waves": {wave: note}, "replaces": [int(wave)] if note["replaces"] else []}
        made.append((name, note | {"waves": {int(w): held for w, held in note["waves"].items()}}))
    return sorted(made, key=lambda x: (x[1]["at"], x[0]))


def _current(rounds: list[tuple[str, dict]]) -> dict[str, tuple[set[int], set[int]]]:
    """The rounds that hold the results: per name the waves it still holds, and those a later round has replaced."""
    kept: dict[str, tuple[set[int], set[int]]] = {}
    for name, note in rounds:
        for held, gone in kept.values():
            replaced = held & set(note["replaces"])
            held -= replaced
            gone |= replaced
        kept[name] = (set(note["waves"]), set())
    return {name: (held, gone) for name, (held, gone) in kept.items() if held}


def _wave(waves: int, id_type: str) -> Column:
    """The wave of a row; results are dealt as the manifest is, also where their ids are of another type."""
    return F.pmod(F.xxhash64(F.col("sample_id").cast(id_type)), F.lit(waves))


def _held(batches: Batches, current: dict[str, tuple[set[int], set[int]]], wave: Column) -> DataFrame | None:
    """The rows of these rounds without those of replaced waves; None where there are none."""
    whole = [name for name, (_, gone) in current.items() if not gone]
    parts = [batches.read(whole)] if whole else []
    parts += [batches.read([name]).where(~wave.isin(*gone)) for name, (_, gone) in current.items() if gone]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def read_run(spark: SparkSession, path: str) -> DataFrame | None:
    """The results of all committed waves of a run; None before the first."""
    batches = Batches(spark, path)
    rounds = _rounds(batches.notes("wave.*"))
    if not rounds:
        return None
    plan = batches.notes("plan")["plan"]
    return _held(batches, _current(rounds), _wave(plan["waves"], plan.get("id_type", "string")))


def run_to(
    manifest: DataFrame,
    path: str,
    model: Callable[[pd.DataFrame], pd.DataFrame],
    response_schema: T.StructType | str,
    rows_per_wave: int = 1_000_000,
    rows_per_task: int = 2_000,
    retry_errors: bool = False,
) -> DataFrame:
    """Run the model over the manifest rows that the run at ``path`` has no result for, and read all results.

    The manifest is dealt into waves of about ``rows_per_wave`` rows by a hash of ``sample_id``; their number
    is set by the first run into ``path``. Waves are run in rounds: one wave at a time while there are no more than
    ``ROUNDS`` of them, else neighbouring waves together, up to ``ROUND_ROWS`` rows, so that many small waves do not
    make as many jobs. A round is a batch (``batches``): its results lie in their own directory and count
    once its marker is written, so a run that breaks off keeps its finished rounds, and what it left of the
    broken one has no marker and is done again.

    The marker holds for each wave how many rows it was run for and a hash of their ids. A wave whose
    manifest rows are still the same is skipped without reading anything; for waves that have got new
    rows, the rounds that hold these waves are read. With ``retry_errors`` the rows of a wave that ended in an error
    are called again, and the wave's results are written anew with those that were good.
    """
    spark, batches = manifest.sparkSession, Batches(manifest.sparkSession, path)
    plan = batches.notes("plan")
    if not plan:
        if not batches.is_empty() and not batches.notes("wave.*"):
            raise ValueError(f"{path} holds something else than a run")
        id_type = manifest.schema["sample_id"].dataType.simpleString()
        batches.commit("plan", {"waves": max(1, -(-manifest.count() // rows_per_wave)), "id_type": id_type})
        plan = batches.notes("plan")
    waves = plan["plan"]["waves"]
    wave = _wave(waves, plan["plan"].get("id_type", "string"))
    dealt = manifest.withColumn("_wave", F.pmod(F.xxhash64("sample_id"), F.lit(waves)))
    prints = F.sum(F.xxhash64("sample_id", "_wave").cast("decimal(38,0)")).cast("string")
    found = {r["_wave"]: (r["n"], r["p"]) for r in dealt.groupBy("_wave").agg(F.count("*").alias("n"), prints.alias("p")).collect()}
    rounds = _rounds(batches.notes("wave.*"))
    last = {w: held for _, note in rounds for w, held in note["waves"].items()}
    taken, at = {name for name, _ in rounds}, max((note["at"] for _, note in rounds), default=-1)

    def is_done(w: int) -> bool:
        note = last.get(w)
        return note is not None and (note["rows"], note["ids"]) == found[w] and not (retry_errors and note["errors"])

    todo = sorted(w for w in found if not is_done(w))
    if todo:
        mean = max(1, sum(n for n, _ in found.values()) // len(found))
        width = max(1, min(-(-waves // ROUNDS), ROUND_ROWS // mean))
        queue, current = scratch_path(spark, "waves"), _current(rounds)
        asked = dealt if len(todo) == len(found) else dealt.where(F.col("_wave").isin(todo))
        asked.withColumn("_round", F.floor(F.col("_wave") / width)).drop("_wave").hint("rebalance", "_round").write.partitionBy("_round").parquet(queue)
    for number, group in groupby(todo, key=lambda w: w // width):
        group = list(group)
        rows = spark.read.schema(manifest.schema).parquet(f"{queue}/_round={number}")
        n_rows = sum(found[w][0] for w in group)
        done = _held(batches, {name: state for name, state in current.items() if not state[0].isdisjoint(group)}, wave)
        replaces = [w for w in group if retry_errors and w in last and last[w]["errors"]]
        good = done
        if replaces:
            again = wave.isin(*replaces)
            good = done.where(~again | F.col("error_message").isNull())
        made = run_model(rows, good, model, response_schema, rows_per_task, n_rows if done is None else None)
        name = next(n for i in range(len(taken) + 1) if (n := f"wave.{group[0]:06d}.run.{i:06d}") not in taken)
        batches.write(made.unionByName(good.where(again), allowMissingColumns=True) if replaces else made, name)
        failed = batches.read([name]).where("error_message IS NOT NULL").groupBy(wave.alias("_wave")).agg(F.count("*").alias("n"))
        errors = {r["_wave"]: r["n"] for r in failed.collect()}
        held = {}
        for w in group:
            before = last[w]["errors"] if w in last and w not in replaces else 0
            held[w] = {"rows": found[w][0], "ids": found[w][1], "errors": before + errors.get(w, 0)}
        at += 1
        batches.commit(name, {"at": at, "waves": held, "replaces": replaces})
        taken.add(name)
    made = read_run(spark, path)
    if made is None:  # an empty manifest: no wave has rows
        return run_model(manifest, None, model, response_schema, rows_per_task, 0)
    return made


def normalise_reasoning(results: DataFrame) -> DataFrame:
    """Missing ``reasoning_mode`` counts as false."""
    mode = (
        F.coalesce(F.col("reasoning_mode").cast("boolean"), F.lit(False))
        if "reasoning_mode" in results.columns
        else F.lit(False)
    )
    return results.withColumn("reasoning_mode", mode)


def without_reasoning(results: DataFrame) -> DataFrame:
    return results.where(~F.coalesce(F.col("reasoning_mode"), F.lit(False)))


def determinism(responses: DataFrame) -> DataFrame:
    """Per sample, whether all repeats gave one response.

    min = max replaces a distinct count: it is folded before the shuffle, so a sample
    repeated very often stays one small row per task.
    """
    return (
        responses.groupBy("sample_id", "task_name")
        .agg(
            F.count("*").alias("repeats"),
            F.coalesce(F.min("raw_response") == F.max("raw_response"), F.lit(True)).alias("_same"),
            F.count_if(F.col("raw_response").isNull()).alias("_nulls"),
        )
        .select(
            "sample_id", "task_name", "repeats",
            (F.col("_same") & F.col("_nulls").isin(0, F.col("repeats"))).alias("match"),
        )
    )


def determinism_rate(responses: DataFrame) -> DataFrame:
    return determinism(responses).agg(
        F.count_if("match").alias("n_match"),
        F.count("*").alias("n_total"),
        F.avg(F.col("match").cast("int")).alias("match_rate"),
    )


def trace(results: DataFrame) -> DataFrame:
    """Narrow projection of results for a trace log; thinking cut to 500 characters."""
    fixed = [
        "sample_id", "task_name", "prompt", "raw_response", "parsed_answer", "ground_truth",
        "correct", "score", "parser", "scorer", "latency_s", "input_tokens", "output_tokens",
    ]
    optional = [
        "precision", "recall", "error_message", "strategy", "strategy_n", "strategy_votes",
        "strategy_final_changed", "strategy_verify_confirmed", "strategy_passes",
        "strategy_findings", "strategy_sub_questions", "reasoning_mode",
    ]
    columns = [F.col(c) for c in fixed + optional if c in results.columns]
    if "thinking_text" in results.columns:
        columns.append(F.substring("thinking_text", 1, 500).alias("thinking_text"))
    return results.select(*columns)


def _shown(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit("?"))


def _percent(column: Column) -> Column:
    return F.concat(F.bround(column * 100).cast("int").cast("string"), F.lit("%"))


def trace_line(results: DataFrame) -> DataFrame:
    """One readable text block per result, without terminal colours."""
    raw = tx.shorten(tx.collapse(F.coalesce(F.col("raw_response"), F.lit(""))), 200)
    prompt = tx.shorten(tx.collapse(F.coalesce(F.col("prompt"), F.lit(""))), 120)
    thinking = tx.shorten(tx.collapse(F.col("thinking_text")), 150)
    verdict = F.when(F.coalesce(F.col("correct"), F.lit(False)), "CORRECT").otherwise("WRONG")
    detail = F.when(
        (F.col("scorer") == "set_match") & F.col("precision").isNotNull(),
        F.concat(
            F.lit("  (P="), _percent(F.col("precision")),
            F.lit(", R="), _percent(F.col("recall")), F.lit(")"),
        ),
    ).otherwise("")
    lines = F.concat_ws(
        "\n",
        F.concat(
            _shown(F.col("sample_id")), F.lit(" | "), _shown(F.col("task_name")),
            F.lit(" | "), verdict, detail,
        ),
        F.concat(F.lit("   Prompt:    "), prompt),
        F.when(F.length("thinking_text") > 0, F.concat(F.lit("   Thinking:  "), thinking)),
        F.concat(F.lit("   Response:  "), raw),
        F.concat(
            F.lit("   Parsed: "), F.coalesce(F.col("parsed_answer"), F.lit("None")),
            F.lit("  |  GT: "), _shown(F.col("ground_truth")),
            F.lit("  |  "), _shown(F.col("input_tokens")), F.lit("→"),
            _shown(F.col("output_tokens")), F.lit(" tok  |  "),
            _shown(F.col("latency_s")), F.lit("s"),
        ),
        F.when(
            F.length("error_message") > 0,
            F.concat(F.lit("   Error:     "), F.col("error_message")),
        ),
    )
    return results.select("sample_id", lines.alias("trace"))
