"""Secrets in texts, told apart from published examples by who owns their copies.

Everything here is built-in Spark functions. Patterns find candidates in each whole text.
The corpus then says what each value is: a hash of it is counted over distinct
repositories and owners. A value that many owners carry is an example that was copied
around, and so is one that its owners repeat over and over; a value in few places of one or a
few owners looks live. Loose candidates (long mixed-case
tokens that no pattern names) are added only when they look live.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.functions.text import let
from evalloom.llm import common
from evalloom.operators.columns import with_fields
from evalloom.storage import stored

#: Kind, pattern, group of the value, least length of the value. A listed order breaks ties of start.
KINDS = (
    (
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Loose candidates, searched where no pattern above has matched.
LOOSE = ("token", r"[A-Za-z0-9_-]{24,}", 0, 24)
MIXED = r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9])"
SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"


#: Running values are taken inside blocks of so many elements, and over the blocks.
BLOCK = 256
#: A text is cut into stretches of so many code points, so that a piece is found without a walk from the start.
STRETCH = 4_096


def _running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For every integer of a non-empty array what ``combine`` makes of those before it, from 0, and of all at the end.

    ``combine`` is associative and leaves other values as they are when it meets 0. An array that grows by one is
    copied each time, so it grows within a block only.
    """
    none = F.array().cast("array<int>")

    def inside(part: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(
            part, first,
            lambda done, v: F.struct(combine(done["at"], v).alias("at"), F.concat(done["out"], F.array(done["at"])).alias("out")),
        )

    def step(done: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda v: combine(done["at"], v))
        return F.struct(combine(done["at"], block["at"]).alias("at"), F.concat(done["out"], F.array(moved)).alias("out"))

    def whole(bound: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(bound) - 1) / BLOCK).cast("int"))
        blocks = F.transform(starts, lambda b: inside(F.slice(bound, b * BLOCK + 1, F.lit(BLOCK))))
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
        return F.aggregate(blocks, first, step, lambda done: F.concat(F.flatten(done["out"]), F.array(done["at"])))

    return let(values, whole)


def _found(text: Column, number: int, kind: tuple) -> Column:
    """Spans of one kind, by start; offsets are code points and ends are exclusive.

    The pieces between matches and the matches themselves alternate, so running sums of
    their lengths place every match.
    """
    _, pattern, group, least = kind
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
        F.split(text, pattern, -1).alias("between"),
    )

    def placed(f: Column) -> Column:
        steps = F.transform(f["whole"], lambda w, i: F.char_length(F.get(f["between"], i)) + F.char_length(w))

        def spans(ends: Column) -> Column:  # where each match ends; in front of them, 0
            made = F.transform(
                f["whole"],
                lambda w, i: F.struct(
                    (F.get(ends, i + 1) - F.char_length(w)).alias("start"), F.lit(number).alias("kind"),
                    F.get(ends, i + 1).alias("end"), F.get(f["value"], i).alias("value"),
                ),
            )
            return F.filter(made, lambda s: F.char_length(s["value"]) >= least)

        return let(_running(steps, lambda a, b: a + b), spans)

    return F.when(text.rlike(pattern), let(found, placed)).otherwise(F.array().cast(SPAN))


def _blanked(text: Column, pattern: str) -> Column:
    """The text with every match replaced by as many spaces."""
    whole = F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
    pieces = F.zip_with(
        F.split(text, pattern, -1), whole, lambda a, b: F.concat(a, F.repeat(F.lit(" "), F.char_length(b)))
    )
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_base`` and ``_loose``: arrays of (start, kind, end, value), by start and kind.

    A null text is empty. Loose candidates hold upper and lower case and a digit, and do
    not touch a match of the patterns.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = F.array_sort(F.concat(*[_found(text, i, kind) for i, kind in enumerate(KINDS)]))
    blank = text
    for _, pattern, _, _ in KINDS:
        blank = _blanked(blank, pattern)
    df = with_fields(docs, _base=base, _blank=F.when(text.rlike(LOOSE[1]), blank).otherwise(F.lit("")))
    loose = F.filter(_found(F.col("_blank"), len(KINDS), LOOSE), lambda s: s["value"].rlike(MIXED))
    return with_fields(df, _loose=loose).drop("_blank")


def ownership(found: DataFrame) -> DataFrame:
    """``hash, n_repos, n_owners`` of every candidate value of ``found`` (hash, owner, repo).

    Counted level by level - distinct copies, then repositories of an owner, then owners -
    so that each sum is combined before its shuffle and a value held by a third of all
    documents meets no single task. A null owner or repository counts as one.
    """
    each = found.select("hash", "owner", "repo").distinct()
    owned = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return owned.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def scan(
    docs: DataFrame,
    text_col: str = "text",
    owner_col: str = "source",
    repo_col: str = "doc_id",
    max_owners: int = 2,
    max_repos: int = 10,
    keep_text: bool = True,
    names: tuple[str, str] = ("base_spans", "all_spans"),
) -> DataFrame:
    """``docs`` with ``base_spans`` and ``all_spans`` (or other ``names``): arrays of (start, kind, end, live).

    A span is live when at most ``max_owners`` owners hold its value, in at most ``max_repos`` repositories an
    owner on average; ``all_spans`` adds the live loose ones to the base spans. Columns of ``docs`` with these names are
    replaced; repeated rows are scanned one by one. Only documents with candidates are
    shuffled. They are stored, and the others, if their texts are kept, are scanned again in
    the end rather than copied; with ``keep_text=False`` all are stored without their texts.
    """
    docs = docs.drop(*names, "_row", "_base", "_loose", "_owner", "_repo", "_key", "_spans")
    kept = docs.columns
    scanned = candidates(
        docs.withColumn("_owner", common.column_or_null(docs, owner_col, "string").cast("string"))
        .withColumn("_repo", common.column_or_null(docs, repo_col, "string").cast("string"))
        .withColumn("_row", F.monotonically_increasing_id()),
        text_col,
    )
    holds = (F.size("_base") > 0) | (F.size("_loose") > 0)
    if keep_text:
        plain = scanned.where(~holds)
        scanned = stored(scanned.where(holds), "secret-candidates")
    else:
        kept = [c for c in kept if c != text_col]
        scanned = stored(scanned.drop(text_col), "secret-candidates")
        plain = scanned.where(~holds)
    each = (
        scanned.where(holds)
        .select("_row", F.col("_owner").alias("owner"), F.col("_repo").alias("repo"), F.inline(F.concat("_base", "_loose")))
        .withColumn("hash", F.sha2("value", 256))
        .drop("value")
    )
    counts = stored(ownership(each), "secret-owners")
    live = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos * F.col("n_owners"))
    spans = (
        each.join(counts.select(F.col("hash").alias("_hash"), live.alias("live")), F.col("hash") == F.col("_hash"))
        .groupBy(F.col("_row").alias("_key"))
        .agg(
            F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("_spans")
        )
    )
    kind = "array<struct<start:int,kind:int,end:int,live:boolean>>"
    with_any = (
        scanned.where(holds).drop("_base", "_loose").join(spans, F.col("_row") == F.col("_key"))
        .select(
            *[F.col(f"`{c}`") for c in kept],
            F.filter("_spans", lambda s: s["kind"] < len(KINDS)).alias(names[0]),
            F.filter("_spans", lambda s: (s["kind"] < len(KINDS)) | s["live"]).alias(names[1]),
        )
    )
    none = F.array().cast(kind)
    without = plain.select(*[F.col(f"`{c}`") for c in kept], none.alias(names[0]), none.alias(names[1]))
    return without.unionByName(with_any)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k[0]) for k in (*KINDS, LOOSE)])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (sorted by start) replaced by a mark; overlapping spans by one. Empty spans: the text."""

    def masked(t: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            first = F.floor(start / STRETCH).cast("int")
            near = F.array_join(F.slice(t["stretches"], first + 1, F.floor(end / STRETCH).cast("int") - first + 1), "")
            return F.when(end > start, F.substring(near, start - first * STRETCH + 1, end - start)).otherwise(F.lit(""))

        def pieces(before: Column) -> Column:  # how far the spans before each one reach, and all of them
            made = F.transform(
                t["spans"],
                lambda s, i: F.when(
                    s["start"] >= F.get(before, i), F.concat(piece(F.get(before, i), s["start"]), F.lit(mark))
                ),
            )
            rest = piece(F.element_at(before, -1), t["length"])
            return F.concat(F.array_join(made, ""), rest)  # what is null, inside an earlier span, is left out

        reach = _running(F.transform(t["spans"], lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        return let(reach, pieces)

    cut = F.struct(
        F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{STRETCH}}}"), F.lit(0)).alias("stretches"),
        F.char_length(text).alias("length"), spans.alias("spans"),
    )
    return F.when(F.size(spans) == 0, text).otherwise(let(cut, masked))
