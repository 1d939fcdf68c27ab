"""Conversations as training texts of bounded length: windows of whole turns with a loss mask.

Every turn is written by one template, ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a
line feed. Control strings inside roles and texts get a backslash after their first character (one
more, where some are there already), which ``unescaped`` takes out again.

A conversation becomes windows of at most ``budget`` tokens. Prefix sums of the turns' tokens give the
longest run of new turns that fits beside the system turn and the history; the history is the
longest run of turns before it within ``history`` tokens. System turn and history are repeated
in every window, but what an assistant says is under the loss mask only where it is new. A turn
that does not fit alone is never cut: its window holds it, the system turn and no history, and says so (``over``).

Turns are sorted over the cluster by ranges of conversation and turn, so prefix sums of a conversation
of any length are sums of a task's own turns plus the totals of the parts before. Such a
conversation is cut into chapters of ``CHAPTER`` budgets, windows start anew at each, and a
chapter's task sees its turns, the history before them and the system turn, no more.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalloom.llm.token_ids import encoder
from evalloom.storage import stored

#: Budgets of tokens in a chapter.
CHAPTER = 64
START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of this template and of others in use: a first character, and what may follow it.
_CONTROL = r"\|[a-z_]+\|>|/?s>|/?INST\]|</?SYS>>"
_RAW = re.compile(rf"([<\[])(\\*)(?={_CONTROL})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_CONTROL})")

TURNS = "conv_id long, turn long, role string, text string, tokens long, before long, part int"
WINDOWS = (
    "conv_id long, chapter long, window int, first_turn long, last_turn long, n_turns int, n_repeated int, "
    "repeated_chars int, tokens long, over boolean, formatted string, targets array<struct<start: int, stop: int>>"
)

#: Rows sent on at once.
_ROWS = 256
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("chapter", pa.int64()), ("window", pa.int32()), ("first_turn", pa.int64()), ("last_turn", pa.int64()),
    ("n_turns", pa.int32()), ("n_repeated", pa.int32()), ("repeated_chars", pa.int32()), ("tokens", pa.int64()), ("over", pa.bool_()),
    ("formatted", pa.string()), ("targets", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
])
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def escaped(text: str) -> str:
    """The text without control strings: each gets a backslash after its first character."""
    return _RAW.sub(r"\1\2\\", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def formatted_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """A turn by the template, and where its text starts and stops; null role and text are empty, a role's line feeds are written ``\\n``."""
    name = escaped((role or "").replace("\\", "\\\\").replace("\n", "\\n"))
    head, body = f"{START}{name}\n", escaped(text or "")
    return head + body + END, len(head), len(head) + len(body)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted text."""
    turns = []
    for piece in formatted.split(START)[1:]:
        name, _, body = piece.removesuffix(END).partition("\n")
        turns.append((re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(name)), unescaped(body)))
    return turns


def counted(conversations: DataFrame, tokenizer: str) -> DataFrame:
    """Turns in order with their tokens and, per range of the sort, the tokens of the conversation before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        current, before = None, 0
        for batch in batches:
            sizes, starts = [], []
            for conv, role, text in zip(*[batch.column(c).to_pylist() for c in (0, 2, 3)]):
                if (conv,) != current:
                    current, before = (conv,), 0
                size = len(encode(formatted_turn(role, text)[0])) // 4
                sizes.append(size)
                starts.append(before)
                before += size
            columns = [*batch.columns[:4], pa.array(sizes, pa.int64()), pa.array(starts, pa.int64()), pa.array([part] * len(sizes), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in TURNS.split(", ")])

    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"),
    ).withColumn("_h", F.xxhash64("role", "text"))
    ordered = turns.repartitionByRange("conv_id", "turn", "_h").sortWithinPartitions("conv_id", "turn", "_h", "role", "text")
    return ordered.drop("_h").mapInArrow(run, TURNS)


def placed(turns: DataFrame) -> DataFrame:
    """Adds to ``before`` the tokens of the conversation in earlier ranges.

    A range shares a conversation with the range before it at most once, so what is joined
    has no more rows than there are ranges, twice.
    """
    totals = turns.groupBy("conv_id", "part").agg(F.sum("tokens").alias("tokens"))
    several = totals.groupBy("conv_id").agg(F.count("*").alias("n"), F.collect_list(F.struct("part", "tokens")).alias("parts")).where("n > 1")
    earlier = several.select("conv_id", F.explode("parts").alias("p")).select("conv_id", "p.part", "p.tokens")
    sums = F.sum("tokens").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = earlier.select(F.col("conv_id").alias("_c"), F.col("part").alias("_p"), F.coalesce(sums, F.lit(0)).alias("_more"))
    same = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p"))
    return turns.join(F.broadcast(earlier), same, "left").withColumn("before", F.col("before") + F.coalesce("_more", F.lit(0))).drop("_c", "_p", "_more", "part")


def _windows(turns: list[dict], chapter: int, budget: int, history: int) -> Iterator[dict]:
    """The windows of one chapter. ``turns`` are its own and those before it that its first history may hold; a system turn comes first."""
    system = turns[0] if turns[0]["role"] == "system" and turns[0]["before"] == 0 else None
    body = turns[1:] if system else turns
    fixed = system["tokens"] if system else 0
    starts = [t["before"] for t in body] + ([body[-1]["before"] + body[-1]["tokens"]] if body else [])  # prefix sums
    at = next((i for i, t in enumerate(body) if t["chapter"] == chapter), len(body))
    number = 0
    while at < len(body) or (not body and system and not number):
        past = at
        while past and starts[at] - starts[past - 1] <= history:
            past -= 1
        stop = at
        while past < at and fixed + starts[at + 1] - starts[past] > budget:
            past += 1
        while stop < len(body) and (stop == at or fixed + starts[stop + 1] - starts[past] <= budget):
            stop += 1
        opening = bool(system) and system["chapter"] == chapter and number == 0  # the system turn is new in the first window
        text, targets, repeated = "", [], 0
        for i, turn in enumerate([*([system] if system else []), *body[past:stop]]):
            whole, a, b = formatted_turn(turn["role"], turn["text"])
            new = opening if system and i == 0 else past + i - bool(system) >= at
            if new and turn["role"] == "assistant":
                targets.append({"start": len(text) + a, "stop": len(text) + b})
            text += whole
            repeated = repeated if new else len(text)
        size = fixed + (starts[stop] - starts[past] if body else 0)
        new_turns = body[at:stop]
        shown = ([system] if opening else []) + new_turns
        yield {
            "chapter": chapter, "window": number, "first_turn": shown[0]["turn"], "last_turn": shown[-1]["turn"],
            "n_turns": len(shown), "n_repeated": at - past + (bool(system) and not opening), "repeated_chars": repeated,
            "tokens": size, "over": size > budget, "formatted": text, "targets": targets,
        }
        at, number = max(stop, at), number + 1


def windows(conversations: DataFrame, tokenizer: str, budget: int = 2048, history: int = 512) -> DataFrame:
    """``WINDOWS``: each conversation's windows, numbered by chapter and window.

    ``conversations`` has ``conv_id, turn, role, text``; other columns are not read. Rows go by turn, nulls
    first, equal turns by a hash of role and text; repeated rows are turns each. Null ids are one
    conversation, null texts and roles are empty. The first turn is the system turn if its role is
    ``system``; other system turns are turns like any. ``targets`` are the places, in code points, of
    what assistants newly say, and the first ``repeated_chars`` of a window are repeated.
    An empty table has no windows.
    """
    if not 0 <= history < budget:
        raise ValueError("history must be less than the budget")
    turns = placed(stored(counted(conversations, tokenizer), "chat-turns"))
    width = CHAPTER * budget
    own = turns.withColumn("chapter", F.floor(F.col("before") / width))
    # turns that end a chapter are history to the next; the system turn goes with every chapter
    tail = own.withColumn("seen", F.floor((F.col("before") + history) / width)).where("seen > chapter")
    later = own.where("chapter > 0").select("conv_id", F.col("chapter").alias("seen")).distinct()
    first = own.where("before = 0 AND role = 'system'").withColumnRenamed("conv_id", "_c")
    system = later.join(first, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    seen = own.withColumn("seen", F.col("chapter")).unionByName(tail).unionByName(system)
    columns = ["conv_id", "seen", "turn", "role", "text", "tokens", "before", "chapter"]
    dealt = seen.select(*columns).repartition("conv_id", "seen").sortWithinPartitions("conv_id", "seen", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, made = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["conv_id"], row["seen"]) != current:
                    if held:
                        made += [{"conv_id": current[0], **w} for w in _windows(held, current[1], budget, history)]
                    current, held = (row["conv_id"], row["seen"]), []
                    if len(made) >= _ROWS:
                        yield pa.RecordBatch.from_pylist(made, schema=_ARROW)
                        made = []
                held.append(row)
        if held:
            made += [{"conv_id": current[0], **w} for w in _windows(held, current[1], budget, history)]
        yield pa.RecordBatch.from_pylist(made, schema=_ARROW)

    return dealt.mapInArrow(run, WINDOWS)


def read_back(made: DataFrame) -> DataFrame:
    """``DIGESTS`` of each conversation, from its windows alone: new turns in order, and what lies under the loss mask.

    The rows of a conversation pass through one task in order, which keeps running digests and
    no text, as a digest of a sequence can only be taken along it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, totals, turns, loss, done = None, None, None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["conv_id"],) != current:
                    if current is not None:
                        done.append((*current, totals[0], turns.hexdigest(), totals[1], loss.hexdigest(), totals[2], totals[3]))
                    current, totals, turns, loss = (row["conv_id"],), [0, 0, 0, 0], hashlib.sha256(), hashlib.sha256()
                text = row["formatted"]
                for role, body in parsed(text[row["repeated_chars"] :]):
                    totals[0] += 1
                    turns.update(f"{role}\n{body}\n".encode(errors="surrogatepass"))
                for target in row["targets"]:
                    said = unescaped(text[target["start"] : target["stop"]])
                    totals[1] += len(said)
                    loss.update(said.encode(errors="surrogatepass"))
                totals[2] += len(text)
                totals[3] += 1
        if current is not None:
            done.append((*current, totals[0], turns.hexdigest(), totals[1], loss.hexdigest(), totals[2], totals[3]))
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        kinds = [pa.string() if " string" in c else pa.int64() for c in DIGESTS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=names)

    rows = made.select("conv_id", "chapter", "window", "repeated_chars", "formatted", "targets")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "chapter", "window").mapInArrow(run, DIGESTS)
