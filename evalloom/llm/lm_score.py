"""Log-probabilities of texts under a log-bilinear neural model trained by noise-contrastive estimation.

Words belong to classes: each of the most frequent words has its own, the others share one
by their last letters. The model predicts a token's class from the classes of the two
tokens before it - a bilinear form of learned vectors - and the word within its class from
corpus counts. Every task trains on the training tokens of its own partition, from the same
start, and the parameters are averaged by Spark, so training grows with the corpus and
nothing but sums of fixed size reaches the driver. Three products of the class matrices
then give the normaliser of every pair of context classes at once. Texts are read twice, for
counts and for classes; both rounds of training and the scores read the stored classes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.llm import common
from evalloom.storage import stored

#: Words with counts in every task, words with a class of their own, classes by ending: upper bounds.
HEAD, OWN, ENDINGS = 150_000, 500, 500
#: Length of the vectors, passes over the corpus, tokens in a step, noise draws in a step.
SIZE, ROUNDS, STEP, NOISE = 24, 2, 1024, 96
RATE = 0.15
#: Words of a partition counted in memory before they are passed on.
COUNTED = 300_000
END, BEGIN = 0, 1  # the class of the end token, and of what stands before the first word
FIRST = 2
#: How classes are stored: there are fewer than 65,536.
CLASS = np.dtype("<u2")


def ending(word: bytes) -> bytes:
    """The last three bytes before closing punctuation, and the first mark of that."""
    bare = word.rstrip(b".,;:!?")
    return bare[-3:] + b" " + word[len(bare) : len(bare) + 1]


@dataclass
class Vocabulary:
    """Counts that every task needs, of bounded size, and totals of all others."""

    total: int
    distinct: int
    head: dict[bytes, int]  # word -> place in the two arrays; b"" is the end token
    head_count: np.ndarray
    head_class: np.ndarray
    endings: dict[bytes, int]
    class_tokens: np.ndarray
    class_words: np.ndarray
    threshold: int  # head words are those of this order of count or above, and the end token


@dataclass
class Parameters:
    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    near: np.ndarray
    far: np.ndarray

    @property
    def table(self) -> np.ndarray:
        """One row per class, and two for the position weights."""
        rows = np.hstack([self.context, self.target, self.bias[:, None]])
        extra = np.zeros((2, rows.shape[1]))
        extra[0, :SIZE], extra[1, :SIZE] = self.near, self.far
        return np.vstack([rows, extra])

    @classmethod
    def of(cls, table: np.ndarray) -> Parameters:
        rows = table[:-2]
        return cls(rows[:, :SIZE], rows[:, SIZE : 2 * SIZE], rows[:, 2 * SIZE], table[-2, :SIZE], table[-1, :SIZE])


def _order(count):
    """Counts by order of magnitude, eight steps to a doubling."""
    return F.floor(8 * F.log2(count)).cast("int")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    doc_id = F.col(f"`{id_col}`")
    return docs.select(
        doc_id.cast("long").alias("doc_id"), (common.id_remainder(doc_id, 7) == 2).alias("held_out"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"),
    )


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c`` over the training texts; the empty word is the end token. Counted in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def batch_of() -> pa.RecordBatch:
            arrays = [pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["word", "c"])

        for batch in batches:
            for text in batch.column(0):
                held.update(text.as_py().lower().split())
                held[b""] += 1
                if len(held) > COUNTED:
                    yield batch_of()
                    held.clear()
        if held:
            yield batch_of()

    training = texts.where(~F.col("held_out")).select("text")
    return training.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The head of the counts, classes and totals: at most ``HEAD`` words, the end token and ``ENDINGS`` endings are collected."""
    orders = counts.groupBy(_order(F.col("c")).alias("o")).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()
    total, distinct = sum(r["c"] for r in orders), sum(r["n"] for r in orders)
    threshold, words = 1 << 30, 0
    for r in sorted(orders, key=lambda r: -r["o"]):
        if (words := words + r["n"]) > HEAD:
            break
        threshold = r["o"]
    frequent = (_order(F.col("c")) >= threshold) | (F.length("word") == 0)  # the end token, however rare, is in no tail
    rows = sorted(counts.where(frequent).collect(), key=lambda r: (-r["c"], bytes(r["word"])))
    rows = [(bytes(r["word"]), r["c"]) for r in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [ending(w) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), batch.column(1)], names=["ending", "c"])

    by_ending = (
        counts.where(F.length("word") > 0).mapInArrow(run, "ending binary, c long")
        .groupBy("ending").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("c"), "ending").limit(ENDINGS).collect()
    )
    own = [w for w, _ in rows if w][:OWN]
    ends_at = FIRST + len(own)
    endings = {bytes(r["ending"]): ends_at + i for i, r in enumerate(by_ending)}
    size = ends_at + len(endings) + 1  # the last class takes all other endings
    tokens, kinds = np.zeros(size), np.zeros(size)
    for r in by_ending:
        tokens[endings[bytes(r["ending"])]], kinds[endings[bytes(r["ending"])]] = r["c"], r["n"]
    known = dict(rows)
    tokens[-1] = total - known.get(b"", 0) - tokens.sum()
    kinds[-1] = distinct - (b"" in known) - kinds.sum()
    own_class = {w: FIRST + i for i, w in enumerate(own)}
    for w in own:
        k = endings.get(ending(w), size - 1)
        tokens[k] -= known[w]
        kinds[k] -= 1
        tokens[own_class[w]], kinds[own_class[w]] = known[w], 1
    tokens[END], kinds[END] = known.get(b"", 0), 1
    classes = np.array([END if not w else own_class.get(w) or endings.get(ending(w), size - 1) for w, _ in rows], np.int32)
    return Vocabulary(
        total, distinct, {w: i for i, (w, _) in enumerate(rows)}, np.array([c for _, c in rows], float), classes,
        endings, tokens, kinds, threshold,
    )


def classes_of(words: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Classes of the words, their places in the head (-1: not there), and the positions not there."""
    places = np.fromiter(map(vocab.head.get, words, repeat(-1)), np.int64, len(words))
    missing = np.flatnonzero(places < 0).tolist()
    classes = vocab.head_class[places] if len(vocab.head_class) else np.zeros(len(places), np.int32)
    other = len(vocab.class_tokens) - 1
    if missing:
        classes[missing] = [vocab.endings.get(ending(words[i]), other) for i in missing]
    return classes, places, missing


def _sequence(classes: np.ndarray) -> np.ndarray:
    return np.concatenate(([BEGIN, BEGIN], classes, [END])).astype(np.int32)


def start(vocab: Vocabulary) -> Parameters:
    """Small random vectors, and biases at the classes' shares, so that training starts from unigrams."""
    n = len(vocab.class_tokens)
    rng = np.random.default_rng(7)
    share = (vocab.class_tokens + 1) / (vocab.class_tokens.sum() + n)
    bias = np.log(share)
    bias[BEGIN] = -30.0
    return Parameters(
        rng.normal(0, 0.1, (n, SIZE)), rng.normal(0, 0.1, (n, SIZE)), bias, np.ones(SIZE), np.ones(SIZE)
    )


@cache
def _places(n: int, width: int) -> np.ndarray:
    return np.arange(n * width).reshape(n, width)


def _sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows that belong to each of ``n`` places."""
    places = _places(n, rows.shape[1]).take(at, axis=0)
    return np.bincount(places.ravel(), rows.ravel(), n * rows.shape[1]).astype(np.float32).reshape(n, -1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """Of float32 logits, which it overwrites."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += np.float32(1)
    return np.reciprocal(x, out=x)


def train_step(p: Parameters, squares: Parameters, triples: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> None:
    """One step of noise-contrastive estimation on (far, near, target) triples; ``noise`` is shared by the step."""
    far, near, target = triples.T
    r1, r2 = p.context.take(near, axis=0), p.context.take(far, axis=0)
    h = r1 * p.near + r2 * p.far
    q, qn = p.target.take(target, axis=0), p.target.take(noise, axis=0)
    k = np.float32(math.log(len(noise)))
    up = _sigmoid(np.einsum("ij,ij->i", h, q) + (p.bias[target] - log_noise[target] - k)) - 1
    down = h @ qn.T
    down += p.bias[noise] - log_noise[noise] - k
    down = _sigmoid(down)
    dh = up[:, None] * q + down @ qn
    n, size = len(triples), len(p.bias)
    at = np.concatenate([target, noise])
    grads = Parameters(
        _sums(np.concatenate([near, far]), np.concatenate([dh * p.near, dh * p.far]), size),
        _sums(at, np.concatenate([up[:, None] * h, down.T @ h]), size),
        np.bincount(at, np.concatenate([up, down.sum(axis=0)]), size).astype(np.float32),
        np.einsum("ij,ij->j", dh, r1), np.einsum("ij,ij->j", dh, r2),
    )
    for name in ("context", "target", "bias", "near", "far"):
        g = getattr(grads, name) * np.float32(1 / math.sqrt(n))
        s = getattr(squares, name)
        s += g * g
        getattr(p, name)[...] -= np.float32(RATE) * g / np.sqrt(s + np.float32(1e-2))


def train_round(texts: DataFrame, vocab: Vocabulary, before: Parameters, round_number: int) -> Parameters:
    """One pass of every task over its training tokens, then the mean of the tasks' parameters by tokens trained on.

    ``texts`` may be a table of ``classed_texts``, which is then read as it is.
    """
    classed = texts if "classes" in texts.columns else classed_texts(texts, vocab)
    rows, columns = before.table.shape
    names = [f"v{i}" for i in range(columns)]
    log_noise = np.log((vocab.class_tokens + 1) / (vocab.class_tokens + 1).sum()).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Parameters(*[np.array(x, np.float32) for x in vars(Parameters.of(before.table)).values()])
        squares = Parameters(*[np.zeros_like(x) for x in (p.context, p.target, p.bias, p.near, p.far)])
        rng = np.random.default_rng(round_number)
        chance = np.cumsum(np.exp(log_noise.astype(float)))
        held, size, trained = [], 0, 0

        def step(triples: np.ndarray) -> None:
            noise = np.minimum(np.searchsorted(chance, rng.random(NOISE)), len(chance) - 1)
            train_step(p, squares, triples, noise, log_noise)

        for batch in batches:
            for classes in batch.column(0):
                s = _sequence(np.frombuffer(classes.as_buffer(), CLASS))
                held.append(np.stack([s[:-2], s[1:-1], s[2:]], axis=1))
                size += len(s) - 2
                if size >= 32 * STEP:
                    triples = np.concatenate(held)
                    triples = triples[rng.permutation(len(triples))]
                    whole = len(triples) // STEP * STEP
                    for a in range(0, whole, STEP):
                        step(triples[a : a + STEP])
                    trained += whole
                    held, size = [triples[whole:]], len(triples) - whole
        if size:
            triples = np.concatenate(held)
            triples = triples[rng.permutation(len(triples))]
            for a in range(0, len(triples), STEP):
                step(triples[a : a + STEP])
            trained += len(triples)
        if trained:
            table = np.hstack([np.full((rows, 1), float(trained)), p.table.astype(float) * trained])
            arrays = [pa.array(np.arange(rows), pa.int32())] + [pa.array(np.ascontiguousarray(c)) for c in table.T]
            yield pa.RecordBatch.from_arrays(arrays, names=["row", "weight", *names])

    schema = "row int, weight double, " + ", ".join(f"{n} double" for n in names)
    sums = (
        classed.where(~F.col("held_out")).select("classes").mapInArrow(run, schema)
        .groupBy("row").agg(F.sum("weight").alias("weight"), *[F.sum(n).alias(n) for n in names]).collect()
    )
    if not sums:
        return before
    table = np.zeros((rows, columns))
    for r in sums:
        table[r["row"]] = np.array(r[2:]) / r["weight"]
    return Parameters.of(table)


@dataclass
class Predictor:
    """log10 of a class after any two classes, as tables over pairs of classes."""

    near: np.ndarray = field(repr=False)
    far: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)
    norm: np.ndarray = field(repr=False)

    @classmethod
    def of(cls, p: Parameters) -> Predictor:
        near, far = (p.context * p.near) @ p.target.T, (p.context * p.far) @ p.target.T
        a, b = near.max(axis=1, keepdims=True), (far + p.bias).max(axis=1, keepdims=True)
        norm = np.log(np.maximum(np.exp(near - a) @ np.exp(far + p.bias - b).T, 1e-300)) + a + b.T
        return cls(near, far, p.bias, norm)

    def log10(self, sequence: np.ndarray) -> np.ndarray:
        far, near, target = sequence[:-2], sequence[1:-1], sequence[2:]
        logits = self.near[near, target] + self.far[far, target] + self.bias[target]
        return (logits - self.norm[near, far]) / math.log(10)


def fit(texts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> Parameters:
    p = start(vocab)
    for number in range(rounds):
        p = train_round(texts, vocab, p, number)
    return p


CLASSED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, counted double, within double, "
    "classes binary, tail array<binary>"
)


def classed_texts(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """The classes of each text's words, two bytes a word, and what it yields besides them: rounds and scores read no text.

    ``counted`` and ``within`` leave out the counts of rare words, which are in ``tail``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.log10(vocab.head_count + 1)
        inside = np.log10(vocab.class_tokens + vocab.class_words + 1)
        alone = np.arange(len(inside)) < FIRST + len([w for w in vocab.head if w][:OWN])
        end = vocab.head_count[vocab.head[b""]] if b"" in vocab.head else 0.0
        for batch in batches:
            columns = [[] for _ in range(6)]
            for text in batch.column(3):
                words = text.as_py().lower().split()
                classes, places, missing = classes_of(words, vocab)
                here = places >= 0
                counts = count[places[here]]
                single = alone[classes]
                columns[0].append(len(words) + 1)
                columns[1].append(int(here.sum()) + (end > 0))
                columns[2].append(float(counts.sum() + math.log10(end + 1)))
                columns[3].append(float(counts[~single[here]].sum() - inside[classes[~single]].sum()))
                columns[4].append(classes.astype(CLASS).tobytes())
                columns[5].append([words[i] for i in missing])
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary())]
            made = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=[x.split()[0] for x in CLASSED.split(", ")])

    numbered = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    return numbered.mapInArrow(run, CLASSED)


def _predicted(classed: DataFrame, p: Parameters) -> DataFrame:
    """``classed`` without classes and tail, and with ``predicted``: log10 of its classes, end included."""
    kept = ["row", "doc_id", "held_out", "n_tokens", "n_known", "counted", "within"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = Predictor.of(p)
        for batch in batches:
            sums = [float(predict.log10(_sequence(np.frombuffer(c.as_buffer(), CLASS))).sum()) for c in batch.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(sums, pa.float64())], names=[*kept, "predicted"])

    schema = classed.select(*kept).withColumn("predicted", F.lit(0.0)).schema
    return classed.select(*kept, "classes").mapInArrow(run, schema)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    The model learns from rows whose id's crc32 modulo 7 is not 2. A null text is empty and holds
    the end token alone; repeated rows are scored each; without training rows every token is
    unknown. ``base_score`` is add-one unigram log10 probability. Within a class, words have
    (c + 1) / (tokens + words + 1), where the last 1 is left for unknown words, so
    probabilities sum to one over known words and one unknown word per class. Counts of
    frequent words travel with the tasks, up to a fixed number; those of all others are
    joined by word, and none is left out.
    """
    texts = _texts(docs, id_col, text_col)
    counts = stored(word_counts(texts), "lm-counts")
    vocab = vocabulary(counts)
    classed = stored(classed_texts(texts, vocab), "lm-classes")
    scored = _predicted(classed, fit(classed, vocab, rounds))
    rare = counts.where(_order(F.col("c")) < vocab.threshold)
    tail = classed.select("row", F.explode("tail").alias("w"))
    found = tail.join(rare, F.col("w") == F.col("word")).groupBy(F.col("row").alias("r")).agg(
        F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count(F.lit(1)).alias("known")
    )
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(found, F.col("row") == F.col("r"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocab.total).cast("long").alias("train_tokens"),
        (F.col("counted") + more - F.col("n_tokens") * math.log10(vocab.total + vocab.distinct + 1)).alias("base_score"),
        (F.col("predicted") + F.col("within") + more).alias("score"),
    )
