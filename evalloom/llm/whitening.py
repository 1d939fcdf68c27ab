"""Whitening of embeddings on their leading principal components, by Jacobi-Davidson iteration.

Components become integers, x = floor(scale * c) + offset, and rows are stored once in blocks of such
integers. The covariance matrix is never formed: all the search needs are its products with a
few directions, and one product is one Spark job in which every task centres its rows,
multiplies them and sends a matrix of dimension by directions.

``leading_pairs`` keeps a search space and its products. Rayleigh-Ritz gives approximate pairs;
those whose residual is down to rounding are locked. For the others the correction equation,
projected off locked and current vectors, is solved by some steps of MINRES, all directions in
step so that each step is one product, and the corrections widen the search space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalloom.storage import stored

#: Entries beyond this size (scaled) have no exact sums; such a row is an error, not left out.
LIMIT = 1 << 40
BLOCKS = "ids array<long>, rows int, width int, low long, high long, x binary"
#: Directions held in the search space, MINRES steps between two Rayleigh-Ritz steps, and rounds at most.
SPACE, STEPS, ROUNDS = 48, 5, 100

Product = Callable[[np.ndarray], np.ndarray]


def _minres(apply: Product, right: np.ndarray, steps: int, small: float) -> np.ndarray:
    """Approximate solutions of ``apply(x) = right``, one per column, by MINRES in step."""
    safe = lambda a: np.where(a == 0, 1.0, a)
    beta = first = np.linalg.norm(right, axis=0)
    x, w, w_old, v_old = (np.zeros_like(right) for _ in range(4))
    v, rest = right / safe(beta), beta
    c = c_old = np.ones_like(beta)
    s = s_old = np.zeros_like(beta)
    for step in range(steps):
        p = apply(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - (beta * v_old if step else 0)
        beta_new = np.linalg.norm(p, axis=0)
        below = s_old * beta if step else 0
        over = s * alpha + (c_old * c * beta if step else 0)
        corner = c * alpha - (c_old * s * beta if step else 0)
        size = np.hypot(corner, beta_new)
        w, w_old = np.where(size > 0, (v - below * w_old - over * w) / safe(size), 0.0), w
        c, c_old = np.where(size > 0, corner / safe(size), 1.0), c
        s, s_old = np.where(size > 0, beta_new / safe(size), 0.0), s
        x = x + c * rest * w
        rest = -s * rest
        v, v_old, beta = p / safe(beta_new), v, beta_new
        if (np.abs(rest) <= small * first).all():
            break
    return x


def _against(new: np.ndarray, *held: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span what ``new`` adds to the orthonormal columns of ``held``."""
    base = np.hstack(held)
    size = np.linalg.norm(new, axis=0)
    new = new[:, size > 0] / size[size > 0]
    kept: list[np.ndarray] = []
    for column in new.T:
        for _ in range(2):
            column = column - base @ (base.T @ column)
            for other in kept:
                column = column - other * (other @ column)
        size = np.linalg.norm(column)
        if size > 1e-8:
            column = column / size
            for other in (base, *([np.array(kept).T] if kept else [])):  # once more, as dividing magnifies what was left
                column = column - other @ (other.T @ column)
            kept.append(column / np.linalg.norm(column))
    return np.array(kept).T.reshape(len(base), len(kept))


def leading_pairs(product: Product, d: int, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Largest eigenvalues, eigenvectors as columns, and the products of these, of a positive semi-definite matrix.

    A pair is locked when its residual is at most ``max(64, 4 d)`` rounding units of the largest
    eigenvalue. Search goes on until the next approximate pair cannot reach the least of the wanted
    ones. The products are made anew from the locked vectors. Raises if that takes over ``ROUNDS`` rounds.
    """
    wanted = min(wanted, d)
    unit = max(64, 4 * d) * np.finfo(float).eps
    locked, values = np.zeros((d, 0)), np.zeros(0)
    start = np.random.default_rng(seed).standard_normal((d, min(d, 2 * wanted)))
    space = _against(start, locked)
    image = product(space)
    for turn in range(ROUNDS):
        while True:  # Rayleigh-Ritz, and locking as long as pairs are done
            h = space.T @ image
            theta, s = np.linalg.eigh((h + h.T) / 2)
            theta, s = theta[::-1], s[:, ::-1]
            space, image = space @ s, image @ s
            top = max([*values, *theta, 0.0])
            left = max(1, wanted - len(values))
            residual = image[:, :left] - space[:, :left] * theta[:left]
            residual = residual - locked @ (locked.T @ residual)
            sizes = np.linalg.norm(residual, axis=0)
            enough = np.sort(values)[::-1][wanted - 1] if len(values) >= wanted else None
            if not len(theta) or (enough is not None and theta[0] + sizes[0] <= enough + unit * top):
                x = locked[:, np.argsort(-values, kind="stable")[:wanted]]
                fresh = product(x)
                theta, s = np.linalg.eigh((x.T @ fresh + fresh.T @ x) / 2)
                order = np.argsort(-theta, kind="stable")
                return theta[order], x @ s[:, order], fresh @ s[:, order]
            done = int(np.argmin(np.append(sizes <= unit * top, False)))
            if not done:
                break
            locked, values = np.hstack([locked, space[:, :done]]), np.append(values, theta[:done])
            space, image = space[:, done:], image[:, done:]
        now = sizes > unit * top
        ritz, shift, off = space[:, :left], theta[:left][now], np.hstack([locked, space[:, :left]])

        def projected(t: np.ndarray) -> np.ndarray:
            t = t - off @ (off.T @ t)
            t = product(t) - shift * t
            return t - off @ (off.T @ t)

        right = -residual[:, now]
        new = _minres(projected, right - off @ (off.T @ right), STEPS, 0.05)
        if space.shape[1] + new.shape[1] > SPACE:
            keep = min(space.shape[1], 2 * wanted)
            space, image = space[:, :keep], image[:, :keep]
        new = _against(new, locked, space)
        if not new.shape[1]:  # rounding is all that is left of the corrections: another start
            new = _against(np.random.default_rng(seed + 1 + turn).standard_normal((d, ritz.shape[1])), locked, space)
        if new.shape[1]:
            space, image = np.hstack([space, new]), np.hstack([image, product(new)])
    raise RuntimeError(f"residuals {sizes / top} have not come down to rounding in {ROUNDS} rounds")


def blocks_of(vectors: DataFrame, id_col: str, vector_col: str, scale: float, offset: int) -> DataFrame:
    """Usable rows in blocks, as integers; a block holds the rows of one Arrow batch."""
    c = F.transform(F.col(f"`{vector_col}`").cast("array<double>"), lambda y: y * F.lit(float(scale)))
    usable = F.forall(c, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    whole = F.transform(
        c, lambda y: F.when(F.abs(y) < LIMIT, F.floor(y) + offset).otherwise(F.raise_error(F.lit("an entry is too large for exact sums")).cast("long"))
    )
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("id"), whole.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths = np.diff(batch.column(1).offsets.to_numpy())
            width, flat = int(lengths.max()), batch.column(1).flatten().to_numpy()
            x = np.full((len(lengths), width), offset, np.int64)
            x[np.arange(width) < lengths[:, None]] = flat
            row = [batch.column(0).to_pylist(), len(x), width, int(x.min(initial=offset)), int(x.max(initial=offset)), x.tobytes()]
            kinds = [pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            names = [n.split()[0] for n in BLOCKS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    return rows.mapInArrow(run, BLOCKS)


@dataclass
class Whitening:
    """A fitted whitening: exact sums, unit components as columns with their variances, and how white the result is."""

    n: int
    sums: list[int]
    offset: int
    spread: int
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def width(self) -> int:
        return len(self.sums)

    def deviations(self, width: int, data: bytes) -> np.ndarray:
        """n * x - S per row of a block, exact: 64-bit numbers where they suffice, else Python integers."""
        x = np.frombuffer(data, np.int64).reshape(-1, width) if width else np.zeros((0, 0), np.int64)
        x = np.pad(x, ((0, 0), (0, self.width - width)), constant_values=self.offset)
        if self.n * self.spread >= 1 << 62:
            return x.astype(object) * self.n - np.array(self.sums, object)
        sums = np.array([s - (1 << 64) * ((s + (1 << 63)) >> 64) for s in self.sums], np.int64)
        return x * np.int64(self.n) - sums  # both may wrap around; the difference does not

    def centred(self, width: int, data: bytes) -> np.ndarray:
        return self.deviations(width, data).astype(float) / self.n

    def squares(self, deviations: np.ndarray) -> list[int]:
        """Sums of squares per row, exact."""
        if deviations.dtype != object and (self.n * self.spread) ** 2 * max(1, self.width) >= 1 << 63:
            deviations = deviations.astype(object)
        return [int(v) for v in (deviations * deviations).sum(axis=1)]


def _summed(parts: DataFrame, kind: str, size: int) -> list:
    """Element sums of the arrays in ``part``; ``size`` numbers reach the driver."""
    total = parts.select(F.posexplode("part").alias("at", "v")).groupBy("at").agg(F.sum(F.col("v").cast(kind)).alias("v"))
    made: list = [0] * size
    for row in total.collect():
        made[row["at"]] = row["v"]
    return made


def _sums(blocks: DataFrame, width: int, offset: int) -> list[int]:
    """Exact sums per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                x = np.frombuffer(block["x"], np.int64).reshape(block["rows"], block["width"])
                part = [*x.sum(axis=0).tolist(), *[offset * block["rows"]] * (width - block["width"])]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.list_(pa.int64()))], names=["part"])

    parts = blocks.select("rows", "width", "x").mapInArrow(run, "part array<long>")
    return [int(v) for v in _summed(parts, "decimal(38,0)", width)]


def _product(blocks: DataFrame, fit: Whitening, directions: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance matrix times ``directions``, and its trace. Rows are centred before multiplying."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros(directions.shape), 0.0
        for batch in batches:
            for block in batch.to_pylist():
                x = fit.centred(block["width"], block["x"]) if block["width"] else np.tile(fit.centred(0, b""), (block["rows"], 1))
                total += x.T @ (x @ directions)
                squares += float((x * x).sum())
        yield pa.RecordBatch.from_arrays([pa.array([[*total.ravel(), squares]], pa.list_(pa.float64()))], names=["part"])

    parts = blocks.select("width", "rows", "x").mapInArrow(run, "part array<double>")
    total = np.array(_summed(parts, "double", directions.size + 1), float) / fit.n
    return total[:-1].reshape(directions.shape), float(total[-1])


def fit(blocks: DataFrame, components: int = 8, offset: int = 100_000, seed: int = 0) -> Whitening:
    """Fit to all rows of ``blocks`` (a stored table, as every product reads it)."""
    shape = blocks.agg(F.sum("rows").alias("n"), F.max("width").alias("width"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    n, width = shape["n"] or 0, shape["width"] or 0
    none = Whitening(n, [0] * width, offset, 0, np.zeros((width, 0)), np.zeros(0), np.zeros(0), 0.0)
    if not n or not width:
        return none
    low, high = min(shape["low"], offset), max(shape["high"], offset)
    made = Whitening(n, _sums(blocks, width, offset), offset, high - low, none.components, none.variances, none.explained, 0.0)
    trace = [0.0]

    def product(directions: np.ndarray) -> np.ndarray:
        image, trace[0] = _product(blocks, made, directions)
        return image

    values, vectors, images = leading_pairs(product, width, components, seed)
    held = values > max(64, 4 * width) * np.finfo(float).eps * max(values[0], 0.0)  # others are zero but for rounding
    values, vectors, images = values[held], vectors[:, held], images[:, held]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    images = images * np.sign((vectors * images).sum(axis=0))
    made.components, made.variances = vectors, values
    made.explained = values / trace[0] if len(values) else values
    if len(values):
        covariance = (vectors.T @ images) / np.sqrt(np.outer(values, values))
        made.identity_error = float(np.abs(covariance - np.eye(len(values))).max())
    return made


WHITENED = "id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def apply(blocks: DataFrame, fitted: Whitening) -> DataFrame:
    """A row per stored row and component."""
    k = len(fitted.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                off = fitted.deviations(block["width"], block["x"])
                white = off.astype(float) / fitted.n @ fitted.components / np.sqrt(fitted.variances)
                squares = pa.array([Decimal(v) for v in fitted.squares(off)], pa.decimal128(38, 0))
                row, number = np.repeat(np.arange(len(off)), k), np.tile(np.arange(k), len(off))
                columns = [
                    pa.array(block["ids"], pa.int64()).take(pa.array(row)), pa.array(number + 1, pa.int32()),
                    pa.array(np.full(len(row), fitted.n), pa.int64()), squares.take(pa.array(row)), pa.array(white.ravel()),
                    pa.array(fitted.explained[number]), pa.array(np.full(len(row), fitted.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in WHITENED.split(", ")])

    return blocks.select("ids", "width", "x").where(F.lit(k > 0)).mapInArrow(run, WHITENED)


def whiten(
    vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vector_col: str = "embedding",
    scale: float = 1024.0, offset: int = 100_000, seed: int = 0,
) -> DataFrame:
    """``id, component, n, deviation, whitened, explained, identity_error``: rows times components.

    Rows whose vector is null or holds null or non-finite entries are left out of fit and result; all
    others are in both, repeated ones each, null ids too. Vectors of unequal length are taken as
    if the shorter ended in zeros. An entry too large for exact sums (beyond 2**40 scaled) raises
    an error. Components without variance are not given, so equal rows, a single row or an
    empty table have none, and ties among variances come in any order. ``deviation`` is the
    exact sum of (n * x - S)**2; its 38 digits suffice where ``n * spread`` is below 10**17.
    """
    blocks = stored(blocks_of(vectors, id_col, vector_col, scale, offset), "whitening-blocks")
    return apply(blocks, fit(blocks, components, offset, seed))
