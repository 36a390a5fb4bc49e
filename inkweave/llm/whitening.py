"""Whitening of embeddings: principal components with unit variance, from one mean and one scatter matrix.

Each partition computes count, mean and centred scatter of its rows; two such states a and b merge by Chan's formulas
(the scatter of the union is the sum of both and of (mean b - mean a) times itself times n_a n_b / (n_a + n_b)), pairwise
in a treeReduce, so the driver receives one state, of the square of the dimension, at any number of rows.  The driver
takes the eigenvectors; a second pass over all rows merges the covariance of the whitened rows in the same way and
compares it with the identity.

Entries are put on a grid of 1/64 first, x = floor(64 c) + 1000000, so sums are exact integers.

Defined results: a null vector, or one with entries that are null, not finite or of ``LARGEST`` and more in size, has no
row; vectors must have equally many entries, so of the remaining ones those with the most frequent length count (the
longer one on a tie) and others have no row; a null or repeated id stays as it is; a component whose eigenvalue is zero,
to double precision, cannot be whitened and is left out, so equal vectors, or a single one, give no rows; a deviation
beyond a long is null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.common import tidy

COMPONENTS = 32
GRID, ZERO = 64, 1_000_000
LARGEST = 2.0**43
#: Depth of the tree in which states merge.
DEPTH = 3

STATE = "n long, sums array<decimal(38,0)>, mean array<double>, scatter array<double>"


@dataclass
class State:
    """n rows with their exact integer sums (0 where rows are not integers), mean and centred scatter."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(rows: np.ndarray, exact: bool) -> State:
        mean = rows.mean(axis=0)
        off = rows - mean
        mean += (rest := off.mean(axis=0))  # what rounding has left of the mean
        off -= rest
        sums = rows.sum(axis=0, dtype=np.int64) if exact else np.zeros(rows.shape[1], np.int64)
        return State(len(rows), sums.astype(object), mean, off.T @ off)

    def merged(self, other: State) -> State:
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        gap = other.mean - self.mean
        return State(n, self.sums + other.sums, self.mean + gap * (other.n / n), self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n))


def on_grid(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that remain, their entries x - ZERO as longs)."""
    fits = np.flatnonzero(pc.equal(pc.list_value_length(vectors), dim).fill_null(False).to_numpy(zero_copy_only=False))
    c = vectors.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), dim)
    good = (np.abs(c) < LARGEST).all(axis=1)
    return fits[good], np.floor(c[good] * GRID).astype(np.int64)


def usual_length(vectors: DataFrame) -> int:
    """The most frequent length of remaining vectors, 0 if there are none."""
    good = vectors.filter(F.forall("v", lambda c: c.isNotNull() & (F.abs(c.cast("double")) < LARGEST)) & (F.size("v") > 0))
    found = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found["d"] if found else 0


def _states(vectors: DataFrame, dim: int, image, width: int, exact: bool) -> State:
    """The merged state of the images of all remaining rows."""

    def run(batches):
        state = State(0, np.zeros(width, object), np.zeros(width), np.zeros((width, width)))
        for b in batches:
            _, y = on_grid(b.column("v"), dim)
            if len(y):
                state = state.merged(State.of(image(y), exact))
        sums = pa.array([[Decimal(int(s)) for s in state.sums]], pa.list_(pa.decimal128(38)))
        yield pa.RecordBatch.from_arrays([pa.array([state.n], pa.int64()), sums, pa.array([state.mean.tolist()]), pa.array([state.scatter.ravel().tolist()])], ["n", "sums", "mean", "scatter"])

    read = lambda r: State(r["n"], np.array([int(s) for s in r["sums"]], object), np.array(r["mean"]), np.array(r["scatter"]).reshape(width, width))
    return vectors.mapInArrow(tidy(run), STATE).rdd.map(read).treeReduce(State.merged, DEPTH)


@dataclass
class Whitening:
    """n vectors of dim entries with sums of x - ZERO; ``weights`` (dim x components) takes x minus its mean to the whitened row."""

    dim: int
    n: int = 0
    sums: np.ndarray = field(default_factory=lambda: np.zeros(0, object))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    explained: list[float] = field(default_factory=list)
    identity_error: float = 0.0

    def off(self, y: np.ndarray) -> np.ndarray:
        """n * x minus the sums, exact: as longs where they fit, else as Python's integers."""
        most = max([int(np.abs(y).max()) if y.size else 0, *(abs(int(s)) // max(self.n, 1) + 1 for s in self.sums)])
        if 2 * most * self.n < 2**62:
            return y * self.n - self.sums.astype(np.int64)
        return y.astype(object) * self.n - self.sums

    def image(self, y: np.ndarray) -> np.ndarray:
        return (self.off(y).astype(np.float64) / self.n) @ self.weights

    def deviation(self, y: np.ndarray) -> list[int | None]:
        off = self.off(y)
        if off.size and off.dtype == np.int64 and float(np.abs(off).max()) ** 2 * self.dim < 2**62:
            return (off * off).sum(axis=1).tolist()
        return [d if d < 2**63 else None for d in (sum(int(v) ** 2 for v in row) for row in off)]


def _vectors(rows: DataFrame, column: str, *keys) -> DataFrame:
    return rows.select(*keys, F.col(column).alias("v"))


def fit(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of a column of vectors, from all of them, verified by a second pass over all of them."""
    vectors = _vectors(rows, column)
    dim = usual_length(vectors)
    if not dim:
        return Whitening(0)
    state = _states(vectors, dim, lambda y: y, dim, True)
    e, v = np.linalg.eigh(state.scatter / state.n)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, int((e > e[0] * dim * np.finfo(float).eps).sum())) if e[0] > 0 else 0
    out = Whitening(dim, state.n, state.sums, v[:, :k] / np.sqrt(e[:k]), (e[:k] / e.sum()).tolist() if k else [])
    if k:
        check = _states(vectors, dim, out.image, k, False)
        out.identity_error = float(np.abs(check.scatter / check.n - np.eye(k)).max())
    return out


def apply(rows: DataFrame, fitted: Whitening, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """key, deviation, whitened (array<double>) of each remaining row."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            at, y = on_grid(b.column("v"), fitted.dim)
            if len(at):
                flat = fitted.image(y)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("k").take(pa.array(at)), pa.array(fitted.deviation(y), pa.int64()), lists], [key, "deviation", "whitened"])

    return _vectors(rows, column, F.col(key).alias("k")).mapInArrow(tidy(run), f"`{key}` {kind}, deviation long, whitened array<double>")


def report(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each remaining row and component."""
    fitted = fit(rows, components=components)
    out = apply(rows, fitted).select("vec_id", "deviation", F.posexplode("whitened").alias("_c", "whitened"))
    share = F.element_at(F.array(*(F.lit(x) for x in fitted.explained or [0.0])), F.col("_c") + 1)
    return out.select("vec_id", (F.col("_c") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(fitted.identity_error).alias("identity_error"))
