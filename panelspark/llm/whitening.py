"""Whitening of embeddings by LOBPCG (operator 13).

The leading eigenvectors of the covariance are found without forming it: each round multiplies it with a block of directions
in one pass over the centred rows, then Rayleigh-Ritz on the block of iterates, their residuals and the last directions
gives the next iterates. Rounds go on until the residuals are as small as doubles allow. Only blocks of dimension times
width numbers come to the driver; rows stay in tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm.common import stored, table

#: Components that are returned, further ones that the block carries to separate them sooner, units of a component in 1.
COMPONENTS, GUARDS, UNITS = 4, 8, 256
#: Residual of an eigenvector, relative to the largest eigenvalue, that ends the rounds; rounds at most; the residual that a
#: component must have then; the eigenvalue, relative to the largest, below which a component is noise and left out.
RESIDUAL, ROUNDS, CERTIFIED, RANK = 1e-14, 400, 1e-10, 1e-12
SEED = 3


@dataclass
class Fit:
    """n distinct rows with their sums by dimension, the trace of their covariance, eigenvalues falling and unit vectors as
    columns, the largest residual relative to the first eigenvalue, and the rounds."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residual: float
    rounds: int

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2 for every row, exactly; None beyond a long."""
        if self.n * float(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0) < 2**61 / max(1, x.shape[1]) ** 0.5:
            y = self.n * x - np.array(self.sums, np.int64)
            if float(np.abs(y).max(initial=0)) ** 2 * x.shape[1] < 2**62:
                return (y * y).sum(1).tolist()
        found = [sum((self.n * int(v) - s) ** 2 for v, s in zip(r, self.sums)) for r in x]
        return [v if v < 1 << 63 else None for v in found]

    def mean(self) -> np.ndarray:
        """The whole part of the mean and the rest, both as doubles: x - whole is exact where x is a double."""
        return np.array([s // self.n for s in self.sums], np.float64), np.array([s % self.n / self.n for s in self.sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.mean()
        return (x.astype(np.float64) - whole) - rest

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    lists = batch.column("x")
    return lists.flatten().to_numpy().reshape(len(lists), -1) if len(lists) else np.zeros((0, 0), np.int64)


def _summed(rows: DataFrame, width: int, of) -> np.ndarray:
    """The sum over all rows of of(matrix of some rows), an array of d x width doubles; added up in Spark by its rows."""
    names = [f"c{j}" for j in range(width)]

    def run(batches):
        total = None
        for batch in batches:
            if len(batch):
                part = of(_matrix(batch))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), *(pa.array(total[:, j]) for j in range(width))], ["i", *names])

    parts = rows.mapInArrow(run, ", ".join(["i int", *(f"{c} double" for c in names)]))
    found = parts.groupBy("i").agg(*(F.sum(c).alias(c) for c in names)).toPandas().sort_values("i")
    return found[names].to_numpy()


def _orthonormal(block: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """An orthonormal basis of the columns, each scaled first; twice, for full precision; directions that vanish go."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    return np.linalg.qr(u[:, s > least * s.max(initial=0)])[0]


def lobpcg(product, d: int, wanted: int, guards: int = GUARDS, residual: float = RESIDUAL, rounds: int = ROUNDS, seed: int = SEED):
    """Leading eigenvalues and vectors of the symmetric d x d operator `product`, the largest relative residual, the rounds.

    product takes a block of columns. In a block of all d columns the first Rayleigh-Ritz is exact. Where residuals no
    longer fall, the best iterate counts.
    """
    m = min(d, wanted + guards)
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, m)))[0]
    ax, p, best, stale = product(x), np.zeros((d, 0)), None, 0
    for k in range(rounds):
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        order = np.argsort(-values)
        values, x, ax = values[order], x @ turn[:, order], ax @ turn[:, order]
        r = ax - x * values
        size = np.linalg.norm(r[:, :wanted], axis=0).max(initial=0) / max(values[0], 1e-300)
        if best is None or size < best[2]:
            stale = 0 if best is None or size < 0.5 * best[2] else stale + 1
            best = values[:wanted], x[:, :wanted], size, k + 1
        else:
            stale += 1
        if size <= residual or values[0] <= 0 or m == d or (stale >= 12 and best[2] <= CERTIFIED):
            break
        w = r - x @ (x.T @ r)
        basis = _orthonormal(w)
        basis = _orthonormal(np.hstack([basis - x @ (x.T @ basis), p - x @ (x.T @ p)])) if p.shape[1] else basis
        basis = np.linalg.qr(basis - x @ (x.T @ basis))[0]
        if not basis.shape[1]:
            break
        ab = product(basis)
        whole, awhole = np.hstack([x, basis]), np.hstack([ax, ab])
        values, turn = np.linalg.eigh((whole.T @ awhole + awhole.T @ whole) / 2)
        top = turn[:, np.argsort(-values)[:m]]
        p = basis @ top[x.shape[1] :]
        x, ax = whole @ top, awhole @ top
        if k % 8 == 7:  # what rounding has added over the rounds goes
            x = np.linalg.qr(x)[0]
            ax = product(x)
    return best


def units(embeddings: DataFrame, scale: int = UNITS) -> DataFrame:
    """vec_id and x, the vector's components in whole units, of the rows that take part."""
    able = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(able)
    return rows.select("vec_id", F.transform("embedding", lambda c: F.floor(c * scale)).alias("x"))


def fit(rows: DataFrame, components: int = COMPONENTS) -> tuple[Fit, DataFrame] | None:
    """The components of the distinct x of rows, and the table of these; None without rows. Each distinct x counts once:
    copies fold together before the shuffle, so no group of copies weighs."""
    once = stored(rows.groupBy("x").agg(F.lit(1).alias("_")).select("x"), "distinct")
    n = once.count()
    if not n:
        return None
    d = once.select(F.size("x")).first()[0]

    def exact(batches):
        total = np.zeros(d, object)
        for batch in batches:
            x = _matrix(batch)
            safe = float(np.abs(x).max(initial=0)) * len(x) < 2**62
            total = total + (x.sum(0) if safe else x.astype(object).sum(0)).astype(object)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([str(v) for v in total])], ["i", "s"])

    sums = once.mapInArrow(exact, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    found = Fit(n, [int(r.s) for r in sums], 0.0, np.zeros(0), np.zeros((d, 0)), 0.0, 0)
    squares = lambda x: (lambda c: (c * c).sum(0)[:, None])(found.centred(x))
    found.trace = float(_summed(once, 1, squares).sum() / n)

    def product(block: np.ndarray) -> np.ndarray:
        def part(x):
            c = found.centred(x)
            return c.T @ (c @ block)

        return _summed(once, block.shape[1], part) / n

    if found.trace > 0:
        values, vectors, residual, rounds = lobpcg(product, d, min(components, d))
        if residual > CERTIFIED:
            raise ArithmeticError(f"residual {residual} after {rounds} rounds")
        keep = values > RANK * values[0]
        found.values, found.vectors, found.residual, found.rounds = values[keep], vectors[:, keep], residual, rounds
    return found, once


def _usual(rows: DataFrame) -> DataFrame:
    """The rows of the usual length, that of most rows, or the longer one."""
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "d"))["d"]).first()[0]
    return rows.where(F.size("x") == F.lit(lengths or 0))


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, residual and rounds, for each row with a vector
    and each component.

    Rows take no part whose vector is null, empty, or holds null or non-finite components, or hasn't the usual length.
    Repeated rows give repeated rows; equal vectors count once in the fit. Components without variance have no whitened
    value and are left out; of one distinct vector there are none, and of an empty table no rows. Equal eigenvalues give
    some orthonormal vectors of their space, the same for all rows. Columns other than vec_id and embedding aren't read.
    """
    rows = stored(_usual(units(embeddings)), "units")
    schema = rows.select("vec_id").schema.simpleString()[7:-1].replace(":", " ") + ", component int, n long, deviation long, whitened double, explained double, identity_error double, residual double, rounds int"
    made = fit(rows, components)
    if made is None:
        return rows.sparkSession.createDataFrame([], schema)
    found, once = made
    k = len(found.values)
    if k:
        mean = _summed(once, k, lambda x: found.whitened(x).sum(0)[None])[0] / found.n

        def spread(x):
            y = found.whitened(x) - mean
            return y.T @ y

        error = float(np.abs(_summed(once, k, spread) / found.n - np.eye(k)).max())
    shared = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        found = shared.value
        for batch in batches:
            if not len(batch) or not k:
                continue
            x, n = _matrix(batch), len(batch)
            again = lambda v: pa.array(np.repeat(v, k))
            same = lambda v, kind: pa.array([v] * (n * k), kind)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(again(np.arange(n))), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()), same(found.n, pa.int64()), pa.array([v for v in found.deviations(x) for _ in range(k)], pa.int64()),
                    pa.array(found.whitened(x).ravel()), pa.array(np.tile(found.values / found.trace, n)), same(error, pa.float64()), same(found.residual, pa.float64()), same(found.rounds, pa.int32()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "residual", "rounds"],
            )

    return rows.mapInArrow(run, schema)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
