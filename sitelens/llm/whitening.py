"""Whitening of vectors: the leading eigenvectors of their covariance by Jacobi-Davidson, without forming the matrix.

Vectors become integers (256 times, floored); each distinct one is fitted once. The fit list is written to shared files as blocks of
rows. The covariance is only known by its products with a few columns at a time: every task centres its blocks, multiplies them by the
columns and back, and adds up; partial sums of many tasks are added in a second step, so the driver gets a bounded number of
them. Outside the products all state is a few columns of the vectors' length.

Each round is a Rayleigh-Ritz step in the subspace, whose leading pairs are locked once their residuals are at rounding level.
The others get corrections from the projected equation (I - QQ')(V - theta I)(I - QQ') t = -r, Q the locked vectors and their own,
solved by MINRES in lock step: one distributed product serves all columns. The subspace shrinks to its leading Ritz vectors when it is
full.

Defined results: vectors that are null or hold null or non-finite entries are dropped, as are those of another length than most have
(ties: the longer); empty vectors have no components; a component without variance (to rounding) is left out, since it cannot be scaled;
a null id stays null; repeated rows get rows of their own but count once in the fit; entries beyond the range of a long after scaling
are cut to it; a deviation beyond the range of a long is null; empty tables give no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

COMPONENTS, BLOCK, DIRECT, INNER = 4, 4096, 64, 6
_EPS = np.finfo(float).eps


def scaled(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", factor: int = 256) -> DataFrame:
    """(vec_id, x array<long>) of the rows that take part."""
    v = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    v = v.where(~F.coalesce(F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(True)))
    dims = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    most = float(2**63 - 1024)
    entry = lambda c: F.floor(F.greatest(F.least(c * factor, F.lit(most)), F.lit(-most))).cast("long")
    return v.where(F.size("v") == (dims[0].d if dims else -1)).select("vec_id", F.transform("v", entry).alias("x"))


def _rows(column: pa.Array) -> np.ndarray:
    """A list<long> column as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _narrow(m: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes each as they need."""
    low, high = (int(m.min()), int(m.max())) if m.size else (0, 0)
    return m.astype(next(t for t in (np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


class FitList:
    """The distinct vectors as blocks on shared files, and sums over them."""

    def __init__(self, x: DataFrame):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                m = _rows(b.column(0))
                parts = [_narrow(m[i : i + BLOCK]) for i in range(0, len(m), BLOCK)]
                yield pa.RecordBatch.from_arrays([pa.array([p.itemsize for p in parts], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["width", "raw"])

        one = x.select("x").distinct()
        self.blocks = materialize(one.mapInArrow(pack, "width int, raw binary"), "fit")
        self.tasks = max(1, self.blocks.rdd.getNumPartitions())
        first = x.select(F.size("x").alias("d")).first()
        self.d = first.d if first else 0
        self.n, self.sums = self._integers() if self.d else (0, [])
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(self.d)

    def _integers(self) -> tuple[int, list[int]]:
        """n and exact sums of every dimension; sums of two halves of each entry never overflow."""
        d = self.d

        def part(m: np.ndarray) -> np.ndarray:
            m = m.astype(np.int64)
            return np.concatenate([[len(m)], (m >> 32).sum(axis=0), (m & 0xFFFFFFFF).sum(axis=0)])

        got = self._added(part, np.int64)
        return int(got[0]), [(int(a) << 32) + int(b) for a, b in zip(got[1 : d + 1], got[d + 1 :], strict=True)]

    def _added(self, part: Callable[[np.ndarray], np.ndarray], kind: type = np.float64) -> np.ndarray:
        """The sum over all blocks of what part gives for a block, added in tasks, then in groups of tasks, then here."""
        d = self.d

        def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for width, raw in zip(b.column("width").to_pylist(), b.column("raw").to_pylist(), strict=True):
                    got = part(np.frombuffer(raw, f"<i{width}").reshape(-1, d))
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype(kind).tobytes()], pa.binary())], ["raw"])

        def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [np.frombuffer(r, kind) for b in batches for r in b.column("raw").to_pylist()]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([np.sum(held, axis=0).astype(kind).tobytes()], pa.binary())], ["raw"])

        sums = self.blocks.mapInArrow(inner, "raw binary")
        if self.tasks > DIRECT:
            sums = sums.repartition(DIRECT).mapInArrow(outer, "raw binary")
        return np.sum([np.frombuffer(r.raw, kind) for r in sums.collect()], axis=0)

    def product(self, columns: np.ndarray) -> np.ndarray:
        """The covariance times some columns."""
        mean, k = self.mean, columns.shape[1]

        def part(m: np.ndarray) -> np.ndarray:
            c = m - mean
            return (c.T @ (c @ columns)).ravel()

        return self._added(part).reshape(self.d, k) / self.n

    def trace(self) -> float:
        mean = self.mean
        return float(self._added(lambda m: np.array([((m - mean) ** 2).sum()]))[0]) / self.n

    def covariance_of(self, project: np.ndarray) -> np.ndarray:
        """Covariance of the centred vectors' projections, centred by their own mean."""
        mean, k = self.mean, project.shape[1]
        centre = self._added(lambda m: ((m - mean) @ project).sum(axis=0)) / self.n

        def part(m: np.ndarray) -> np.ndarray:
            z = (m - mean) @ project - centre
            return (z.T @ z).ravel()

        return self._added(part).reshape(k, k) / self.n


def _against(t: np.ndarray, *bases: np.ndarray) -> np.ndarray:
    for _ in range(2):
        for q in bases:
            t = t - q @ (q.T @ t)
    return t


def _joined(basis: np.ndarray, locked: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Unit columns that new adds to the basis, orthogonal to it and to the locked ones."""
    added = np.zeros((len(basis), 0))
    for t in new.T:
        size = np.linalg.norm(t)
        if size == 0:
            continue
        t = _against(t[:, None] / size, locked, basis, added)
        left = np.linalg.norm(t)
        if left > 1e-10:
            t = _against(t / left, locked, basis, added)
            added = np.hstack([added, t / np.linalg.norm(t)])
    return added


def minres(product: Callable[[np.ndarray], np.ndarray], shift: np.ndarray, right: np.ndarray, project: Callable[[np.ndarray], np.ndarray], steps: int, goal: float) -> np.ndarray:
    """Solutions of the projected systems (V - shift) t = right, one per column, all in lock step."""
    d, k = right.shape
    x = np.zeros((d, k))
    r = project(right)
    beta = np.linalg.norm(r, axis=0)
    start = np.where(beta > 0, beta, 1.0)
    v, v_old = r / start, np.zeros((d, k))
    w, w_old = np.zeros((d, k)), np.zeros((d, k))
    c, s, c_old, s_old = np.full(k, -1.0), np.zeros(k), np.full(k, -1.0), np.zeros(k)
    rest, b = beta.copy(), np.zeros(k)
    live = beta > 0
    for _ in range(steps):
        if not live.any():
            break
        p = project(product(v) - v * shift)
        a = (v * p).sum(axis=0)
        p = project(p - a * v - b * v_old)
        b_new = np.linalg.norm(p, axis=0)
        # rotations of the last two steps, then this one's
        epsilon, bar = s_old * b, -c_old * b
        delta, gamma_bar = c * bar + s * a, s * bar - c * a
        gamma = np.hypot(gamma_bar, b_new)
        safe = np.where(gamma > 0, gamma, 1.0)
        c_new, s_new = gamma_bar / safe, b_new / safe
        w_new = (v - delta * w - epsilon * w_old) / safe
        x = np.where(live & (gamma > 0), x + (c_new * rest) * w_new, x)
        rest = np.where(live, s_new * rest, rest)
        live = live & (np.abs(rest) > goal * start) & (b_new > 1e-14 * np.maximum(np.abs(a), b)) & (gamma > 0)
        v_old, v = v, np.where(b_new > 0, p / np.where(b_new > 0, b_new, 1.0), 0.0)
        w_old, w, c_old, s_old, c, s, b = w, w_new, c, s, c_new, s_new, b_new
    return x


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = 7, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric positive matrix known by its products, falling, and their unit vectors as columns."""
    k = min(k, d)
    most, keep = max(6 * k, 16), 2 * k
    basis = _joined(np.zeros((d, 0)), np.zeros((d, 0)), np.random.default_rng(seed).normal(size=(d, min(d, k + 2))))
    image = product(basis)
    locked, values = np.zeros((d, 0)), np.zeros(0)
    best, still, scale = np.inf, 0, 0.0
    for turn in range(rounds):
        small = basis.T @ image
        e, y = np.linalg.eigh((small + small.T) / 2)
        e, y = e[::-1], y[:, ::-1]
        scale = max(scale, float(np.abs(e).max(initial=0.0)))
        want = min(k - len(values), len(e))
        u, image_u = basis @ y, image @ y
        r = _against(image_u[:, :want] - u[:, :want] * e[:want], locked)
        size = np.linalg.norm(r, axis=0)
        # rounding of a product: a few units in the last place, growing with the length's root
        level = 8 * _EPS * np.sqrt(d) * scale
        whole = basis.shape[1] + len(values) == d
        done = 0
        while done < want and (size[done] <= level or whole):
            done += 1
        still = 0 if done or size[0] < 0.5 * best else still + 1
        if still >= 3 and size[0] <= 1e3 * level:  # no product gets nearer than this
            done = max(done, 1)
        best = np.inf if done else min(best, size[0])
        if done:
            locked, values = np.hstack([locked, u[:, :done]]), np.append(values, e[:done])
            basis, image = u[:, done:], image_u[:, done:]
            if len(values) == k:
                order = np.argsort(-values, kind="stable")
                return values[order], locked[:, order]
            basis = basis[:, :most]
            image = _against(image[:, :most], locked)
            continue
        if basis.shape[1] + want > most:
            basis, image = u[:, : keep + want], image_u[:, : keep + want]
        theta, own = e[:want], u[:, :want]

        def project(t: np.ndarray, own: np.ndarray = own, locked: np.ndarray = locked) -> np.ndarray:
            t = t - locked @ (locked.T @ t)
            return t - own * (own * t).sum(axis=0)

        t = minres(product, theta, -r, project, steps=min(d, INNER), goal=0.1)
        new = _joined(basis, locked, np.hstack([t, r]) if turn % 4 == 3 else t)
        if not new.shape[1]:
            new = _joined(basis, locked, np.random.default_rng(seed + turn + 1).normal(size=(d, want)))
        basis, image = np.hstack([basis, new]), np.hstack([image, _against(product(new), locked)])
    raise RuntimeError(f"{k - len(values)} eigenpairs have not settled after {rounds} rounds")


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per vector that takes part and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    x = scaled(df, id_col, vec_col)
    fit = FitList(x)
    spark = df.sparkSession
    if not fit.d:
        return spark.createDataFrame([], schema)
    total = fit.trace()
    values, axes = leading_pairs(fit.product, fit.d, components) if total > 0 else (np.zeros(0), np.zeros((fit.d, 0)))
    fine = values > fit.d * _EPS * total
    values, axes = values[fine], axes[:, fine]
    k, n, sums, mean = len(values), fit.n, fit.sums, fit.mean
    if not k:
        return spark.createDataFrame([], schema)
    project = axes / np.sqrt(values)
    off = float(np.abs(fit.covariance_of(project) - np.eye(k)).max())
    top = np.array(sums, object)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _rows(b.column(1))
            if not len(m):
                continue
            z = (m - mean) @ project
            most = n * max(abs(int(m.max())), abs(int(m.min()))) + max(map(abs, sums))
            if most * most * m.shape[1] < 2**63:
                deviation = pa.array(((n * m - top.astype(np.int64)) ** 2).sum(axis=1), pa.int64())
            else:  # integers of any size
                exact = ((n * m.astype(object) - top) ** 2).sum(axis=1).tolist()
                deviation = pa.array([e if e < 2**63 else None for e in exact], pa.int64())
            at = pa.array(np.repeat(np.arange(len(m)), k))
            number = np.tile(np.arange(1, k + 1), len(m))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), pa.array(number, pa.int32()), pa.array(np.full(len(at), n), pa.int64()), deviation.take(at), pa.array(z.ravel()), pa.array((values / total)[number - 1]), pa.array(np.full(len(at), off))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return x.mapInArrow(rows, schema)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
