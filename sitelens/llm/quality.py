"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The Gaussian kernel over standardised statistics is approximated by cosines of random projections. Each partition sums its
normal equations (one D x D matrix), the driver adds at most FIT_PARTITIONS of them and solves the ridge system once; scores
are then calibrated by pooling adjacent violators over a bounded histogram of a calibration fold.

Bounds: at most ``max_fit_rows`` labelled rows enter the fit (about; a share of doc_id hashes, so the choice is repeatable);
statistics and scores cover every row and whole texts.

Defined results: null and empty texts have all-zero statistics and get an ordinary score; rows with a null doc_id are scored and
never held out; labels that are null or repeat with different values are left out or averaged; without any usable label every
score is 0.5; input columns besides the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .common import fresh, materialize, table

FEATURES, FIT_PARTITIONS, THRESHOLD = 256, 16, 0.3
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t",
    "line": b"\n",
    "stop": b".",
    "comma": b",;:",
    "loud": b"!?",
    "bar": b"|\\/",
    "mark": b"#$%&*@^~_+=<>",
    "bracket": b"()[]{}\"'",
    "high": bytes(range(128, 256)),
}
N_STATS = len(_CLASSES) + 10
_LOOKUP = np.zeros((256, len(_CLASSES)))
for _j, _bytes in enumerate(_CLASSES.values()):
    _LOOKUP[np.frombuffer(_bytes, np.uint8), _j] = 1


def statistics(text: str | None) -> list[float]:
    """Statistics of a whole text: shares of byte classes, word shapes, repetition of words, pairs and lines."""
    if not text:
        return [0.0] * N_STATS
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    share = np.bincount(raw, minlength=256) @ _LOOKUP / len(raw)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n, distinct = max(len(words), 1), set(words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    spread = share[share > 0]
    return [
        *share,
        np.log1p(len(text)),
        np.log1p(len(words)),
        len(text) / n / 10,
        len(distinct) / n,
        len(distinct) / np.sqrt(n),
        same,
        sum(w.isupper() for w in distinct) / max(len(distinct), 1),
        sum(not w[-1].isalnum() and w[-1] not in ".,;:" for w in distinct) / max(len(distinct), 1),
        len(set(lines)) / max(len(lines), 1),
        -float((spread * np.log(spread)).sum()),
    ]


@dataclass
class QualityModel:
    """A fitted scorer; its size depends on D and the histogram only."""

    mean: np.ndarray
    std: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.std, -8, 8)
        return np.concatenate([np.sqrt(2 / len(self.phase)) * np.cos(z @ self.omega + self.phase), np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights if len(self.weights) else np.full(len(stats), 0.5)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.knots, self.values), 0, 1) if len(self.knots) else np.clip(self.raw(stats), 0, 1)


def fold_of(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5, F.lit(-1))


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats array<double>) for every row of docs, ties and repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = [statistics(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(stats, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, stats array<double>")


def _normal_equations(model: QualityModel, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sums of z z' and z y; one row for each of a bounded number of partitions reaches the driver."""
    d = len(model.phase) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            if batch.num_rows:
                z, y = model.features(np.array(batch.column(0).to_pylist(), float)), batch.column(1).to_numpy(zero_copy_only=False)
                a += z.T @ z
                b += z.T @ y
        yield pa.RecordBatch.from_pydict({"a": pa.array([a.ravel().tolist()]), "b": pa.array([b.tolist()])})

    parts = rows.select("stats", "y").repartition(FIT_PARTITIONS).mapInArrow(run, "a array<double>, b array<double>").collect()
    return sum(np.array(r.a).reshape(d, d) for r in parts), sum(np.array(r.b) for r in parts)


def pool_adjacent(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of y on sorted x with weights w: centres and values of the pooled blocks."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, w, strict=True):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", ridge: float = 1e-3, seed: int = 7, max_fit_rows: int = 400_000) -> QualityModel:
    """Fit on rows of stats(doc_id, stats) whose fold is not 0, joined with labels(doc_id, label_col)."""
    y = labels.where(F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.avg(F.col(label_col).cast("double")).alias("y"))
    y = y.where((fold_of(F.col("doc_id")) != 0) & F.col("doc_id").isNotNull())
    y = materialize(y, "labels")
    share = min(1.0, max_fit_rows / max(y.count(), 1))
    y = y.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    rows = stats.join(y, "doc_id").select("doc_id", "stats", "y")
    rows = materialize(rows.withColumn("calibrate", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(4)) == 0), "labelled")
    moments = rows.select(F.posexplode("stats")).groupBy("pos").agg(F.avg("col").alias("m"), F.stddev_pop("col").alias("s")).collect()
    rng = np.random.default_rng(seed)
    model = QualityModel(
        np.zeros(N_STATS), np.ones(N_STATS), rng.normal(size=(N_STATS, FEATURES)) * np.sqrt(1 / N_STATS), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(0), np.zeros(0), np.zeros(0)
    )
    if not moments:
        return model
    for r in moments:
        model.mean[r.pos], model.std[r.pos] = r.m, max(r.s or 0, 1e-3)
    a, b = _normal_equations(model, rows.where("NOT calibrate"))
    model.weights = np.linalg.solve(a + ridge * max(np.trace(a) / len(a), 1e-9) * np.eye(len(a)), b)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = model.raw(np.array(batch.column(0).to_pylist(), float))
                yield pa.RecordBatch.from_arrays([pa.array(np.floor(np.clip(raw, -1, 2) * 400).astype(np.int64)), pa.array(raw), batch.column(1)], ["bin", "raw", "y"])

    table_ = rows.where("calibrate").select("stats", "y").mapInArrow(bins, "bin long, raw double, y double")
    hist = sorted(table_.groupBy("bin").agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).collect(), key=lambda r: r.x)
    if hist:
        model.knots, model.values = pool_adjacent(*(np.array([r[c] for r in hist], float) for c in ("x", "y", "n")))
    return model


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) for every row of stats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = model.score(np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, N_STATS))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    stats = materialize(document_statistics(docs), "statistics")
    scored = score(stats, fit(stats, labels))
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier rejects go. Each row is judged by its own text, whatever its doc_id."""
    (name,) = fresh(docs.columns, "stats")
    place, schema = docs.columns.index("text"), docs.schema

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = pa.array([statistics(t.as_py()) for t in b.column(place)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, stats], [*b.schema.names, name])

    rows = materialize(docs.mapInArrow(describe, StructType([*schema, StructField(name, ArrayType(DoubleType()))])), "statistics")
    model = fit(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).alias("stats")), table(spark, sf_dir, "labels"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = model.score(np.array(b.column(b.num_columns - 1).to_pylist(), float).reshape(b.num_rows, N_STATS))
            yield pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1]).filter(pa.array(out >= THRESHOLD))

    return rows.mapInArrow(choose, schema)
