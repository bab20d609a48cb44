"""Quality scores: random Fourier features, ridge by summed normal equations, isotonic calibration.

Each text becomes ``len(NAMES)`` statistics. ``FEATURES`` random cosines of the
standardised statistics approximate a Gaussian kernel. Every partition of the
training sample sums its part of the normal equations (one fixed-size row per
partition); the driver adds them and solves for the ridge weights. A fifth of
the training rows, left out of the equations, calibrates the raw score by
isotonic regression (pool adjacent violators).

The fit reads a bounded sample of labelled training rows (``SAMPLE``), never
rows of the held-out fold. Scoring reads every text once.

Edge cases: null, empty and blank texts get the score of all-zero statistics;
without labels of both kinds every score is the labels' mean (0.5 without any);
repeated rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, held_out, labelled_sample, materialize, table

#: Most labelled training rows that the model is fitted on, and partitions that sum the equations.
SAMPLE, PARTS = 20_000, 8
#: Random features, width of the kernel in standard deviations times sqrt(statistics), ridge, seed.
FEATURES, WIDTH, RIDGE, SEED = 256, 3.0, 0.01, 7
#: Part of the training rows (of 10) that calibrates.
CALIBRATE = 2

NAMES = [
    "log_bytes", "log_words", "mean_word", "sd_word", "long_words", "short_words", "unique_words", "repeat_next",
    "upper", "lower", "digit", "space", "newline", "comma", "stop", "pipe", "exclaim", "question", "other_ascii",
    "high_bytes", "byte_entropy", "log_lines", "mean_line", "unique_lines", "short_lines", "line_end_stop",
    "upper_words", "symbol_words", "digit_words", "top_word",
]

_LOWER, _UPPER, _DIGIT = (slice(97, 123), slice(65, 91), slice(48, 58))


def statistics(text: str | None) -> np.ndarray:
    """The statistics of a whole text, in the order of NAMES."""
    out = np.zeros(len(NAMES))
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return out
    n, count = len(data), np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(float)
    p = count[count > 0] / n
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    distinct: dict[bytes, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    k = len(words)
    upper = sum(w.isupper() and len(w) > 1 for w in distinct)
    ends = np.frombuffer(b"".join(w[-1:] for w in words), np.uint8)
    lettered = ((ends >= 97) & (ends <= 122)) | ((ends >= 65) & (ends <= 90)) | (ends >= 128)
    numeric = (ends >= 48) & (ends <= 57)
    punct = np.isin(ends, np.frombuffer(b".,;:!?\"')", np.uint8))
    out[:] = [
        np.log1p(n), np.log1p(k), lengths.mean(), lengths.std(), (lengths > 12).mean(), (lengths < 3).mean(), len(distinct) / k,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / k,
        count[_UPPER].sum() / n, count[_LOWER].sum() / n, count[_DIGIT].sum() / n, (count[32] + count[9]) / n, count[10] / n,
        count[44] / n, count[46] / n, count[124] / n, count[33] / n, count[63] / n,
        (count[33:127].sum() - count[_UPPER].sum() - count[_LOWER].sum() - count[_DIGIT].sum() - count[[44, 46, 124, 33, 63]].sum()) / n,
        count[128:].sum() / n, float(-(p * np.log2(p)).sum()), np.log1p(len(lines)), np.log1p(n / len(lines)),
        len(set(lines)) / len(lines), sum(len(x) < 40 for x in lines) / len(lines), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines),
        upper / len(distinct), float((~lettered & ~numeric & ~punct).mean()), float(numeric.mean()), max(distinct.values()) / k,
    ]
    return out


def fourier(width: float = WIDTH, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """(frequencies, phases): the same on every machine."""
    rng = np.random.default_rng(SEED)
    return rng.standard_normal((len(NAMES), features)) / (width * np.sqrt(len(NAMES))), rng.uniform(0, 2 * np.pi, features)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(knots, values) of the least-squares rising fit, by pooling adjacent violators; linear between knots."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    blocks: list[list[float]] = []  # sum of y, rows, sum of x
    for a, b in zip(x, y, strict=True):
        blocks.append([b, 1, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            c = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], c, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class QualityModel:
    """mean, scale, weights (constant last), calibration knots and values; a constant where there is nothing to learn."""

    def __init__(self, mean=None, scale=None, weights=None, knots=None, values=None, constant: float | None = None):
        self.mean, self.scale, self.weights, self.knots, self.values, self.constant = mean, scale, weights, knots, values, constant

    def raw(self, stats: np.ndarray) -> np.ndarray:
        w, b = fourier()
        z = np.cos(np.clip((stats - self.mean) / self.scale, -8, 8) @ w + b) * np.sqrt(2 / FEATURES)
        return z @ self.weights[:-1] + self.weights[-1]

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        raw = self.raw(stats)
        # a small rising part keeps the order of raw scores within a flat step
        return np.clip(0.998 * np.interp(raw, self.knots, self.values) + 0.002 / (1 + np.exp(-4 * np.clip(raw - 0.5, -20, 20))), 0.0, 1.0)


def _sample_statistics(rows: DataFrame) -> DataFrame:
    """(label, calibrates, statistics) of the sample, written once in a few partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = pa.array([statistics(x.as_py()).tolist() for x in batch.column("text")], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("calibrates"), stats], ["label", "calibrates", "stats"])

    chosen = rows.select("text", "label", (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(10)) < CALIBRATE).alias("calibrates"))
    return materialize(chosen.mapInArrow(run, "label int, calibrates boolean, stats array<double>").repartition(PARTS), "quality")


def _summed(df: DataFrame, part) -> list[np.ndarray]:
    """Arrays that ``part(labels, stats)`` gives for each partition, added up; one row of fixed size per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(batch.column("label").to_numpy().astype(float), np.array(batch.column("stats").to_pylist()))
                total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([[a.ravel().tolist() for a in total]], pa.list_(pa.list_(pa.float64())))], ["sums"])

    sums = [[np.array(a) for a in r["sums"]] for r in df.mapInArrow(run, "sums array<array<double>>").collect()]
    return [sum(parts) for parts in zip(*sums, strict=True)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> QualityModel:
    sample = _sample_statistics(labelled_sample(docs, labels, label, bound))
    moments = _summed(sample, lambda y, x: [np.array([len(y), y.sum()]), x.sum(0), (x**2).sum(0)])
    if not moments:
        return QualityModel(constant=0.5)
    (n, positive), first, second = moments
    if positive in (0, n):
        return QualityModel(constant=float(positive / n))
    mean = first / n
    scale = np.sqrt(np.maximum(second / n - mean**2, 1e-12)) + 1e-6

    def normal(y: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        w, b = fourier()
        z = np.hstack([np.cos(np.clip((x - mean) / scale, -8, 8) @ w + b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])
        return [z.T @ z, z.T @ y]

    learn = sample.where("not calibrates")
    equations = _summed(learn, normal)
    if not equations:
        return QualityModel(constant=float(positive / n))
    zz, zy = equations
    d = FEATURES + 1
    ridge = RIDGE * np.diag([*[1.0] * FEATURES, 0.0])
    model = QualityModel(mean, scale, np.linalg.solve(zz.reshape(d, d) + ridge + 1e-9 * np.eye(d), zy))
    rest = sample.where("calibrates").collect() or learn.collect()
    model.knots, model.values = isotonic(model.raw(np.array([r["stats"] for r in rest])), np.array([float(r["label"]) for r in rest]))
    return model


def score_documents(docs: DataFrame, model: QualityModel, carry: list[str]) -> DataFrame:
    """The carried columns (but for any named like a result), score double and stats array<double> (in the order of NAMES)."""
    carry = [c for c in carry if c not in ("score", "stats")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            stats = np.array([statistics(x.as_py()) for x in batch.column(batch.num_columns - 1)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sent.value.score(stats), pa.float64()), pa.array(list(stats), pa.list_(pa.float64()))],
                [*carry, "score", "stats"],
            )

    return docs.select(*carry, F.col("text").alias(free_name("_scored", carry))).mapInArrow(run, f"{schema}, score double, stats array<double>")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_documents(docs, fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
