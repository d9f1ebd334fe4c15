"""Quality scores by random Fourier features, ridge regression and isotonic calibration.

Statistics of a text are turned into cosines of random projections, which approximate a Gaussian
kernel. Each part of the training rows sums its normal equations; the sums of a fixed number of parts
are added and solved. Raw scores are binned, and pooling adjacent violators over the bins gives the
calibration.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.llm.common import sent
from tandem.sources.workspace import stage

FEATURES = 384
WIDTH = 4.0
RIDGE = 1e-3
#: The most labelled rows that are fitted (about; drawn by hash), and the parts that sum them.
MOST_ROWS, PARTS = 200_000, 16
BINS = 2048
FOLDS = 5
THRESHOLD = 0.3
SEED = 11
PUNCTUATION = tuple(b"!#$%&*<>|.,;:?\"'()-_/{}[]=+@")


def statistics(text: str) -> list[float]:
    """Numbers that describe a text, each of a size near 1; the same for every empty text."""
    data = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(1, len(data))
    words = text.split()
    k = max(1, len(words))
    times = Counter(words)
    kinds = len(times)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    lines = [x for x in text.split("\n") if x]
    pairs = len(set(zip(words, words[1:])))
    same = sum(map(str.__eq__, words, words[1:]))
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    share = counts[counts > 0] / n
    top = max(times.values(), default=0)
    ends = sum(x[-1] in ".!?;:" for x in lines)
    return [
        np.log1p(len(data)) / 8,
        np.log1p(k) / 6,
        float(lengths.mean()) / 6,
        float(lengths.std()) / 4,
        kinds / k,
        pairs / k,
        same / k,
        top / k,
        letters / n,
        counts[65:91].sum() / n * 2,
        counts[48:58].sum() / n * 4,
        counts[128:].sum() / n,
        (counts[32] + counts[9]) / n * 4,
        counts[list(PUNCTUATION)].sum() / n * 4,
        sum(counts[c] for c in b"#$%&*<>|~^") / n * 10,
        (counts[33] + counts[63]) / n * 10,
        counts[124] / n * 20,
        counts[46] / k * 4,
        counts[44] / k * 4,
        np.log1p(len(lines)) / 4,
        len(set(lines)) / max(1, len(lines)),
        ends / max(1, len(lines)),
        np.log1p(k / max(1, len(lines))) / 4,
        float(-(share * np.log(share)).sum()) / 3,
    ]


def table_of(texts: list[str]) -> np.ndarray:
    return np.array([statistics(x) for x in texts], np.float64).reshape(len(texts), -1)


@dataclass
class Model:
    """Means and widths of the statistics, the random projection, ridge weights, and calibration."""

    mean: np.ndarray
    scale: np.ndarray
    projection: np.ndarray
    shift: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Cosines of random projections, the statistics themselves, and a constant."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.projection + self.shift) * np.sqrt(2 / len(self.shift))
        return np.hstack([waves, z / 8, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0, 1)


def fold(key: Column) -> Column:
    """The fold of a row, by the checksum of its key as text; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % FOLDS


def isotonic(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rising means nearest to those of the bins: adjacent violators are pooled."""
    blocks: list[list[float]] = []
    for s, c in zip(sums, counts):
        blocks.append([float(s), float(c), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + c, blocks[-1][2] + n]
    return np.concatenate([np.full(int(n), s / c) for s, c, n in blocks])


def _partial(rows: DataFrame, make, size: int) -> np.ndarray:
    """The sum over parts of ``make(statistics, labels)``, an array of ``size`` numbers a part.

    There are PARTS parts, so what reaches the driver does not grow with the rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                x = np.array(some.column(0).to_pylist(), np.float64)
                total += make(x, some.column(1).to_numpy(zero_copy_only=False).astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["total"])

    sums = rows.select("x", "y").mapInArrow(run, "total binary").collect()
    return sum((np.frombuffer(r["total"]) for r in sums), np.zeros(size))


def labelled_statistics(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """(x, y, calibrate) of the labelled rows outside the held-out fold, cut to about ``most_rows``
    by a hash of the key, in PARTS parts. A quarter of them is for calibration."""
    known = labels.filter(F.col("quality").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy(
        "doc_id"
    ).agg(F.max("quality").cast("double").alias("y"))
    draw = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 30))
    n = known.count()
    if n > most_rows:
        known = known.filter(draw < int((1 << 30) * most_rows / n))
    # At most about ``most_rows`` keys and labels, whatever the table: texts stay where they are.
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = rows.select("text", "y", (fold(F.col("doc_id")) == 4).alias("calibrate"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                x = table_of([t or "" for t in some.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.tolist(), pa.list_(pa.float64())), some.column(1), some.column(2)],
                    names=["x", "y", "calibrate"],
                )

    return rows.mapInArrow(run, "x array<double>, y double, calibrate boolean").repartition(PARTS)


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> Model:
    """A model of ``labels.quality`` from the texts of labelled documents outside the held-out fold.

    Null texts count as empty, null labels are left out, a doc_id labelled twice has its larger label.
    Without rows, or with one label only, every text gets the share of label 1 (0.5 without rows).
    """
    rows = stage(labelled_statistics(docs, labels, most_rows), "statistics")
    part = rows.filter(~F.col("calibrate")).coalesce(PARTS)
    d = len(statistics(""))
    sums = _partial(part, lambda x, y: np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)]), 1 + 2 * d)
    n = max(1.0, sums[0])
    mean = sums[1 : 1 + d] / n
    scale = np.sqrt(np.maximum(sums[1 + d :] / n - mean**2, 1e-6))
    random = np.random.default_rng(SEED)
    model = Model(
        mean, scale, random.normal(size=(d, FEATURES)) / WIDTH / np.sqrt(d / 8),
        random.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + d + 1), np.zeros(1), np.zeros(1),
    )
    m = FEATURES + d + 1

    def equations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        f = model.features(x)
        return np.concatenate([(f.T @ f).ravel(), f.T @ y])

    total = _partial(part, equations, m * m + m)
    left = total[: m * m].reshape(m, m)
    model.weights = np.linalg.solve(left + RIDGE * n * np.eye(m) / m, total[m * m :])

    def bins(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        raw = model.raw(x)
        bin = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(bin, w, BINS) for w in (y, np.ones(len(y)), raw)])

    y, count, raw = _partial(rows.filter("calibrate").coalesce(PARTS), bins, 3 * BINS).reshape(3, BINS)
    full = count > 0
    if not full.any():
        share = (total[-1] / n) if sums[0] else 0.5  # the last equation sums the labels
        model.at, model.value = np.zeros(1), np.full(1, share)
        return model
    model.at, model.value = raw[full] / count[full], isotonic(y[full], count[full])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` in a struct ``doc``, and ``score`` (0 to 1): whole texts, in place.

    Null texts count as empty and are scored like them.
    """
    model_here = sent(docs.sparkSession, model)  # of fixed size

    @F.pandas_udf("double")
    def scores(texts):
        import pandas as pd

        out = [
            model_here().score(table_of([x or "" for x in texts.iloc[k : k + 512]]))
            for k in range(0, len(texts), 512)
        ]
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    return docs.select(F.struct(*docs.columns).alias("doc"), scores(F.col("text")).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``; see ``fit`` and ``score``."""
    return score(docs.select("doc_id", "text"), fit(docs, labels)).select(
        F.col("doc.doc_id").alias("doc_id"),
        (fold(F.col("doc.doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


