"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

A document's statistics (length, shares of letter cases and symbols, repeated words and lines, ...) are standardised and
mapped by D random cosines, whose inner products approximate a Gaussian kernel. Each partition sums its part of the normal
equations; Spark adds the parts up, so all labelled rows count and the driver gets D x D numbers however many there are.
Ridge scores of the labelled rows that the fit left out are pooled in BINS bins and made monotone by pooling adjacent
violators; the calibrated score is the chance that the label is 1.

Null text counts as empty and is scored like any other; repeated rows and null ids are scored row by row; without labels
the score is 0.5; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches

FEATURES, RIDGE, BINS, BANDWIDTH = 128, 1e-3, 512, 4.0
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Characters counted by class: an index by code point below 256, beyond that letters count as lower case.
_CLASS = np.full(256, 5, np.int64)
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = 0 if _ch.islower() else 1 if _ch.isupper() else 2 if _ch.isdigit() else 3 if _ch.isspace() else 4 if _ch in ".,;:'\"-" else 5
N_STATS = 20


def statistics(text: str | None) -> np.ndarray:
    """N_STATS numbers of a whole text."""
    text = text or ""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = np.bincount(_CLASS[np.minimum(chars, 255)] * (chars < 256), minlength=6)[:6].astype(float)
    n = max(len(chars), 1)
    words = _WORDS.findall(text)
    w = max(len(words), 1)
    lengths = np.array([len(x) for x in words] or [0], float)
    lines = text.split("\n")
    twice = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lone = sum(1 for x in words if not any(map(str.isalnum, x)))
    ends = sum(1 for x in words if x[-1] in "%$&*#!|=~^<>")
    marks = np.bincount(np.minimum(chars, 127), minlength=128)
    return np.array([np.log1p(len(chars)), np.log1p(len(words)), *(classes / n), lengths.mean() / 10, lengths.std() / 10, lengths.max() / 100, twice / w, lone / w, ends / w, len(set(words)) / w, len(set(lines)) / len(lines), np.log1p(len(lines)), marks[ord("!")] / w, marks[ord("|")] / w, sum(1 for x in words if x[:1].isupper()) / w])


def _statistics(batches):
    for batch in batches:
        x = np.stack([statistics(t) for t in batch.column(1).to_pylist()]) if batch.num_rows else np.zeros((0, N_STATS))
        offsets = np.arange(0, x.size + 1, N_STATS).astype(np.int32)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "x": pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))})


def statistics_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x array<double>), written once: texts are read a single time for learning and scoring."""
    small_batches(docs.sparkSession)
    return cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_statistics, "doc_id long, x array<double>"), "stats")


class Cosines:
    """The random feature map; the last feature is constant."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        rng = np.random.default_rng(11)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w, self.b = rng.normal(0, 1 / BANDWIDTH, (len(mean), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([np.cos(x @ self.w + self.b) * np.sqrt(2 / FEATURES), np.ones((len(x), 1))])


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, N_STATS)


def _equations(cosines: Cosines):
    """mapInArrow function: (x, y) of a partition to the rows (i, part) of its sums; the last column has the right side."""

    def sums(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            z = cosines(_matrix(batch.column(0)))
            total += z.T @ np.hstack([z, np.asarray(batch.column(1), float)[:, None]])
        for i, row in enumerate(total):
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int32()), "part": pa.array([row[i:].tolist()], pa.list_(pa.float64()))})  # symmetric: the upper part

    return sums


def pool(values: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic means and the weight behind each: pools adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        blocks.append([v * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w2, n = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w2
            blocks[-1][2] += n
    n = [int(b[2]) for b in blocks]
    return np.repeat([b[0] / b[1] for b in blocks], n), np.repeat([b[1] for b in blocks], n)


def fit(rows: DataFrame) -> dict | None:
    """A model of rows (x, y, fold): folds 0 are for calibration, others for the ridge fit."""
    moments = rows.select(F.posexplode("x").alias("p", "v")).groupBy("p").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("p").collect()  # N_STATS rows
    if not moments:
        return None
    cosines = Cosines(np.array([r["m"] for r in moments]), np.array([r["s"] for r in moments]))
    parts = rows.where("fold <> 0").select("x", "y").mapInArrow(_equations(cosines), "i int, part array<double>")
    cells = parts.select("i", F.posexplode("part").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    upper = np.zeros((FEATURES + 1, FEATURES + 2))
    for i, j, v in cells:
        upper[i, i + j] = v
    gram = upper[:, :-1] + np.triu(upper[:, :-1], 1).T
    n = max(gram[-1, -1], 1.0)
    w = np.linalg.solve(gram + RIDGE * n / FEATURES * np.eye(FEATURES + 1), upper[:, -1])
    scored = rows.where("fold = 0").select(F.lit(0).cast("long").alias("doc_id"), "x", "y").mapInArrow(_ridge(cosines, w, None), "doc_id long, y double, score double")
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + 0.5) / 2.0 * BINS))).alias("bin")
    bins = scored.groupBy(place).agg(F.avg("score").alias("at"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()  # at most BINS rows
    if not bins:
        return {"cosines": cosines, "w": w, "curve": None}
    at, n = np.array([b["at"] for b in bins]), np.array([b["n"] for b in bins], float)
    prior = float((np.array([b["y"] for b in bins]) * n).sum() / n.sum())
    means, sizes = pool(np.array([b["y"] for b in bins]), n)
    return {"cosines": cosines, "w": w, "curve": (at, np.maximum.accumulate((means * sizes + 0.5 * prior) / (sizes + 0.5)))}


def _ridge(cosines: Cosines, w: np.ndarray, curve):
    """mapInArrow function: (doc_id, x, y...) to (doc_id, y..., score), calibrated if a curve is given."""

    def score(batches):
        for batch in batches:
            s = cosines(_matrix(batch.column(1))) @ w
            s = np.clip(np.interp(s, *curve) + 1e-6 * np.tanh(s), 0, 1) if curve is not None else s
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(s)], names=["doc_id", *batch.schema.names[2:], "score"])

    return score


def score(stats: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score) for each row of a statistics table."""
    if model is None:
        return stats.select("doc_id", F.lit(0.5).alias("score"))
    curve = model["curve"] or (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return stats.select("doc_id", "x").mapInArrow(_ridge(model["cosines"], model["w"], curve), "doc_id long, score double")


def learn(stats: DataFrame, labels: DataFrame, learning: Column, fold: Column, label_col: str = "quality") -> dict | None:
    """A model from the labelled rows for which learning (over doc_id) holds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where(F.col("y").isNotNull() & learning)
    return fit(cut(stats.join(known, "doc_id").select("x", "y", fold.alias("fold")), "labelled"))
