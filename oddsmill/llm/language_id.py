"""Language identification by error-correcting output codes.

Each language gets a codeword of +1 and -1; for each bit a binary classifier over hashed character n-grams of the whole text
predicts its sign (regularised least squares, solved for all bits at once, by rows or by features, whichever are fewer). A text goes to the language whose
codeword has the least weighted logistic loss against the bits' margins, where a bit weighs by its leave-one-out accuracy;
the score is the softmax of the losses, and a text is ambiguous if the two best are closer than AMBIGUOUS.

Learning uses at most QUOTA rows per language, and MOST_ROWS of all languages together in equal parts: those with the least hashes
of id and text, whatever the table's size; rows of the same id and text count once. Beyond MOST_ROWS languages, the commonest are
learned, a row each; no other language goes unlearned. Prediction sees the text alone. Null text or text without a letter is `und` with score 0; so is all text if there is nothing to learn
from. With one language learned, every text with a letter is of it. Ties go to the language first in order. Repeated rows
and null ids are answered row by row; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches

#: Learning rows per language and of all languages (bounds), feature buckets, code length beyond exhaustive codes, ambiguity.
QUOTA, MOST_ROWS, BUCKETS, LONG_CODE, AMBIGUOUS = 500, 6000, 4096, 48, 0.1
RIDGE, SHARPNESS = 0.05, 4.0


def features(text: str) -> np.ndarray:
    """Unit vector of square-rooted counts of hashed character 1- to 4-grams, lower-cased."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    counts = np.zeros(BUCKETS, np.float32)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, 5):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]) * np.uint64(0xC2B2AE3D27D4EB4F)
        counts += np.bincount((h >> np.uint64(52)).astype(np.int64), minlength=BUCKETS)
    counts = np.sqrt(counts)
    return counts / max(float(np.sqrt((counts**2).sum())), 1e-9)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """(n, bits) of +1 and -1: exhaustive up to 7 languages; else the most separated of many random codes."""
    if n <= 7:
        columns = [[1] + [1 if (i >> j) & 1 else -1 for j in range(n - 1)] for i in range(2 ** (n - 1) - 1)]
        return np.array(columns, np.float32).T.reshape(n, -1)
    rng, best = np.random.default_rng(3), None
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (n, LONG_CODE)).astype(np.float32)
        apart = (LONG_CODE - (m @ m.T)[np.triu_indices(n, 1)]).min()
        if best is None or apart > best[0]:
            best = apart, m
    return best[1]


def ridge(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weights, predictions of rows by the others) of regularised least squares, from the smaller of two systems."""
    n, features_ = x.shape
    if n <= features_:
        inverse = np.linalg.inv((x @ x.T + RIDGE * np.eye(n)).astype(np.float64))
        dual = inverse @ y
        return x.T @ dual, y - dual / np.diag(inverse)[:, None]
    inverse = np.linalg.inv((x.T @ x + RIDGE * np.eye(features_)).astype(np.float64))
    w = inverse @ (x.T @ y)
    leverage = np.concatenate([np.einsum("ij,ij->i", some @ inverse, some) for some in np.array_split(x, n // 1000 + 1)])
    return w, y - (y - x @ w) / (1 - leverage)[:, None]


def fit(x: np.ndarray, langs: list[str]) -> dict | None:
    """A model of features (n, BUCKETS) and their languages."""
    names = sorted(set(langs))
    if not names:
        return None
    code, at = codewords(len(names)), {name: i for i, name in enumerate(names)}
    y = code[[at[lang] for lang in langs]]
    w, left_out = ridge(x, y)
    good = np.clip(((left_out * y) > 0).mean(0), 0.51, 0.999) if y.size else np.zeros(0)
    weights = np.log(good / (1 - good))
    return {"names": names, "code": code, "w": w.astype(np.float32), "weights": (weights / max(weights.sum(), 1e-9)).astype(np.float32)}


def decode(margins: np.ndarray, model: dict) -> tuple[str, float, bool]:
    """(language, score, ambiguous) of a text's margins by loss-weighted decoding."""
    if len(model["names"]) == 1:
        return model["names"][0], 1.0, False
    loss = (np.logaddexp(0, -SHARPNESS * model["code"] * margins[None, :]) * model["weights"]).sum(1)
    p = np.exp(-SHARPNESS * (loss - loss.min()))
    p /= p.sum()
    best = int(p.argmax())
    second = float(np.partition(p, -2)[-2])
    return model["names"][best], float(p[best]), bool(p[best] - second < AMBIGUOUS)


def predictor(model: dict | None):
    """mapInArrow function: (number, text) to (number, lang_pred, score, ambiguous)."""

    def predict(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                out.append(decode(features(text) @ model["w"], model) if model and has_letter(text) else ("und", 0.0, True))
            langs, scores, unclear = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:1], *batch.columns[2:], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unclear, pa.bool_())], names=[batch.schema.names[0], *batch.schema.names[2:], "lang_pred", "score", "ambiguous"])

    return predict


def _features(batches):
    for batch in batches:
        x = [features(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_pydict({"lang": batch.column(0), "x": pa.array([v.tobytes() for v in x], pa.binary())})


def _fitted(batches):
    """mapInArrow function: all rows (lang, x) of the sample to one row, the pickled model."""
    rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    if rows:
        model = fit(np.stack([np.frombuffer(x, np.float32) for _, x in rows]), [lang for lang, _ in rows])
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model)], pa.binary())})


def learn(docs: DataFrame, learning: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    """A model from rows for which learning holds and lang and text are given; texts stay on the executors."""
    small_batches(docs.sparkSession)
    spot = F.shiftrightunsigned(F.xxhash64(id_col, text_col), 4)
    rows = docs.where(learning).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), spot.alias("spot")).where("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("spot").alias("least"))
    langs = counts.orderBy(F.desc("n"), "lang").limit(MOST_ROWS).collect()
    if not langs:
        return None
    quota = min(QUOTA, MOST_ROWS // len(langs))
    # few rows beyond the quota pass, and the least always does, so that repeated rows can't leave a language without any
    bounds = [(r["lang"], max(r["least"], int(min(1.0, 4 * quota / r["n"]) * (1 << 60)))) for r in langs]
    bounds = docs.sparkSession.createDataFrame(bounds, "l string, bound long")
    near = rows.join(F.broadcast(bounds), F.col("lang") == F.col("l")).where("spot <= bound")  # MOST_ROWS rows at most are broadcast
    near = near.groupBy("lang", "spot").agg(F.first("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("spot"))
    picked = near.withColumn("place", place).where(F.col("place") <= quota).select("lang", "text")
    # fitted in a task, whose rows MOST_ROWS bounds: the driver takes only the model
    model = picked.mapInArrow(_features, "lang string, x binary").repartition(1).mapInArrow(_fitted, "model binary").first()
    return pickle.loads(model["model"]) if model else None


def identify(docs: DataFrame, model: dict | None, text_col: str = "text", carry: dict[str, Column] | None = None) -> DataFrame:
    """lang_pred, score and ambiguous for each row, with the columns of carry (name to expression)."""
    small_batches(docs.sparkSession)
    carry = carry or {"doc_id": F.col("doc_id")}
    (first, *others), schema = list(carry), docs.select(*[c.alias(n) for n, c in carry.items()]).schema
    rows = docs.select(carry[first].alias(first), F.col(text_col).alias("text_"), *[carry[n].alias(n) for n in others])
    out = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, lang_pred string, score double, ambiguous boolean"
    return rows.mapInArrow(predictor(model), out)


def known_only(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, to which the model gives a language, clear or ambiguous: each text is decoded, `und` goes."""
    small_batches(docs.sparkSession)
    at, predict = docs.columns.index(text_col), predictor(model)

    def keep(batches):
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], names=["row", "text"])
            (found,) = predict([texts])
            yield batch.filter(pc.not_equal(found.column("lang_pred"), "und"))

    return docs.mapInArrow(keep, docs.schema)
