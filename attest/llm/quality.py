"""Quality classifier: naive Bayes support vectors.

Features are indicators of hashed byte n-grams. Each is scaled by the log-ratio of its smoothed
frequencies in the two classes; a linear model with hinge loss is then fitted to the scaled
indicators by dual coordinate descent, and its margins are mapped to probabilities.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import mix, released, ship, text_bytes

#: Hashed features.
BITS = 18
#: Lengths of the byte n-grams.
GRAMS = (2, 3, 4)
#: At most so many labelled rows are expected in the fit; above, a hashed share of them is used.
MOST_LABELLED = 8_000


def grams(data: np.ndarray) -> np.ndarray:
    """The distinct hashed n-grams of one text's bytes, ascending."""
    out = []
    wide = data.astype(np.uint64)
    for n in GRAMS:
        if len(wide) < n:
            continue
        key = np.full(len(wide) - n + 1, np.uint64(n))
        for j in range(n):
            key = key << np.uint64(8) | wide[j : len(wide) - n + 1 + j]
        out.append((mix(key) >> np.uint64(64 - BITS)).astype(np.uint32))
    if not out:
        return np.zeros(0, np.uint32)
    seen = np.zeros(1 << BITS, bool)
    seen[np.concatenate(out)] = True
    return np.flatnonzero(seen).astype(np.uint32)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -500, 500)))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    p, q = (np.full(1 << BITS, smoothing) for _ in range(2))
    for row, label in zip(rows, labels, strict=True):
        (p if label else q)[row] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit_hinge(rows: list[np.ndarray], values: np.ndarray, labels: np.ndarray, c: float = 1.0, epochs: int = 30, tolerance: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float]:
    """min |w|^2/2 + c * sum of hinge losses, over the dual, one coordinate at a time.

    rows hold indices of features; a feature's value in any row that has it is values[feature].
    Rows are scaled to length one. The bias is a feature that every row has.
    """
    y = np.where(labels > 0, 1.0, -1.0)
    ends = np.concatenate([[0], np.cumsum([len(row) for row in rows])])
    every = np.empty(ends[-1], np.float32)
    scaled = [every[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    for row, out in zip(rows, scaled, strict=True):
        x = values[row]
        out[:] = x / max(np.sqrt(x @ x), 1e-12)
    # the rarer class weighs as much as the commoner one
    share = np.array([(y < 0).mean(), (y > 0).mean()])
    upper = np.where(y > 0, c * 0.5 / max(share[1], 1e-9), c * 0.5 / max(share[0], 1e-9))
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            row, x = rows[i], scaled[i]
            g = y[i] * (w[row] @ x + bias) - 1
            step = np.clip(alpha[i] - g / 2, 0, upper[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[row] += step * y[i] * x
                bias += step * y[i]
                most = max(most, abs(step))
        if most < tolerance:
            break
    return w, bias


def margins(rows: list[np.ndarray], values: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    return np.array([(w[r] @ values[r]) / max(np.sqrt(values[r] @ values[r]), 1e-12) + bias for r in rows])


def fit_sigmoid(m: np.ndarray, labels: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift that map margins to probabilities, by Newton steps with smoothed targets."""
    n1, n0 = int((labels > 0).sum()), int((labels <= 0).sum())
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack([m, np.ones_like(m)], 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p))
        theta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(theta[0], 1e-6)), float(theta[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, text and quality of at most about `most` labelled rows outside the held-out fold.

    Documents with several labels count if these agree. If there are more rows than `most`, the
    share that a hash of doc_id selects.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other").drop("other")
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    # bounded by `most`, so it may be sent to all executors
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(known), "id")


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Learns from labelled documents outside the held-out fold.

    Only texts are inputs. Without labelled rows of both classes, every document scores the share
    of good rows (0.5 without any).
    """

    def each(batches):
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            rows = [grams(data[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], ["id", "label", "grams"])

    ship(docs.sparkSession)
    got = labelled_sample(docs, labels, most).select("id", "text", F.col("label").cast("int").alias("label")).mapInArrow(each, "id long, label int, grams binary").toArrow()
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    y = got.column("label").to_numpy()[order].astype(int)
    rows = got.column("grams").combine_chunks() if got.num_rows else []
    x = [np.frombuffer(rows[int(i)].as_buffer(), np.uint32) for i in order]
    if len(set(y)) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    # probabilities are fitted to margins of rows that the margins' model has not seen
    half, part = np.arange(len(y)) % 4 == 0, None
    if len(set(y[half])) == 2 and len(set(y[~half])) == 2:
        part = [r for r, h in zip(x, half, strict=True) if not h]
        ratio = log_count_ratios(part, y[~half])
        w, bias = fit_hinge(part, ratio, y[~half])
        slope, shift = fit_sigmoid(margins([r for r, h in zip(x, half, strict=True) if h], ratio, w, bias), y[half])
    else:
        slope, shift = 1.0, 0.0
    ratio = log_count_ratios(x, y)
    w, bias = fit_hinge(x, ratio, y)
    del got, rows, x, part
    pa.default_memory_pool().release_unused()
    released(docs.sparkSession)
    return Model(np.stack([(w * ratio), ratio * ratio]).astype(np.float32), bias, slope, shift)


def scored(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """score (0 to 1) and predicted (1 from the threshold on) for each document, and doc, its row.

    Whole texts count. Null and empty texts have no n-grams and score what the bias says; repeated
    rows score alike; labels and other columns are never inputs; an empty table gives no rows.
    """
    both = model.weights if model.weights.ndim == 2 else np.zeros((2, 1 << BITS), np.float32)

    def each(batches):
        for batch in batches:
            data, at = text_bytes(batch.column(0).field("text"))
            m = np.empty(batch.num_rows)
            for i in range(batch.num_rows):
                own = grams(data[at[i] : at[i + 1]])
                dot, square = both[:, own].sum(1, dtype=np.float64) if len(own) else (0.0, 0.0)
                m[i] = dot / max(np.sqrt(square), 1e-12) + model.bias
            score = model.scores(m)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc", "score", "predicted"])

    ship(docs.sparkSession)
    taken = docs.select(F.struct(*docs.columns).alias("doc"))
    return taken.mapInArrow(each, StructType([taken.schema["doc"], StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The documents that score at least the threshold, with all their columns."""
    return scored(docs, model, threshold).where("predicted = 1").select("doc.*")
