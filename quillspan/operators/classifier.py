"""A document classifier that learns from labelled rows: TF-IDF of characters and words, calibrated linear SVMs.

Features are hashed runs of 3 to 5 characters inside words padded by a blank, and single words
and pairs of words, each block weighed by (1 + ln tf) * idf and scaled to length one. For each
class and each of five folds one machine learns from the other folds and is calibrated on its
own; confidences are the mean over folds. Fits run side by side as Spark groups.

Bounds: a fit takes at most ``sample`` labelled documents, a model has ``2 * buckets`` weights for
each class and fold. Scoring covers all rows and whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators import gate

FOLDS = 5
_WORD = re.compile(r"\b\w\w+\b")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_ROW = "fold int, label string, bias double, slope double, shift double, buckets int, idx array<int>, w array<double>"


def _mixed(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h ^ c) * _FACTOR
    return h ^ (h >> np.uint64(29))


def features(text: str | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts): characters in the first ``buckets`` buckets, words in as many behind them; none for null."""
    low = (text or "").lower()
    words = low.split()
    keys = []
    if words:
        c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        inside = c != 32
        h, whole = _mixed(_mixed(np.uint64(0), c[:-1]), c[1:]), np.ones(len(c) - 1, dtype=bool)
        for n in (3, 4, 5):
            if len(c) < n:
                break
            h = _mixed(h[:-1], c[n - 1 :])
            whole = whole[:-1] & inside[n - 2 : len(c) - 1]
            keys.append((h[whole] % np.uint64(buckets)).astype(np.int64))
    tokens = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in _WORD.findall(low)], dtype=np.uint64)
    if len(tokens):
        one = _mixed(tokens, _FACTOR)
        for h in (one, _mixed(one[:-1], tokens[1:])):
            keys.append((h % np.uint64(buckets)).astype(np.int64) + buckets)
    found, counts = np.unique(np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64), return_counts=True)
    return found.astype(np.int32), counts.astype(np.int32)


def weighed(idx: np.ndarray, tf: np.ndarray, idf: np.ndarray, buckets: int) -> np.ndarray:
    """The values of a document's buckets, each block of length one."""
    v = (1 + np.log(tf)) * idf[idx]
    for block in (idx < buckets, idx >= buckets):
        norm = np.sqrt((v[block] ** 2).sum())
        v[block] = v[block] / norm if norm else 0.0
    return v


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, width: int, cost: float = 1.0, rounds: int = 200, enough: float = 1e-3, seed: int = 5) -> np.ndarray:
    """Weights, the bias last, of a linear machine with squared hinge loss, by coordinate descent on the dual."""
    rng = np.random.default_rng(seed)
    w, alpha = np.zeros(width + 1), np.zeros(len(rows))
    square = np.array([1 + (v * v).sum() for _, v in rows]) + 0.5 / cost
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            at, v = rows[i]
            slope = y[i] * (w[at] @ v + w[-1]) - 1 + 0.5 / cost * alpha[i]
            if alpha[i] == 0 and slope >= 0:
                continue
            worst = max(worst, abs(slope))
            step = max(alpha[i] - slope / square[i], 0.0) - alpha[i]
            alpha[i] += step
            w[at] += step * y[i] * v
            w[-1] += step * y[i]
        if worst < enough:
            break
    return w


def calibrated(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the logistic curve of the scores, by damped Newton steps on targets drawn in by class sizes."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([scores, np.ones(len(scores))], axis=1)
    theta = np.array([0.0, np.log((up + 1) / (down + 1))])
    loss = lambda t: np.logaddexp(0, x @ t).sum() - target @ (x @ t)
    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ theta)))
        slope = x.T @ (p - target)
        if np.abs(slope).max() < 1e-8:
            break
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-10 * np.eye(2), slope)
        size = 1.0
        while size > 1e-8 and loss(theta - size * step) > loss(theta):
            size /= 2
        theta = theta - size * step
    return float(theta[0]), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, keep: Callable[[DataFrame], DataFrame], sample: int = 2000, buckets: int = 1 << 16) -> DataFrame:
    """A model's rows, from docs (doc_id, text) and labels (doc_id, label); save them as any table.

    Of the labelled ids the ``sample`` ones with the least hashes count; rows without an id or
    label are left out, rows that share an id all count. Every class needs five rows, and there
    must be two classes, else ValueError.
    """
    drawn = labels.select("doc_id", F.col("label").cast("string").alias("label")).dropna().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)

    @F.pandas_udf("idx array<int>, tf array<int>")
    def hashed(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([features(t, buckets) for t in text], columns=["idx", "tf"])

    read = docs.select("doc_id", "text").join(drawn, "doc_id").select("doc_id", "label", hashed("text").alias("x"))
    dealt = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", F.hash("x")))
    rows = keep(read.select("label", ((dealt - 1) % FOLDS).cast("int").alias("fold"), "x.*"))
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2 or min(sizes.values()) < FOLDS:
        raise ValueError(f"a model needs two classes of {FOLDS} rows each, not {sizes}")
    idf = np.full(2 * buckets, np.log(1 + sum(sizes.values())) + 1)
    for r in rows.select(F.explode("idx").alias("i")).groupBy("i").count().toLocalIterator():
        idf[r["i"]] = np.log((1 + sum(sizes.values())) / (1 + r["count"])) + 1

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        fold, label = key
        xs = [(i, weighed(i, t, idf, buckets)) for i, t in zip(group["idx"], group["tf"], strict=True)]
        y = np.where(group["label"] == label, 1.0, -1.0)
        own = (group["fold"] == fold).to_numpy()
        w = fit_svm([x for x, o in zip(xs, own, strict=True) if not o], y[~own], 2 * buckets)
        slope, shift = calibrated(np.array([w[i] @ v + w[-1] for (i, v), o in zip(xs, own, strict=True) if o]), y[own])
        at = np.flatnonzero(w[:-1])
        return pd.DataFrame([(fold, label, w[-1], slope, shift, buckets, at.astype(np.int32), w[at])], columns=[c.split()[0] for c in _ROW.split(", ")])

    # Of two classes the first is what the second leaves.
    known = sorted(sizes)
    machines = F.array(*[F.struct(F.lit(f).alias("fit_fold"), F.lit(c).alias("fit_label")) for f in range(FOLDS) for c in (known[1:] if len(known) == 2 else known)])
    fits = rows.select("*", F.explode(machines).alias("m")).select("label", "fold", "idx", "tf", "m.*").groupBy("fit_fold", "fit_label").applyInPandas(fit, _ROW)
    spark = docs.sparkSession
    base = (-1, known[0] if len(known) == 2 else None, 0.0, 0.0, 0.0, buckets, list(range(2 * buckets)), idf.tolist())
    return keep(fits.unionByName(spark.createDataFrame([base], _ROW)))


@dataclass
class Model:
    """The weights as each worker holds them."""

    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    curves: np.ndarray
    buckets: int

    def confidences(self, text: str | None) -> np.ndarray:
        """One for each label, in their order; they add up to 1."""
        idx, tf = features(text, self.buckets)
        scores = self.weights[:, :, idx] @ weighed(idx, tf, self.idf, self.buckets) + self.curves[:, :, 0]
        each = (1 / (1 + np.exp(-(self.curves[:, :, 1] * scores + self.curves[:, :, 2])))).T
        both = np.stack([1 - each[:, 0], each[:, 0]], axis=1) if len(self.labels) == 2 else each
        total = both.sum(axis=1, keepdims=True)
        return np.where(total > 0, both / np.where(total > 0, total, 1), 1 / len(self.labels)).mean(axis=0)


def load(rows: DataFrame) -> Model | None:
    """The model of a table that ``train`` made, which its bounds keep small; None for an empty table."""
    fitted = rows.collect()
    base = next((r for r in fitted if r["fold"] < 0), None)
    if base is None:
        return None
    learnt = sorted({r["label"] for r in fitted if r["fold"] >= 0})
    width = 2 * base["buckets"]
    weights, curves = np.zeros((len(learnt), FOLDS, width)), np.zeros((len(learnt), FOLDS, 3))
    for r in fitted:
        if r["fold"] >= 0:
            at = learnt.index(r["label"]), r["fold"]
            weights[at][np.array(r["idx"], dtype=np.int64)] = r["w"]
            curves[at] = r["bias"], r["slope"], r["shift"]
    return Model(([base["label"]] if base["label"] is not None else []) + learnt, np.array(base["w"]), weights, curves, base["buckets"])


def classify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with doc_type and doc_confidence by the model; without a model by anchors, as the gate has it.

    Ties go to the label that sorts first. Null and empty texts get what the biases say.
    """
    if model is None:
        return gate.add_class(gate.add_language(docs, text), text)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("label string, confidence double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            p = held.value.confidences(t)
            out.append((held.value.labels[int(p.argmax())], float(p.max())))
        return pd.DataFrame(out, columns=["label", "confidence"])

    scored = docs.withColumn("_judged", judged(F.col(text)))
    return scored.withColumns({"doc_type": F.col("_judged.label"), "doc_confidence": F.col("_judged.confidence")}).drop("_judged")
