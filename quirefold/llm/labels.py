"""Labelled training rows and held-out folds, shared by the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled rows outside the held-out fold, the first by a hash of their ids.

    Rows whose label is null or contradicted by another row of the same id take no part. The ids of the sample (16 bytes
    each, so at most 16 x most) are broadcast; texts are not shuffled.
    """
    y = F.col(label).cast("int")
    clear = labels.select("doc_id", y.alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("__top")).where("y = __top").drop("__top")
    picked = clear.where(fold(F.col("doc_id"), folds) != held_out).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weights, the intercept last, of a ridge-penalised logistic regression by Newton's method with halved steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[-1] = 1e-6
    n = max(len(y), 1)

    def loss(v: np.ndarray) -> float:
        z = np.clip(a @ v, -500, 500)
        return float(np.sum(np.logaddexp(0, z) - y * z) / n + 0.5 * penalty @ (v * v))

    for _ in range(steps):
        p = sigmoid(a @ w)
        g = a.T @ (p - y) / n + penalty * w
        h = (a * (p * (1 - p))[:, None]).T @ a / n + np.diag(penalty + 1e-9)
        step = np.linalg.solve(h, g)
        now, size = loss(w), 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w
