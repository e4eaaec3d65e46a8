"""Small models that are fitted on the driver from a bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most labelled rows that a classifier is fitted on.
LABELLED = 20_000


def labelled_sample(labels: DataFrame, label: str, most: int = LABELLED, only: Column | None = None) -> DataFrame:
    """(doc_id, label) of at most ``most`` labelled rows, drawn by a hash of the id; one row for each id.

    Rows without id or label are left out; an id with several labels counts as
    its largest.  The result is bounded, so it may be broadcast.
    """
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    if only is not None:
        rows = rows.filter(only)
    return rows.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps, the constant's last."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    if len(y):
        share = (y.sum() + 0.5) / (len(y) + 1)
        w[-1] = np.log(share / (1 - share))
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6
    for _ in range(steps if len(y) else 0):
        p = sigmoid(a @ w)
        gradient = a.T @ (p - y) + penalty * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-7:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
