"""Labelled rows for the classifiers: which are held out, and a bounded sample to fit on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 when divided by 4; false for a null id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most_chars: int) -> DataFrame:
    """``text, y`` of about ``rows`` labelled documents at most, none of them held out.

    The sample is a share of the ids' hashes; texts longer than ``most_chars`` are not fitted on (they are scored).
    Rows without id, text or label are left out. An id that is labelled more than once counts once, with its least
    label; of several texts of one id the least counts.
    """
    own = labels.select("doc_id", F.col(label).alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("y").alias("y"))
    n = own.count()
    if n > rows:
        own = own.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 11) < F.lit(float(2**53) * rows / n))
    texts = docs.select("doc_id", "text").where((F.length("text") <= most_chars) & (F.length("text") > 0))
    return texts.join(own, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).select("text", "y")


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights, the intercept last, by damped Newton steps; works on blocks of rows, so that little is copied."""
    w = np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        slope, bend = penalty * w, penalty * np.eye(len(w))
        for a in range(0, len(x), 20_000):
            own = np.hstack([x[a : a + 20_000], np.ones((len(x[a : a + 20_000]), 1))])
            p = 1 / (1 + np.exp(-np.clip(own @ w, -30, 30)))
            slope += own.T @ (p - y[a : a + 20_000]) / len(y)
            bend += (own * (p * (1 - p))[:, None]).T @ own / len(y)
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
    return w
