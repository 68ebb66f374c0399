"""K-means and Gaussian mixtures over a column of vectors: each round is one pass with a bounded result, and the driver updates the model."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setflow.functions.scalars import bernoulli, sampling_fraction

RIDGE = 1e-6


def sample_points(df: DataFrame, n: int, key: str, vector: str = "x", seed: int = 0) -> np.ndarray:
    """n points: of a Bernoulli sample that holds so many, those of the least keys."""
    total = df.count()
    if total < n:
        raise ValueError(f"{n} points of {total}")
    draw = 0
    while True:  # a sample too small has the chance 1e-4; then another is drawn
        own = df.where(bernoulli(F.col(key), sampling_fraction(n, total), seed + draw)).orderBy(key).limit(n).select(vector).collect()
        if len(own) == n:
            return np.array([r[0] for r in own], float)
        draw += 1


# --- k-means ----------------------------------------------------------------------------------------


def vectors_of(column: pa.ListArray) -> np.ndarray:
    """A column of vectors of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def assign(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each point, of equals the first; by |x|^2 + |c|^2 - 2xc, exact sums where that is too coarse."""
    square = (points * points).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1)[None]
    d = square - 2 * points @ centroids.T
    best = d.argmin(axis=1)
    least = d[np.arange(len(d)), best]
    unsure = np.flatnonzero((d <= (least + 1e-9 * (1 + square.max(axis=1)))[:, None]).sum(axis=1) > 1)
    for k in unsure.tolist():
        best[k] = ((points[k] - centroids) ** 2).sum(axis=1).argmin()
    return best


def _lloyd(shared, vector: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        sums, n = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = vectors_of(batch[vector])
                best = assign(x, centroids)
                n += np.bincount(best, minlength=len(n))
                np.add.at(sums, best, x)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(n[own]), pa.array(list(sums[own]), pa.list_(pa.float64()))], names=["cluster", "n", "total"])

    return run


def _sum_totals(totals: list, size: int) -> np.ndarray:
    out = np.zeros(size)
    for t in totals:
        out += np.asarray(t)
    return out


def lloyd_step(df: DataFrame, centroids: np.ndarray, vector: str = "x") -> DataFrame:
    """(cluster, n, total): size and sum of the points of each cluster; one row a task and cluster meets in the last sum."""
    shared = df.sparkSession.sparkContext.broadcast(np.asarray(centroids, float))
    part = df.select(vector).mapInArrow(_lloyd(shared, vector), "cluster long, n long, total array<double>")
    flat = part.select("cluster", "n", F.posexplode("total").alias("pos", "v"))
    sums = flat.groupBy("cluster", "pos").agg(F.sum("v").alias("v"))
    vectors = sums.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("total"))
    return part.groupBy("cluster").agg(F.sum("n").alias("n")).join(vectors, "cluster")


def kmeans(df: DataFrame, centroids: np.ndarray, rounds: int = 10, threshold: float = 1e-5, vector: str = "x") -> tuple[np.ndarray, int]:
    """(centroids, rounds run): stops when none moved by more than the threshold; a cluster without points stays where it is."""
    now = np.array(centroids, float)
    for done in range(1, rounds + 1):
        new = now.copy()
        for r in lloyd_step(df, now, vector).collect():  # one row a cluster
            new[r["cluster"]] = np.array(r["total"]) / r["n"]
        moved = np.sqrt(((new - now) ** 2).sum(axis=1)).max()
        now = new
        if moved <= threshold:
            break
    return now, done


# --- Gaussian mixtures ------------------------------------------------------------------------------


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def log_densities(self, x: np.ndarray) -> np.ndarray:
        """log(weight * density) of each point and component."""
        out = np.empty((len(x), len(self.weights)))
        for k, (w, mean, cov) in enumerate(zip(self.weights, self.means, self.covariances)):
            chol = np.linalg.cholesky(cov)
            z = np.linalg.solve(chol, (x - mean).T)
            out[:, k] = np.log(w) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(chol)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
        return out


def log_sum_exp(a: np.ndarray) -> np.ndarray:
    top = a.max(axis=1, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=1, keepdims=True)))[:, 0]


def initial_mixture(samples: np.ndarray, k: int) -> Mixture:
    """Means and diagonal variances of k groups of samples in turn."""
    groups = np.split(samples[: len(samples) // k * k], k)
    return Mixture(np.full(k, 1.0 / k), np.array([g.mean(axis=0) for g in groups]), np.array([np.diag(g.var(axis=0) + RIDGE) for g in groups]))


def _expect(shared, vector: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Mixture = shared.value
        k, d = model.means.shape
        w, wx, wxx, likelihood = np.zeros(k), np.zeros((k, d)), np.zeros((k, d, d)), 0.0
        for batch in batches:
            if batch.num_rows:
                x = vectors_of(batch[vector])
                logs = model.log_densities(x)
                whole = log_sum_exp(logs)
                r = np.exp(logs - whole[:, None])
                likelihood += whole.sum()
                w += r.sum(axis=0)
                wx += r.T @ x
                for c in range(k):
                    wxx[c] += (r[:, c, None] * x).T @ x
        flat = np.concatenate([[likelihood], w, wx.ravel(), wxx.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["pos", "v"])

    return run


def expectation(df: DataFrame, model: Mixture, vector: str = "x") -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihood, sums of r, r x and r x x' by component); the result's size depends on the model alone."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(vector).mapInArrow(_expect(shared, vector), "pos long, v double").groupBy("pos").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(len(rows))
    for r in rows:
        flat[r["pos"]] = r["v"]
    k, d = model.means.shape
    return float(flat[0]), flat[1 : 1 + k], flat[1 + k : 1 + k + k * d].reshape(k, d), flat[1 + k + k * d :].reshape(k, d, d)


def maximise(w: np.ndarray, wx: np.ndarray, wxx: np.ndarray) -> Mixture:
    some = np.maximum(w, 1e-12)
    means = wx / some[:, None]
    covariances = np.array([wxx[c] / some[c] - np.outer(means[c], means[c]) + RIDGE * np.eye(wx.shape[1]) for c in range(len(w))])
    return Mixture(some / some.sum(), means, covariances)


def fit_mixture(df: DataFrame, model: Mixture, rounds: int = 20, tolerance: float = 1e-3, vector: str = "x") -> tuple[Mixture, list[float]]:
    """(mixture, log-likelihood before each round): stops when it changes by less than the tolerance."""
    history: list[float] = []
    for _ in range(rounds):
        likelihood, *sums = expectation(df, model, vector)
        history.append(likelihood)
        if len(history) > 1 and abs(history[-1] - history[-2]) < tolerance:
            break
        model = maximise(*sums)
    return model, history
