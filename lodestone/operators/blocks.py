"""Blocks of vectors: what the searches for neighbours share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DISTANCE_DIGITS = 6
SCALE = 10**DISTANCE_DIGITS
_STEP, _ROWS = 256, 4_096
#: Beyond one pair in so many, sorting all is faster than picking.
_CROWD = 8
#: Bytes of vectors that picked pairs are scored with at a time.
_PAIR_BYTES = 8 << 20

HITS = "query_id long, id long, distance double"
HITS_ARROW = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("distance", pa.float64())])


def matrix(column) -> np.ndarray:
    """An Arrow list column as rows of its own type, without a copy where nothing in it is null."""
    n = len(column)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if n and (sizes != sizes[0]).any():
        raise ValueError("vectors of different dimensions in one column")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows as float64, scaled to unit length (zero rows become NaN)."""
    rows = rows.astype(np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    return rows


def unit_matrix(column) -> np.ndarray:
    return scaled(matrix(column))


class Best:
    """The k nearest rows seen so far for each query, ties going to the smaller id.

    ``kth`` are distances beyond which a query wants no row, where they are known (NaN where not).
    """

    def __init__(self, n_queries: int, k: int, kth: np.ndarray | None = None):
        self.k = k
        self.far = np.iinfo(np.int64).max
        self.steps = np.full((n_queries, k), self.far)
        self.ids = np.full((n_queries, k), self.far)
        self.wanted = np.full(n_queries, self.far)
        if kth is not None:
            known = np.isfinite(kth)
            self.wanted[known] = np.rint(kth[known] * SCALE).astype(np.int64)

    def offer(self, which: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        """Score every query in ``which`` against ``rows``, whose ids ascend.

        Where a query has k rows, single precision rules out all that are farther by more than its error; only what is
        left is scored and sorted.
        """
        # Unit vectors: the error of a sum of n products in single precision is below n units in the last place.
        slack = (rows.shape[1] + 8) * 2.0**-23 if rows.ndim == 2 else 0.0
        for start in range(0, len(rows), _ROWS):
            some, names = rows[start : start + _ROWS], ids[start : start + _ROWS]
            rough = np.ascontiguousarray(some.T, dtype=np.float32)
            for at in range(0, len(which), _STEP):
                q = which[at : at + _STEP]
                last = np.minimum(self.steps[q, -1], self.wanted[q])
                bounded = last <= 2 * SCALE
                if not bounded.all():
                    self._dense(q[~bounded], queries, names, some)
                    q, last = q[bounded], last[bounded]
                    if not len(q):
                        continue
                vectors = queries[q]
                least = (1.0 - (last + 1) / SCALE - slack).astype(np.float32)
                near = np.flatnonzero(vectors.astype(np.float32) @ rough >= least[:, None])
                if not len(near):
                    continue
                if _CROWD * len(near) > len(q) * len(some):
                    self._dense(q, queries, names, some)
                    continue
                asking, place = np.divmod(near, len(some))
                steps = self._steps(vectors, asking, some, place)
                worst = np.where(self.steps[q, -1] == last, self.ids[q, -1], self.far)
                enter = (steps < last[asking]) | ((steps == last[asking]) & (names[place] < worst[asking]))
                self._merge(q, asking[enter], steps[enter], names[place[enter]])

    @staticmethod
    def _steps(vectors: np.ndarray, asking: np.ndarray, rows: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Distances of the pairs, of which up to one in ``_CROWD`` are picked: their vectors are never all there at once."""
        steps = np.empty(len(asking), np.int64)
        pairs = max(1, _PAIR_BYTES // (16 * rows.shape[1]))
        for at in range(0, len(asking), pairs):
            c = slice(at, at + pairs)
            steps[c] = np.rint((1.0 - np.einsum("ij,ij->i", vectors[asking[c]], rows[place[c]])) * SCALE)
        return steps

    def _dense(self, q: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        n = len(rows)
        steps = queries[q] @ rows.T
        np.subtract(1.0, steps, out=steps)
        steps *= SCALE
        np.rint(steps, out=steps)
        steps[np.isnan(steps)] = self.far // (2 * n)
        key = steps.astype(np.int64)
        key *= n
        key += np.arange(n)
        if n > self.k:
            key.partition(self.k - 1, axis=1)
            key = key[:, : self.k]
        self._take(q, key // n, ids[key % n])

    def _merge(self, q: np.ndarray, asking: np.ndarray, steps: np.ndarray, ids: np.ndarray):
        """Take rows listed by the place of their query in ``q``, ascending."""
        if not len(asking):
            return
        touched, begin, count = np.unique(asking, return_index=True, return_counts=True)
        line = np.repeat(np.arange(len(touched)), count)
        column = np.arange(len(asking)) - np.repeat(begin, count)
        wide = np.full((2, len(touched), count.max()), self.far)
        wide[0, line, column], wide[1, line, column] = steps, ids
        self._take(q[touched], wide[0], wide[1])

    def _take(self, q: np.ndarray, steps: np.ndarray, ids: np.ndarray):
        steps = np.concatenate([self.steps[q], steps], axis=1)
        found = np.concatenate([self.ids[q], ids], axis=1)
        order = np.lexsort((found, steps), axis=1)[:, : self.k]
        self.steps[q] = np.take_along_axis(steps, order, axis=1)
        self.ids[q] = np.take_along_axis(found, order, axis=1)

    def hits(self, query_ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        there = (self.ids != self.far) & (self.steps <= 2 * SCALE)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(query_ids, there.sum(axis=1)), pa.int64()),
                pa.array(self.ids[there], pa.int64()),
                pa.array(self.steps[there] / SCALE, pa.float64()),
            ],
            schema=HITS_ARROW,
        )


def vectors_of(df: DataFrame, key: str, vector: str, name: str, extra=()) -> DataFrame:
    return df.select(F.col(key).cast("long").alias(name), F.col(vector).alias("v"), *extra).where(
        F.col("v").isNotNull() & F.col(name).isNotNull()
    )


def top_per_query(hits: DataFrame, k: int, order: list[Column], rank: str = "rank") -> DataFrame:
    """Keep the first ``k`` rows of each query; Spark prunes to k per task before the shuffle."""
    w = Window.partitionBy("query_id").orderBy(*order)
    ranked = hits.withColumn(rank, F.row_number().over(w))
    return ranked.where(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))
