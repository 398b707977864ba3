"""Exact top-k by inner product with cover trees over queries and data, searched together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.session import stage

LEAF = 64
#: Vectors in one shard and queries in one group; a pair of them is searched in one task.
SHARD_ROWS = 8192
GROUP_ROWS = 2048
SHRINK = 1.3
#: Products below are exact in doubles; the largest long.
EXACT, LONG = 2.0**52, 2**63 - 1


class CoverTree:
    """Nodes cover their points by a centre and a radius.

    The children of a node have centres that are points, more than ``radius / SHRINK`` apart,
    and cover within that radius. Where so many centres are needed that nothing is gained, the node
    stays a leaf.
    """

    def __init__(self, points: np.ndarray):
        self.points = points
        self.nodes: list[tuple[np.ndarray, np.ndarray, float, float, list[int]]] = []
        self._add(np.arange(len(points)), int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1))))

    def _add(self, rows: np.ndarray, centre: int) -> int:
        c = self.points[centre]
        far = np.sqrt(((self.points[rows] - c) ** 2).sum(axis=1))
        radius = float(far.max())
        number = len(self.nodes)
        self.nodes.append((rows, c, radius, float(np.sqrt(c @ c)), []))
        if len(rows) <= LEAF or radius == 0:
            return number
        left, near, parts = rows, far, []
        pick = centre
        while len(left):
            if len(parts) > len(rows) // 8:
                return number
            within = near <= radius / SHRINK
            parts.append((left[within], pick))
            left = left[~within]
            if len(left):
                pick = int(left[np.argmax(near[~within])])
                near = np.sqrt(((self.points[left] - self.points[pick]) ** 2).sum(axis=1))
        if len(parts) > 1:
            self.nodes[number][4].extend(self._add(part, pick) for part, pick in parts)
        return number


class Best:
    """The k best (score, id) of each query so far; of equal scores the smaller id is better."""

    def __init__(self, query_ids: np.ndarray, k: int):
        self.k, self.ids = k, query_ids
        self.rows: list[list[tuple[float, int]]] = [[] for _ in query_ids]
        self.worst = np.full(len(query_ids), -np.inf)

    def offer(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores >= self.worst[queries][:, None]) & (ids[None, :] != self.ids[queries][:, None])
        for r in np.flatnonzero(good.any(axis=1)):
            q = int(queries[r])
            at = np.flatnonzero(good[r])
            if len(at) > self.k:
                order = np.lexsort((ids[at], -scores[r, at]))[: self.k]
                at = at[order]
            merged = self.rows[q] + [(-float(s), int(i)) for s, i in zip(scores[r, at], ids[at], strict=True)]
            self.rows[q] = sorted(merged)[: self.k]
            if len(self.rows[q]) == self.k:
                self.worst[q] = -self.rows[q][-1][0]


def dual_search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> Best:
    """Every query's k best data rows, by descending both trees.

    No product of a point under one node with one under the other exceeds
    ``<c, d> + r |d| + |c| s + r s`` for centres c, d and radii r, s. A pair of nodes is
    dropped where that is below the worst kth score of the queries under the node.
    """
    best = Best(query_ids, k)
    if not len(queries) or not len(data):
        return best
    left, right = CoverTree(queries), CoverTree(data)

    def bound(a: int, b: int) -> float:
        _, c, r, nc, _ = left.nodes[a]
        _, d, s, nd, _ = right.nodes[b]
        # Scores are whole numbers; half of one is more than rounding can take away.
        return float(c @ d) + r * nd + nc * s + r * s + 0.5

    todo = [(bound(0, 0), 0, 0)]
    while todo:
        high, a, b = todo.pop()
        rows = left.nodes[a][0]
        if high < best.worst[rows].min():
            continue
        down_a, down_b = left.nodes[a][4], right.nodes[b][4]
        if not down_a and not down_b:
            at = right.nodes[b][0]
            best.offer(rows, queries[rows] @ data[at].T, ids[at])
        elif down_b and (not down_a or right.nodes[b][2] >= left.nodes[a][2]):
            todo += sorted((bound(a, x), a, x) for x in down_b)  # the most promising is popped first
        else:
            todo += sorted((bound(x, b), x, b) for x in down_a)
    return best


def plain_search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> Best:
    """``dual_search`` without trees, in Python's integers, for components too large for exact doubles."""
    best = Best(query_ids, k)
    whole = [np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (queries, data)]
    for a in range(0, len(data), LEAF):
        scores = np.clip(whole[0] @ whole[1][a : a + LEAF].T, -LONG, LONG)
        for q, row in enumerate(scores):
            found = [(-int(s), int(i)) for s, i in zip(row, ids[a : a + LEAF], strict=True) if i != query_ids[q]]
            best.rows[q] = sorted(best.rows[q] + found)[:k]
    return best


def _merge_equal(keep: int):
    """Of equal vectors in a batch, the smallest ids: more can be in no result."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.drop_duplicates(["vector", "vec_id"]).sort_values(["vector", "vec_id"], ignore_index=True)
            yield pdf[pdf.groupby("vector").cumcount() < keep]

    return run


def _search(k: int):
    def run(key: tuple, data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        def matrix(pdf: pd.DataFrame) -> np.ndarray:
            flat = np.frombuffer(b"".join(pdf["vector"]), "<f8")
            return flat.reshape(len(pdf), -1)

        out = {"query_id": [], "vec_id": [], "score": []}
        if len(data) and len(queries):
            q, d = matrix(queries), matrix(data)
            largest = max(float(np.abs(q).max(initial=0)), 1) * max(float(np.abs(d).max(initial=0)), 1) * max(q.shape[1], 1)
            search = dual_search if largest < EXACT else plain_search
            best = search(q, queries["vec_id"].to_numpy(), d, data["vec_id"].to_numpy(), k)
            for q_id, rows in zip(best.ids, best.rows, strict=True):
                for score, vec_id in rows:
                    out["query_id"].append(int(q_id))
                    out["vec_id"].append(vec_id)
                    out["score"].append(int(-score))
        return pd.DataFrame(out).astype("int64")

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors scaled to whole numbers, as bytes, with a projection that tells near ones."""
    for batch in batches:
        values = batch.column("v")
        flat = np.floor(256 * values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)) + 0.0
        ends = np.cumsum([0, *values.value_lengths().to_pylist()])
        sign = np.where(np.arange(int(np.diff(ends).max(initial=0))) * 2654435761 % 2**32 < 2**31, 1.0, -1.0)
        rows = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array([len(r) for r in rows], pa.int32()),
             pa.array([r.astype("<f8").tobytes() for r in rows], pa.binary()),
             pa.array([float(r @ sign[: len(r)]) for r in rows])],
            ["vec_id", "dim", "vector", "place"],
        )


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows of every query by integer inner product, all of them if fewer.

    Each component x counts as ``floor(256 x)``. Queries are the rows where ``is_query``
    holds; rows with the query's id are its own and do not count; ties go to the smaller
    id. Rows with a null id or vector, or with a null or non-finite component, take no part;
    a vector scores only with those of its dimension. A repeated query row is asked once,
    a repeated row counts once for each id. Other columns are ignored; an empty table gives no
    rows. Where components are so large that a score could pass 2**52, the shard is multiplied as Python's
    integers, without trees; a score past what a long holds counts as the nearest long.

    Data rows are cut into shards along a projection, queries into groups; each shard meets
    each group in one task, which holds one of both. Of equal vectors only the k + 1
    smallest ids go on, picked in the tasks that read them, so a vector that fills a third of
    the table is a few rows.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).alias("v"), is_query.alias("_query"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(finite)
    packed = stage(
        rows.where("_query").select("vec_id", "v").mapInArrow(_pack, PACKED).dropDuplicates(["vec_id", "vector"]), "queries"
    )
    data = rows.select("vec_id", "v").mapInArrow(_pack, PACKED).mapInPandas(_merge_equal(k + 1), PACKED)
    first = Window.partitionBy("vector").orderBy("vec_id")
    data = data.distinct().withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k + 1).drop("_n")
    data = stage(data, "vectors")
    n, n_queries = data.count(), packed.count()
    shards, groups = max(1, -(-n // SHARD_ROWS)), max(1, -(-n_queries // GROUP_ROWS))
    if shards > 1:
        cuts = data.agg(F.percentile_approx("place", [i / shards for i in range(1, shards)], 100 * shards)).first()[0]
        shard = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col("place")))
    else:
        shard = F.lit(0)
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    # Every shard goes to every group and the other way round: the stated queries against all rows, in blocks.
    each_group, each_shard = F.sequence(F.lit(0), F.lit(groups - 1)), F.sequence(F.lit(0), F.lit(shards - 1))
    left = data.select("dim", shard.alias("_shard"), F.explode(each_group).alias("_group"), "vec_id", "vector")
    right = packed.select("dim", F.explode(each_shard).alias("_shard"), group.alias("_group"), "vec_id", "vector")
    at = ("dim", "_shard", "_group")
    found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(_search(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


PACKED = "vec_id long, dim int, vector binary, place double"
