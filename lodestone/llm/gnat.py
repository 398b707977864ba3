"""Hard negatives: exact windows of inner products, searched with trees of multiway hyperplane splits."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.session import stage

#: Rows of a leaf, split points of a node.
LEAF, FANOUT = 64, 8
#: Split points of the top level, which all tasks hold, and rows that one of them stands for while there are fewer.
MOST_REGIONS, REGION_ROWS = 256, 2048
#: Rows of a region that one task searches, and queries that it takes at once.
CHUNK_ROWS, QUERY_ROWS = 8192, 1024
#: More than rounding can take from or add to a distance.
SLACK = 1e-6
#: Products and squares below are exact in doubles.
EXACT = 2.0**52
LONG = 2**63 - 1


def _squares(points: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", points, points)


def _distances(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Distances of whole-number vectors: their squares are exact, so only the root is rounded."""
    return np.sqrt(np.maximum(_squares(points)[:, None] + _squares(others)[None, :] - 2 * (points @ others.T), 0))


class Ranges:
    """Split points, the points nearest to each of them, and how far each split point is from the points of each.

    ``low[i, j]`` and ``high[i, j]`` bound the distances of split point i to the points of part j;
    ``thin[j]`` and ``thick[j]`` bound the squared lengths of the points of part j.
    """

    def __init__(self, splits: np.ndarray, low: np.ndarray, high: np.ndarray, thin: np.ndarray, thick: np.ndarray):
        self.splits, self.low, self.high, self.thin, self.thick = splits, low, high, thin, thick

    def alive(self, j: int, far: np.ndarray, squares: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which queries can score from ``least`` to ``most`` with a point of part j, being ``far`` from the split points.

        The window of scores and the lengths in the part make a ring of distances around the query. A split
        point i sees the ring's points between ``far - outer`` (or ``inner - far``) and ``far + outer`` away.
        """
        outer = squares + self.thick[j] - 2 * least
        inner = np.sqrt(np.maximum(squares + self.thin[j] - 2 * most, 0))
        reach = np.sqrt(np.maximum(outer, 0))[:, None]
        nearest = np.maximum(far - reach, inner[:, None] - far) - SLACK
        return (outer >= 0) & ((self.low[:, j] <= far + reach + SLACK) & (self.high[:, j] >= nearest)).all(axis=1)


class Tree:
    """Points of whole numbers, parted again and again by their nearest split point down to leaves."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.nodes: list[np.ndarray | tuple[Ranges, list[int]]] = []
        squares = _squares(points)
        todo: list[tuple[np.ndarray, list[int], int]] = [(np.arange(len(points)), [], 0)]
        while todo:
            rows, siblings, place = todo.pop()
            if siblings:
                siblings[place] = len(self.nodes)
            parts, splits = self._parts(rows)
            if len(parts) < 2:
                self.nodes.append(rows)
                continue
            far = [_distances(points[splits], points[p]) for p in parts]
            ranges = Ranges(
                points[splits], np.stack([f.min(axis=1) for f in far], axis=1), np.stack([f.max(axis=1) for f in far], axis=1),
                np.array([squares[p].min() for p in parts]), np.array([squares[p].max() for p in parts]),
            )
            children = [0] * len(parts)
            self.nodes.append((ranges, children))
            todo += [(p, children, i) for i, p in enumerate(parts)]

    def _parts(self, rows: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The rows by their nearest split point, and the split points: far apart ones of a spread sample."""
        if len(rows) <= LEAF:
            return [rows], rows[:0]
        sample = rows[np.linspace(0, len(rows) - 1, min(len(rows), 4 * FANOUT)).astype(np.int64)]
        between = _distances(self.points[sample], self.points[sample])
        chosen = [0]
        while len(chosen) < FANOUT:
            gap = between[chosen].min(axis=0)
            if gap.max() == 0:
                break
            chosen.append(int(gap.argmax()))
        splits = sample[chosen]
        nearest = _distances(self.points[rows], self.points[splits]).argmin(axis=1)
        used = np.unique(nearest)
        return [rows[nearest == j] for j in used], splits[used]


class Queries:
    """Queries of one batch with the k best rows of each so far; of equal scores the smaller id is better."""

    def __init__(self, points, own, labels, same, least, most, k):
        self.points, self.own, self.labels, self.same, self.most, self.k = points, own, labels, same, most, k
        #: The score that a row must reach, which rises to the kth best.
        self.least = least
        self.best: list[list[tuple[int, int]]] = [[] for _ in own]
        self.products = 0

    def offer(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        self.products += scores.size
        alike = labels[None, :] == self.labels[at][:, None]
        good = (scores >= self.least[at][:, None]) & (scores <= self.most[at][:, None])
        good &= (alike == self.same[at][:, None]) & (ids[None, :] != self.own[at][:, None])
        for r in np.flatnonzero(good.any(axis=1)):
            q, columns = int(at[r]), np.flatnonzero(good[r])
            found = [(-int(s), int(i)) for s, i in zip(scores[r, columns], ids[columns], strict=True)]
            self.best[q] = sorted({*self.best[q], *found})[: self.k]
            if len(self.best[q]) == self.k:
                self.least[q] = max(self.least[q], -self.best[q][-1][0])


def tree_search(tree: Tree, ids: np.ndarray, labels: np.ndarray, queries: Queries) -> None:
    """Every query's k best rows of its window: first the leaf it falls into, then all that the ranges cannot rule out."""
    squares, first = _squares(queries.points), np.full(len(queries.own), -1)

    def leaf(rows: np.ndarray, at: np.ndarray) -> None:
        queries.offer(at, queries.points[at] @ tree.points[rows].T, ids[rows], labels[rows])

    todo = [(0, np.arange(len(queries.own)))]
    while todo:
        number, at = todo.pop()
        node = tree.nodes[number]
        if isinstance(node, tuple):
            nearest = _distances(queries.points[at], node[0].splits).argmin(axis=1)
            todo += [(node[1][j], at[nearest == j]) for j in np.unique(nearest)]
        else:
            first[at] = number
            leaf(node, at)
    todo = [(0, np.arange(len(queries.own)))]
    while todo:
        number, at = todo.pop()
        node = tree.nodes[number]
        if isinstance(node, tuple):
            ranges, children = node
            far = _distances(queries.points[at], ranges.splits)
            for j in np.argsort(-far.mean(axis=0)):  # the nearest part is popped first
                left = at[ranges.alive(j, far, squares[at], queries.least[at], queries.most[at])]
                if len(left):
                    todo.append((children[j], left))
        else:
            at = at[first[at] != number]
            if len(at):
                leaf(node, at)


def scan(points: list[list[int]], ids: np.ndarray, labels: np.ndarray, queries: Queries) -> None:
    """Like ``tree_search`` with Python's integers, for components too large for exact doubles."""
    data = np.array(points, object).reshape(len(points), -1)
    for a in range(0, len(queries.own), LEAF):
        at = np.arange(a, min(a + LEAF, len(queries.own)))
        for b in range(0, len(data), LEAF):
            rows = slice(b, b + LEAF)
            scores = np.clip(queries.points[at] @ data[rows].T, -LONG, LONG)
            queries.offer(at, scores, ids[rows], labels[rows])


def _matrix(vectors: pa.Array | list[bytes], dim: int) -> np.ndarray:
    data = vectors if isinstance(vectors, list) else vectors.to_pylist()
    return np.frombuffer(b"".join(data), "<f8").reshape(len(data), dim)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as the bytes of whole numbers, 256 times their components and rounded down."""
    for batch in batches:
        values = batch.column("v")
        flat = np.floor(256 * values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)) + 0.0
        ends = np.append(0, np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False)))
        data = [flat[a:b].astype("<f8").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), batch.column("anchor"),
             pa.array(np.diff(ends), pa.int32()), pa.array(data, pa.binary())],
            ["vec_id", "label", "anchor", "dim", "vector"],
        )


def _nearest(splits: dict[int, np.ndarray]) -> Callable:
    """Adds to each row the number of its nearest split point; 0 where its dimension has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            region = np.zeros(len(dims), np.int32)
            for dim in np.unique(dims):
                if int(dim) in splits:
                    at = np.flatnonzero(dims == dim)
                    region[at] = _distances(_matrix(batch.column("vector").take(pa.array(at)), int(dim)), splits[int(dim)]).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(region)], [*batch.schema.names, "region"])

    return run


def _partial_ranges(splits: dict[int, np.ndarray]) -> Callable:
    """Of the rows that a task reads: how far they are from all split points, by region."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, int], list] = {}
        for pdf in batches:
            for (dim, region), part in pdf.groupby(["dim", "region"]):
                points = _matrix(list(part["vector"]), int(dim))
                far, squares = _distances(splits[int(dim)], points) if int(dim) in splits else np.zeros((1, len(points))), _squares(points)
                new = [len(points), far.min(axis=1), far.max(axis=1), squares.min(), squares.max()]
                old = seen.get((dim, region))
                seen[dim, region] = new if old is None else _joined(old, new)
        out = [(d, r, n, lo.tolist(), hi.tolist(), thin, thick) for (d, r), (n, lo, hi, thin, thick) in seen.items()]
        yield pd.DataFrame(out, columns=["dim", "region", "n", "low", "high", "thin", "thick"])

    return run


def _joined(a: list, b: list) -> list:
    return [a[0] + b[0], np.minimum(a[1], b[1]), np.maximum(a[2], b[2]), min(a[3], b[3]), max(a[4], b[4])]


def _join_ranges(pdf: pd.DataFrame) -> pd.DataFrame:
    low, high = np.stack(list(pdf["low"])).min(axis=0), np.stack(list(pdf["high"])).max(axis=0)
    first = pdf.iloc[0]
    row = (first["dim"], first["region"], pdf["n"].sum(), low.tolist(), high.tolist(), pdf["thin"].min(), pdf["thick"].max())
    return pd.DataFrame([row], columns=list(pdf.columns))


RANGES = "dim int, region int, n long, low array<double>, high array<double>, thin double, thick double"


def _window(positive: pa.Array, reached: pa.Array, near: int, far: int) -> tuple[list, list]:
    """The least and the most that a row may score; everything where no positive's score is given."""
    least, most = [], []
    for p, r in zip(positive.to_pylist(), reached.to_pylist(), strict=True):
        low, high = (-math.inf, math.inf) if p is None else (-(-far * p // 100), near * p // 100)
        least.append(low if r is None else max(low, r))
        most.append(high)
    return least, most


def _route(tops: dict[int, tuple[Ranges, list[int], list[int]]], own: bool, near: int, far: int) -> Callable:
    """Copies each query to the chunks of its own region, or to those of all other regions that the ranges cannot rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            least, most = _window(batch.column("positive_score"), batch.column("reached"), near, far)
            rows, regions, chunks = [], [], []
            for dim in np.unique(dims):
                if int(dim) not in tops:
                    continue
                ranges, numbers, sizes = tops[int(dim)]
                at = np.flatnonzero(dims == dim)
                points = _matrix(batch.column("vector").take(pa.array(at)), int(dim))
                far_off, squares = _distances(points, ranges.splits), _squares(points)
                home = far_off.argmin(axis=1)
                low, high = np.array([float(least[i]) for i in at]), np.array([float(most[i]) for i in at])
                exact = (squares < EXACT) & (ranges.thick.max(initial=0) < EXACT)
                for j, (number, size) in enumerate(zip(numbers, sizes, strict=True)):
                    here = home == number
                    if not own:
                        here = ~here & (~exact | ranges.alive(j, far_off, squares, low, high))
                    went = np.repeat(at[here], size)
                    rows.append(went)
                    regions.append(np.full(len(went), number, np.int32))
                    chunks.append(np.tile(np.arange(size, dtype=np.int32), int(here.sum())))
            taken = batch.take(pa.array(np.concatenate([*rows, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(np.concatenate([*regions, np.zeros(0, np.int32)])),
                 pa.array(np.concatenate([*chunks, np.zeros(0, np.int32)]))],
                [*batch.schema.names, "region", "chunk"],
            )

    return run


def _shards(k: int, near: int, far: int) -> Callable:
    """Reads rows and then queries of one chunk after the other, and answers the queries as they come."""

    def answer(data: list[pa.RecordBatch], index: list, asked: pa.RecordBatch) -> pa.RecordBatch:
        dim = asked.column("dim")[0].as_py()
        if not index:
            ids = np.concatenate([b.column("vec_id").to_numpy() for b in data])
            labels = np.concatenate([b.column("label").to_numpy() for b in data])
            points = np.concatenate([_matrix(b.column("vector"), dim) for b in data])
            index += [ids, labels, points, None]
        ids, labels, points, tree = index
        q = _matrix(asked.column("vector"), dim)
        least, most = _window(asked.column("positive_score"), asked.column("reached"), near, far)
        # Products, squares and what windows make of them all have to be exact.
        largest = max(np.abs(points).max(initial=0), np.abs(q).max(initial=0), 1)
        exact = largest * largest * max(dim, 1) * 4 < EXACT
        kind = np.float64 if exact else object
        queries = Queries(
            q if exact else np.array([[int(x) for x in row] for row in q], object).reshape(len(q), -1),
            asked.column("vec_id").to_numpy(), asked.column("label").to_numpy(),
            np.array(asked.column("positive_score").is_null().to_pylist(), bool), np.array(least, kind), np.array(most, kind), k,
        )
        if exact:
            if tree is None:
                tree = index[3] = Tree(points)
            tree_search(tree, ids, labels, queries)
        else:
            scan([[int(x) for x in row] for row in points], ids, labels, queries)
        sizes = [len(b) for b in queries.best]
        out = asked.select(["vec_id", "mark", "positive_id", "positive_score"]).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        found = [x for best in queries.best for x in best]
        return pa.RecordBatch.from_arrays(
            [*out.columns, pa.array([i for _, i in found], pa.int64()), pa.array([-s for s, _ in found], pa.int64())],
            ["anchor_id", "mark", "positive_id", "positive_score", "vec_id", "score"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, data, index = None, [], []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "region", "chunk", "asked")])
            cuts = np.append(0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1) if len(batch) else []
            for a, b in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                key, part = tuple(keys[:3, a].tolist()), batch.slice(a, b - a)
                if key != here:
                    here, data, index = key, [], []
                if not keys[3, a]:
                    data.append(part)
                elif data:
                    for c in range(0, len(part), QUERY_ROWS):
                        yield answer(data, index, part.slice(c, QUERY_ROWS))

    return run


FOUND = "anchor_id long, mark long, positive_id long, positive_score long, vec_id long, score long"
QUERY = ("vec_id", "label", "dim", "vector", "mark", "positive_id", "positive_score", "reached")


class Forest:
    """Vectors by region and chunk, each chunk searched by a tree of its own.

    Regions are the points nearest to one of at most ``MOST_REGIONS`` split points, a sample picked by
    hash; like the nodes of a tree they keep the distances of all split points to their points, so a
    query goes only to regions that its ring meets. A region's rows are dealt by hash to chunks of
    bounded size, so one that holds a third of all rows is many tasks.
    """

    def __init__(self, points: DataFrame):
        """``points`` has ``vec_id, label, dim, vector``."""
        m = min(MOST_REGIONS, -(-points.count() // REGION_ROWS))
        chosen = points.orderBy(F.xxhash64("vector", "label", "vec_id"), "vec_id").limit(m).select("dim", "vector").collect()
        by_dim: dict[int, list[bytes]] = {}
        for row in chosen:
            by_dim.setdefault(row["dim"], []).append(bytes(row["vector"]))
        splits = {dim: np.unique(_matrix(data, dim), axis=0) for dim, data in by_dim.items()}
        fields = "vec_id long, label long, dim int, vector binary, region int"
        placed = points.select("vec_id", "label", "dim", "vector").mapInArrow(_nearest(splits), fields)
        self.placed = stage(placed, "regions")
        partial = self.placed.select("dim", "region", "vector").mapInPandas(_partial_ranges(splits), RANGES)
        found = partial.groupBy("dim", "region").applyInPandas(_join_ranges, RANGES).collect()
        self.tops: dict[int, tuple[Ranges, list[int], list[int]]] = {}
        sizes: dict[tuple[int, int], int] = {}
        for dim in {r["dim"] for r in found}:
            rows = sorted((r for r in found if r["dim"] == dim), key=lambda r: r["region"])
            ranges = Ranges(
                splits.get(dim, np.zeros((1, dim))), np.array([r["low"] for r in rows]).T, np.array([r["high"] for r in rows]).T,
                np.array([r["thin"] for r in rows]), np.array([r["thick"] for r in rows]),
            )
            if dim not in splits:
                # No split point is of this dimension: one region, which nothing rules out.
                ranges.low, ranges.high = np.full((1, 1), -np.inf), np.full((1, 1), np.inf)
            chunks = [-(-r["n"] // CHUNK_ROWS) for r in rows]
            self.tops[dim] = (ranges, [r["region"] for r in rows], chunks)
            sizes |= {(dim, r["region"]): c for r, c in zip(rows, chunks, strict=True)}
        self.sizes = sizes

    def _data(self) -> DataFrame:
        many = {k: c for k, c in self.sizes.items() if c > 1}
        chunk = F.lit(0)
        for (dim, region), c in many.items():
            mine = (F.col("dim") == dim) & (F.col("region") == region)
            chunk = F.when(mine, F.pmod(F.xxhash64("vec_id"), F.lit(c)).cast("int")).otherwise(chunk)
        return self.placed.select("dim", "region", chunk.alias("chunk"), F.lit(0).alias("asked"), "vec_id", "label", "vector")

    def _round(self, queries: DataFrame, own: bool, k: int, near: int, far: int) -> DataFrame:
        types = "vec_id long, label long, dim int, vector binary, mark long, positive_id long, positive_score long, reached long"
        went = queries.select(*QUERY).mapInArrow(_route(self.tops, own, near, far), types + ", region int, chunk int")
        both = self._data().unionByName(went.withColumn("asked", F.lit(1)), allowMissingColumns=True)
        at = ("dim", "region", "chunk")
        return both.repartition(*at).sortWithinPartitions(*at, "asked").mapInArrow(_shards(k, near, far), FOUND)

    def search(self, queries: DataFrame, k: int, near: int, far: int) -> DataFrame:
        """The k best rows of each query's window: its own region first, whose kth score narrows the rings of the others.

        A query without ``positive_score`` asks for rows of its label, any score; one with it asks for
        rows of other labels that score from ``far`` to ``near`` hundredths of it.
        """
        key = ("anchor_id", "mark", "positive_id", "positive_score")
        order = Window.partitionBy(*key).orderBy(F.col("score").desc(), "vec_id")

        def best(found: DataFrame) -> DataFrame:
            return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        first = stage(best(self._round(queries.withColumn("reached", F.lit(None).cast("long")), True, k, near, far)), "own-region")
        kth = first.where(F.col("rank") == k).select(*(F.col(c).alias(f"_{c}") for c in key), F.col("score").alias("reached"))
        same = F.col("vec_id") == F.col("_anchor_id")
        for c in key[1:]:
            same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        others = self._round(queries.join(kth, same, "left"), False, k, near, far)
        return best(first.drop("rank").unionByName(others))


def mine(
    vectors: DataFrame, is_anchor: Column, key: str = "vec_id", embedding: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 3, near: int = 95, far: int = 50,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Each component x counts as ``floor(256 x)``, scores are inner products, higher is better, ties go to
    the smaller id. Anchors are the rows where ``is_anchor`` holds; their positives are the best other rows
    of their label; the negatives of a positive are the best rows of other labels that score from ``far``
    to ``near`` hundredths of the positive's score. Rows with a null id, label or vector, or with a null or
    non-finite component, take no part; vectors score only with those of their dimension. A repeated row
    counts once; rows that share the anchor's id are its own and count for nothing. Other columns are
    ignored; an empty table gives no rows. Components too large for exact doubles are multiplied as Python's
    integers, without a tree; a score past what a long holds counts as the nearest long.

    Of equal vectors of one label only the smallest ids can be in a result, and only they go on, picked
    before the shuffle, so a vector that fills a third of the table is a few rows.
    """
    rows = vectors.select(
        F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(embedding).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(finite)
    packed = rows.mapInArrow(_pack, "vec_id long, label long, anchor boolean, dim int, vector binary")
    packed = stage(packed.distinct(), "packed")
    first = Window.partitionBy("vector", "label").orderBy("vec_id")
    keep = max(positives, negatives) + 1
    points = packed.select("vec_id", "label", "dim", "vector").distinct()
    points = points.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= keep).drop("_n")
    forest = Forest(stage(points, "points"))
    anchors = packed.where("anchor").withColumn("mark", F.xxhash64("label", "vector")).drop("anchor")
    null = F.lit(None).cast("long")
    near_ones = forest.search(anchors.withColumns({"positive_id": null, "positive_score": null}), positives, near, far)
    near_ones = near_ones.select(
        F.col("anchor_id").alias("vec_id"), "mark", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    pairs = stage(anchors.join(near_ones, ["vec_id", "mark"]), "positives")
    found = forest.search(pairs, negatives, near, far)
    return found.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
