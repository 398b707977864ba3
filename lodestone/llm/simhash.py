"""SimHash near-duplicates, searched exactly with vantage-point trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.text import blocks, distinct, text_blocks
from lodestone.session import stage

# XXH64, fixed values.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(x)
    for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)
SEED = 42
BLOCK_BYTES = 1 << 18
#: Shards are as many as the square root of the distinct fingerprints over this: more of them
#: search faster, but each boundary makes more fingerprints visit a second shard.
SHARD_SIZE = 2_048
#: Fingerprints that the tree of the shards is fitted on.
SAMPLE_SIZE = 8_192
LEAF_SIZE = 64


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64_spans(buf: bytes, starts: np.ndarray, sizes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of many spans of one buffer, all spans of one size at a time."""
    padded = np.frombuffer(buf + bytes(8), np.uint8)
    u64 = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
    u32 = np.ndarray((len(padded) - 3,), "<u4", buffer=padded, strides=(1,))
    out = np.empty(len(starts), np.uint64)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order], prepend=-1))
    for begin, end in zip(cuts, [*cuts[1:], len(order)], strict=True):
        rows = order[begin:end]
        size, at = int(sizes[rows[0]]), starts[rows].copy()
        left = size
        if size >= 32:
            acc = [np.full(len(rows), np.uint64((seed + x) % (1 << 64))) for x in (int(_P1) + int(_P2), int(_P2), 0, -int(_P1))]
            while left >= 32:
                acc = [_round(a, u64[at + 8 * i]) for i, a in enumerate(acc)]
                at, left = at + 32, left - 32
            h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
            for a in acc:
                h = (h ^ _round(np.uint64(0), a)) * _P1 + _P4
        else:
            h = np.full(len(rows), np.uint64((seed + int(_P5)) % (1 << 64)))
        h = h + np.uint64(size)
        while left >= 8:
            h = _rotl(h ^ _round(np.uint64(0), u64[at]), 27) * _P1 + _P4
            at, left = at + 8, left - 8
        if left >= 4:
            h = _rotl(h ^ (u32[at].astype(np.uint64) * _P1), 23) * _P2 + _P3
            at, left = at + 4, left - 4
        for _ in range(left):
            h = _rotl(h ^ (padded[at].astype(np.uint64) * _P5), 11) * _P1
            at = at + 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out[rows] = h ^ (h >> np.uint64(32))
    return out


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For consecutive groups of hashes, the bits set in over half of each group."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ends = np.cumsum(counts)
    begins = ends - counts
    # Sums of up to 255 rows fit a byte; those are summed again.
    part = distinct(np.concatenate([begins, np.arange(0, len(bits), 255)]))
    sums = np.add.reduceat(bits, part, axis=0).astype(np.int64)
    total = np.add.reduceat(sums, np.searchsorted(part, begins), axis=0)
    return np.packbits(total * 2 > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(texts: list[str | None], shingle: int = 3) -> np.ndarray:
    """64-bit SimHash of each text; 0 for a text without words."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in blocks([len(t or "") for t in texts], BLOCK_BYTES):
        split = [t.encode().lower().split() if t else [] for t in texts[a:b]]
        filled = [i for i, w in enumerate(split) if w]
        if not filled:
            continue
        n_words = np.array([len(split[i]) for i in filled])
        buf = b" ".join(b" ".join(split[i]) for i in filled)
        ends = np.append(np.flatnonzero(np.frombuffer(buf, np.uint8) == 0x20), len(buf))
        starts = np.append(0, ends[:-1] + 1)
        counts = np.maximum(n_words - shingle + 1, 1)
        doc = np.repeat(np.arange(len(filled)), counts)
        first = np.arange(len(doc)) - (np.cumsum(counts) - counts)[doc] + (np.cumsum(n_words) - n_words)[doc]
        last = first + np.minimum(n_words, shingle)[doc] - 1
        hashes = xxh64_spans(buf, starts[first], ends[last] - starts[first])
        out[a + np.array(filled)] = _majority(hashes, counts)
    return out


def _hash_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [fingerprints(texts, shingle) for texts in text_blocks(batch.column("text"), BLOCK_BYTES)]
            fps = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fps)], [*names, "fp"])

    return run


def fingerprint_table(
    docs: DataFrame, shingle: int = 3, key: str = "doc_id", text: str = "text", name: str | None = None
) -> DataFrame:
    """``doc_id, fp`` for every row, ``fp`` being the 64 bits as a signed number. Null text has no words.

    ``name``, a column of whole numbers, goes along if given.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), *([F.col(name).alias("name")] if name else []), F.col(text).alias("text")
    )
    return rows.mapInArrow(_hash_batches(shingle), f"doc_id long, {'name long, ' if name else ''}fp long")


class VantageTree:
    """Nodes split their points at the median distance from a vantage point: near ones inside, the others outside."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.vantage: list[int] = []
        self.radius: list[int] = []
        self.child: list[tuple[int, int]] = []
        self.leaves: list[np.ndarray] = []  # positions of the points, in order of the leaf's number
        self.root = self._build(points, np.arange(len(points)), leaf)

    def _build(self, points: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        """A node's number; leaves count down from -1."""
        best = None
        if len(rows) > leaf:
            tried = rows[np.linspace(0, len(rows) - 1, 9).astype(int)]
            far = np.bitwise_count(points[rows] ^ points[tried][:, None]).astype(np.int64)
            # The vantage point whose median shell holds the fewest points has the least overlap.
            for v, d in zip(tried, far, strict=True):
                m = int(np.median(d))
                inside = int((d <= m).sum())
                if inside == len(rows):
                    m, inside = m - 1, int((d <= m - 1).sum())
                if 0 < inside < len(rows):
                    overlap = int((np.abs(d - m) <= 3).sum()) + abs(2 * inside - len(rows)) // 2
                    if best is None or overlap < best[0]:
                        best = overlap, int(points[v]), m, d <= m
        if best is None:
            self.leaves.append(rows)
            return -len(self.leaves)
        _, v, m, near = best
        node = len(self.vantage)
        self.vantage.append(v)
        self.radius.append(m)
        self.child.append((0, 0))
        self.child[node] = (self._build(points, rows[near], leaf), self._build(points, rows[~near], leaf))
        return node

    def visit(self, points: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows) such that every point within ``reach`` of ``points[row]`` is in one of its leaves.

        With d the distance to the vantage point and m its radius, the triangle
        inequality rules out the inside if d - reach > m, the outside if d + reach <= m.
        """
        todo = [(self.root, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield -node - 1, rows
                continue
            d = np.bitwise_count(points[rows] ^ np.uint64(self.vantage[node])).astype(np.int64)
            inside, outside = self.child[node]
            todo.append((inside, rows[d - reach <= self.radius[node]]))
            todo.append((outside, rows[d + reach > self.radius[node]]))


def _route(tree: VantageTree, reach: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps = pdf["fp"].to_numpy().view(np.uint64)
            home = np.empty(len(fps), np.int64)
            for leaf, rows in tree.visit(fps, 0):
                home[rows] = leaf
            yield pd.DataFrame({"shard": home, "fp": fps.view(np.int64), "home": True})
            for leaf, rows in tree.visit(fps, reach):
                # Of a pair in two shards, the point of the lower one visits the higher one.
                rows = rows[home[rows] < leaf]
                if len(rows):
                    yield pd.DataFrame({"shard": leaf, "fp": fps[rows].view(np.int64), "home": False})

    return run


def _join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union by least root, for many links at once."""
    while True:
        ra, rb = root[a], root[b]
        while not np.array_equal(ra, root[ra]):
            ra = root[ra]
        while not np.array_equal(rb, root[rb]):
            rb = root[rb]
        open_ = ra != rb
        if not open_.any():
            return
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))


def _search(reach: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links that hold together what is within reach in this shard: a forest, not all pairs."""
        pdf = pdf.sort_values(["home", "fp"], ascending=[False, True], ignore_index=True)
        points = pdf["fp"].to_numpy().view(np.uint64)
        n_home = int(pdf["home"].sum())
        tree = VantageTree(points[:n_home], LEAF_SIZE)
        root = np.arange(len(points))
        for leaf, rows in tree.visit(points, reach):
            here = tree.leaves[leaf]
            for part in np.array_split(rows, len(rows) * len(here) // (1 << 21) + 1):
                near = np.bitwise_count(points[part][:, None] ^ points[here]) <= reach
                i, j = np.nonzero(near)
                _join_roots(root, part[i], here[j])
        while not np.array_equal(root, root[root]):
            root = root[root]
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": points[linked].view(np.int64), "b": points[root[linked]].view(np.int64)})

    return run


def near_links(fps: DataFrame, reach: int = 3) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints that connect all those ``reach`` or fewer bits apart.

    A tree fitted on at most ``SAMPLE_SIZE`` fingerprints, those with the least hash,
    cuts the fingerprints into shards by their distances to vantage points. A fingerprint
    is at home in one shard and visits the shards that the triangle bound cannot rule
    out, so every pair within reach meets in one shard; there a tree of its own is
    searched. A shard gives at most one link for each fingerprint in it.
    """
    distinct = stage(fps.select("fp").distinct(), "fingerprints")
    n = distinct.count()
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE_SIZE).collect()
    points = np.array([r[0] for r in sample], np.int64).view(np.uint64)
    shards = max(1, math.isqrt(n // SHARD_SIZE))
    tree = VantageTree(points, max(1, len(points) // shards))
    tree.leaves = []
    routed = distinct.mapInPandas(_route(tree, reach), "shard long, fp long, home boolean")
    return routed.groupBy("shard").applyInPandas(_search(reach), "a long, b long")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, reach: int = 3, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Texts are lower-cased in A-Z, cut into words ``[^\\x20\\x09-\\x0D]+`` and hashed by
    shingles of ``shingle`` words, repeats included; a shorter text is one shingle, and one
    without words (null, empty, blank) has fingerprint 0 and is linked like any other.
    Fingerprints link at ``reach`` or fewer differing bits, without any check of the
    words. ``component_id`` is the smallest id reachable. Copies share a fingerprint and
    are searched once; repeated rows each get a row. Null ids are never the smallest; a
    component of null ids alone has a null id. Other columns are ignored; an empty table
    gives no rows.
    """
    table = stage(fingerprint_table(docs, shingle, key, text), "hashed")
    least = table.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(stage(near_links(table, reach), "near"))
    linked = roots.join(least, roots["node"] == least["fp"]).select("fp", "root", "least")
    reached = linked.groupBy("root").agg(F.min("least").alias("reached"))
    moved = linked.join(reached, "root").select(F.col("fp").alias("_fp"), "reached")
    named = least.join(moved, F.col("fp") == F.col("_fp"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("reached", "least").alias("component_id")
    )
    return table.join(named, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def least_of_components(
    docs: DataFrame, name: str, shingle: int = 3, reach: int = 3, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, name`` of the least row by id and name in each component of ``near_duplicates``, null ids last.

    ``name`` is a column of whole numbers that tells rows of one id, or without an id, apart. Least rows are
    aggregated by fingerprint, then by component, so no row is joined to its group.
    """
    table = stage(fingerprint_table(docs, shingle, key, text, name), "hashed")
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "name")
    least = table.groupBy("fp").agg(F.min(row).alias("least"))
    roots = components(stage(near_links(table, reach), "near"))
    rooted = least.join(roots, least["fp"] == roots["node"], "left").select(F.coalesce("root", "fp").alias("root"), "least")
    return rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.name")
