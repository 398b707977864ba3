"""Substring dedup: words inside long passages that occur more than once, by prefix-partitioned suffix trees.

A suffix is the words from some place on; only its first ``window`` words matter here.
Three steps find the suffixes whose first ``window`` words also start elsewhere:

1. Every window has an anchor: of its runs of ``ANCHOR`` words, the one with the least
   hash. Equal windows have equal anchors at the same distance, so a window whose anchor
   is no other window's cannot repeat. This leaves the parts of the corpus that can.
2. The suffixes of those parts are dealt into groups by a prefix. The prefix has
   ``CHUNKS[0]`` words, and more where so short a prefix is common, so that groups fit in
   memory. A group's suffixes, sorted by chunks of words, are the leaves of its subtree;
   the common prefixes of neighbours are its internal nodes. Nodes at full depth with two
   leaves or more are the repeats.
3. The words under those leaves are marked in their texts.

Suffixes that are equal within one batch are merged before they are dealt out, so the copies
of a passage that fills a third of the corpus cost each group one leaf per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import blocks, distinct, mix, run_hashes, word_hashes
from lodestone.session import stage

WINDOW = 35
ANCHOR = 12
BLOCK_BYTES = 1 << 20
#: Words that one batch hashes and merges together.
BATCH_WORDS = 1 << 20
#: Words of the corpus for each group; a group holds a leaf for some of them.
GROUP_WORDS = 2 << 20
#: A prefix with more than this part of all suffixes may be lengthened: at most as many
#: prefixes per length as the inverse says, so the table of them can be sent to all tasks.
HEAVY_SHARE = 1 / 65_536
HEAVY_LOCAL = 8

DEALT = "kind int, grp long, row_key long, blob binary"
REPLY = "row_key long, blob binary"


def chunks(window: int) -> list[tuple[int, int]]:
    """The window in three parts: (begin, size)."""
    a = -(-window // 3)
    b = -(-(window - a) // 2)
    return [(0, a), (a, b), (a + b, window - a - b)]


class Words:
    """The word hashes of some texts, end to end, and which text each belongs to."""

    def __init__(self, keys: np.ndarray, texts: list[str]):
        parts, counts = [], []
        raw = [t.encode() for t in texts]
        for a, b in blocks([len(r) for r in raw], BLOCK_BYTES):
            hashes, starts, _ = word_hashes(b"\n".join(raw[a:b]))
            begins = np.cumsum([0, *(len(r) + 1 for r in raw[a : b - 1])])
            cut = np.searchsorted(starts, begins)
            counts.append(np.diff(np.append(cut, len(starts))))
            parts.append(hashes)
        self.keys = keys
        self.hash = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.doc = np.repeat(np.arange(len(texts)), self.count)

    def windows(self, window: int) -> np.ndarray:
        """Places where a whole window starts in one text."""
        left = (self.first + self.count)[self.doc] - np.arange(len(self.hash))
        return np.flatnonzero(left >= window)


def anchors(words: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window, the place of its anchor (the leftmost of equals); the hashes of all runs."""
    runs = run_hashes(words, run)
    span = window - run + 1
    place = np.arange(len(runs))
    size = 1
    while size < span:
        step = min(size, span - size)
        a, b = place[: len(place) - step], place[step:]
        place = np.where(runs[a] <= runs[b], a, b)
        size += step
    return place, runs


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows again in batches of about BATCH_WORDS words."""
    held, size = [], 0
    for pdf in batches:
        lengths = pdf["text"].str.len().to_numpy()
        for a, b in blocks(list(lengths), BATCH_WORDS * 6):
            held.append(pdf.iloc[a:b])
            size += int(lengths[a:b].sum())
            if size >= BATCH_WORDS * 3:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["kind", "grp", "row_key", "blob"])


def _by_doc(kind: int, words: Words, places: np.ndarray, groups: int) -> list[tuple]:
    """Rows that hand places straight to their texts."""
    out = []
    docs = words.doc[places]
    for part in np.split(places, np.flatnonzero(np.diff(docs)) + 1):
        if len(part):
            d = words.doc[part[0]]
            key = int(words.keys[d])
            out.append((kind, key % groups, key, (part - words.first[d]).astype("<u4").tobytes()))
    return out


def _deal(words: Words, places: np.ndarray, keys: np.ndarray, group: np.ndarray, groups: int) -> list[tuple]:
    """Leaves for the groups, and replies for places that repeat within this batch.

    ``keys`` holds the parts of each suffix's key, one row per place. Of equal suffixes the
    first is sent, marked as a repeat; all of them are known to repeat already.
    """
    order = np.lexsort(keys.T[::-1])
    new = np.ones(len(order), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(axis=1)
    run = np.cumsum(new) - 1
    several = np.bincount(run, minlength=1)[run] > 1
    out = _by_doc(1, words, np.sort(places[order[several]]), groups)
    sent = np.sort(order[new])
    marked = np.zeros(len(places), bool)
    marked[order[several]] = True
    by_group = sent[np.argsort(group[sent], kind="stable")]
    for part in np.split(by_group, np.flatnonzero(np.diff(group[by_group])) + 1):
        if not len(part):
            continue
        at = places[part]
        docs, index = np.unique(words.doc[at], return_inverse=True)
        index = index.astype("<u4") | (marked[part].astype("<u4") << np.uint32(31))
        head = np.array([len(docs), len(part), keys.shape[1]], "<u4")
        pos = (at - words.first[words.doc[at]]).astype("<u4")
        blob = b"".join(
            x.tobytes() for x in (head, words.keys[docs].astype("<i8"), index, pos, *np.ascontiguousarray(keys[part].T))
        )
        out.append((0, int(group[part[0]]), 0, blob))
    return out


def _leaves(blobs) -> tuple[np.ndarray, ...]:
    """Text keys, places, marks and key parts of all leaves in the blobs."""
    docs, places, marks, parts = [], [], [], []
    for blob in blobs:
        n_docs, n, width = np.frombuffer(blob, "<u4", 3)
        at = 12
        table = np.frombuffer(blob, "<i8", n_docs, at)
        at += 8 * int(n_docs)
        index, pos = np.frombuffer(blob, "<u4", n, at), np.frombuffer(blob, "<u4", n, at + 4 * int(n))
        at += 8 * int(n)
        parts.append(np.frombuffer(blob, "<u4", int(n) * int(width), at).reshape(width, n).T)
        docs.append(table[index & np.uint32(0x7FFFFFFF)])
        marks.append(index >> np.uint32(31) == 1)
        places.append(pos)
    return np.concatenate(docs), np.concatenate(places), np.concatenate(marks), np.concatenate(parts)


def deep_leaves(keys: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which leaves of a subtree hang from an internal node at full depth.

    Sorted leaves with the depth (in chunks) that each shares with the one before it are
    the tree: a node at full depth is a run of leaves that share all chunks. A marked leaf
    stands for several.
    """
    order = np.lexsort(keys.T[::-1])
    same = keys[order[1:]] == keys[order[:-1]]
    depth = np.concatenate([[0], np.cumprod(same, axis=1).sum(axis=1)]) if len(order) else np.zeros(0)
    node = np.cumsum(depth < keys.shape[1]) - 1
    leaves = np.bincount(node, weights=1 + marks[order]) if len(order) else np.zeros(0)
    deep = np.zeros(len(order), bool)
    deep[order] = leaves[node] >= 2
    return deep


def _pack_replies(docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text keys in ascending order, the number of places of each, and the places."""
    order = np.argsort(docs, kind="stable")
    keys, counts = np.unique(docs[order], return_counts=True)
    return keys.astype("<i8"), counts.astype("<u4"), places[order].astype("<u4")


def _subtree(buckets: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Replies to the texts whose suffixes repeat, for one group: one row for each bucket of texts."""
        known = pdf[pdf["kind"] == 1]
        at = [np.frombuffer(x, "<u4") for x in known["blob"]]
        docs = [np.repeat(known["row_key"].to_numpy(np.int64), [len(x) for x in at])]
        places = [*at, np.zeros(0, "<u4")]
        dealt = pdf.loc[pdf["kind"] == 0, "blob"]
        if len(dealt):
            leaf_docs, leaf_places, marks, keys = _leaves(dealt)
            found = deep_leaves(keys, marks) & ~marks  # the texts of marked leaves have their replies
            docs.append(leaf_docs[found])
            places.append(leaf_places[found])
        docs, places = np.concatenate(docs), np.concatenate(places)
        bucket = docs % buckets
        out = []
        for b in np.unique(bucket):
            keys, counts, here = _pack_replies(docs[bucket == b], places[bucket == b])
            out.append((b, np.array([len(keys)], "<u4").tobytes() + keys.tobytes() + counts.tobytes() + here.tobytes()))
        return pd.DataFrame(out, columns=["bucket", "blob"])

    return run


def _merge_replies(pdf: pd.DataFrame) -> pd.DataFrame:
    """All places of each text of a bucket."""
    docs, places = [], []
    for blob in pdf["blob"]:
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        docs.append(np.repeat(np.frombuffer(blob, "<i8", n, 4), np.frombuffer(blob, "<u4", n, 4 + 8 * n)))
        places.append(np.frombuffer(blob, "<u4", -1, 4 + 12 * n))
    keys, counts, places = _pack_replies(np.concatenate(docs), np.concatenate(places))
    parts = np.split(places, np.cumsum(counts)[:-1])
    return pd.DataFrame({"row_key": keys, "blob": [x.tobytes() for x in parts]})


def _words64(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view("<u4").reshape(-1, 2)


def _anchor_pass(window: int, run: int, groups: int):
    (_, first), (_, second), _ = chunks(window)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _batches(batches):
            words = Words(pdf["row_key"].to_numpy(), list(pdf["text"]))
            starts = words.windows(window)
            if not len(starts):
                continue
            place, runs = anchors(words.hash, window, run)
            at = distinct(place[starts])
            key = runs[at]
            rows = _deal(words, at, _words64(key), (key % np.uint64(groups)).astype(np.int64), groups)
            # Prefixes that are common in this batch, for the choice of their length.
            chosen = starts
            for level, size in enumerate((first, first + second)):
                h, inverse, n = np.unique(run_hashes(words.hash, size)[chosen], return_inverse=True, return_counts=True)
                common = n >= HEAVY_LOCAL
                blob = h[common].astype("<u8").tobytes() + n[common].astype("<u8").tobytes()
                if common.any():
                    rows.append((2 + level, 0, 0, blob))
                chosen = chosen[common[inverse]]
            yield _frame(rows)

    return go


def _spread_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for kind, blob in zip(pdf["kind"], pdf["blob"], strict=True):
            h, n = np.frombuffer(blob, "<u8").reshape(2, -1)
            yield pd.DataFrame({"level": np.full(len(h), kind - 2, np.int32), "prefix": h.view(np.int64), "n": n.astype(np.int64)})


def _suffix_pass(window: int, run: int, groups: int, heavy: list[np.ndarray]):
    parts = chunks(window)
    lengths = [parts[0][1], parts[0][1] + parts[1][1], window]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _batches(batches):
            words = Words(pdf["row_key"].to_numpy(), list(pdf["text"]))
            repeated = np.zeros(len(words.hash), bool)
            for d, blob in enumerate(pdf["blob"]):
                repeated[words.first[d] + np.frombuffer(blob, "<u4")] = True
            starts = words.windows(window)
            place, _ = anchors(words.hash, window, run)
            starts = starts[repeated[place[starts]]]
            if not len(starts):
                continue
            keys = np.empty((len(starts), len(parts)), "<u4")
            for i, (begin, size) in enumerate(parts):
                keys[:, i] = run_hashes(words.hash, size, salt=1)[starts + begin] >> np.uint64(32)
            prefix = run_hashes(words.hash, lengths[0])[starts]
            for table, longer in zip(heavy, lengths[1:], strict=True):
                if len(table):
                    more = np.isin(prefix, table)
                    prefix[more] = run_hashes(words.hash, longer)[starts[more]]
            group = (mix(prefix) % np.uint64(groups)).astype(np.int64)
            rows = _deal(words, starts, keys, group, groups)
            yield _frame(rows)

    return go


def covered(n_words: int, places: np.ndarray, window: int) -> np.ndarray:
    """Marks the words of a text that a repeated window covers."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + window, -1)
    return np.cumsum(edge[:-1]) > 0


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
    ("kept", pa.string()), ("repeats", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])


def _finish(window: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, blob in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "blob")), strict=True):
                words = text.encode().split()
                n, spans = len(words), []
                if blob is not None:
                    gone = covered(n, np.frombuffer(blob, "<u4"), window)
                    edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                    spans = [{"start": int(a), "end": int(b)} for a, b in edges]
                    words = list(compress(words, ~gone))
                kept = b" ".join(words)
                out.append((doc_id, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode(), spans))
            columns = zip(*out, strict=True) if out else [[]] * len(RESULT)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, RESULT, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=RESULT)

    return go


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept, repeats`` for every row of ``docs``.

    A word ``[^\\x20\\x09-\\x0D]+`` is removed if it is in some ``window`` consecutive words
    of its text that also start anywhere else, in the same text too; windows are judged on
    the input. ``kept`` has the other words, joined by one space; ``repeats`` has the
    maximal removed stretches as word ranges. Null text is empty; texts shorter than the
    window lose nothing. Repeated rows are copies of each other. Rows are told apart by a
    64-bit hash of id and text. Other columns are ignored; an empty table gives no rows.
    """
    run = min(ANCHOR, window)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), body.alias("text")).select(
        F.xxhash64("doc_id", "text").alias("row_key"), "doc_id", "text"
    )
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    groups = max(1, -(-size // (6 * GROUP_WORDS)))
    dealt = stage(rows.select("row_key", "text").mapInPandas(_anchor_pass(window, run, groups), DEALT), "anchors")
    common = (
        dealt.where("kind >= 2").select("kind", "blob").mapInPandas(_spread_counts, "level int, prefix long, n long")
        .groupBy("level", "prefix").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= max(GROUP_WORDS / 8, size / 6 * HEAVY_SHARE))
        .collect()  # at most 1 / HEAVY_SHARE for each level
    )
    heavy = [np.array([r.prefix for r in common if r.level == i], np.int64).view(np.uint64) for i in (0, 1)]

    def replies(table: DataFrame) -> DataFrame:
        # A group answers in one row for each bucket of texts, not one for each text it has a leaf of.
        found = table.groupBy("grp").applyInPandas(_subtree(groups), "bucket int, blob binary")
        return found.groupBy("bucket").applyInPandas(_merge_replies, REPLY).hint("shuffle_hash")

    placed = rows.repartition("row_key")
    anchored = placed.join(replies(dealt.where("kind < 2")), "row_key").select("row_key", "doc_id", "text", "blob")
    suffixes = anchored.mapInPandas(_suffix_pass(window, run, groups, heavy), DEALT)
    marked = placed.join(replies(suffixes), "row_key", "left").select("doc_id", "text", "blob")
    return marked.mapInArrow(
        _finish(window),
        "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, "
        "repeats array<struct<start: int, end: int>>",
    )
