"""Ranked lexical search over posting lists cut into blocks of similar documents, with exact bounds."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.text import NOT_ALNUM, text_blocks
from lodestone.session import stage

#: Documents whose postings one task holds, and items that it takes at once.
SHARD_DOCS, ITEM_ROWS = 8192, 1024
#: Postings of a block, about; directions of the sketch that tells similar documents.
BLOCK, SKETCH = 64, 16
#: Cells of a table of maxima that is filled at once.
CELLS = 1 << 24
#: Up to so many bytes of asked terms go to the tasks, which then keep only these; beyond, rows keep all their terms.
ASKED_BYTES = 16 << 20
BLOCK_BYTES = 4 << 20

#: A-Z in lower case, bytes that belong to no term as blanks.
_FOLD = bytes(0x20 if NOT_ALNUM[b] else b + 32 if 65 <= b < 91 else b for b in range(256))

ENTRIES = "array<struct<term: string, value: bigint>>"
COUNTED = pa.schema([
    ("id", pa.int64()), ("n", pa.int64()), ("profile", pa.binary()),
    ("entries", pa.list_(pa.struct([("term", pa.string()), ("value", pa.int64())]))),
])


def terms(text: str | None) -> Counter:
    """Occurrences of each term of a text, as UTF-8: maximal runs of ASCII letters, digits and characters beyond ASCII."""
    return Counter((text or "").encode().translate(_FOLD).split())


def _count(asked: frozenset[bytes] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in text_blocks(batch.column("text"), BLOCK_BYTES):
                sizes, kept, marks = [], [], []
                for text in texts:
                    found = terms(text)
                    mine = sorted(found.items() if asked is None else ((t, found[t]) for t in found.keys() & asked))
                    sizes.append(found.total())
                    kept.append(mine)
                    marks.append(hashlib.blake2b(repr((sizes[-1], mine)).encode(), digest_size=16).digest())
                ends = pa.array(np.append(0, np.cumsum([len(m) for m in kept])).astype(np.int32))
                flat = pa.StructArray.from_arrays(
                    [pa.array([t for m in kept for t, _ in m], pa.binary()).cast(pa.string()),
                     pa.array([c for m in kept for _, c in m], pa.int64())], ["term", "value"],
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(done, len(texts)), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()),
                     pa.ListArray.from_arrays(ends, flat)],
                    schema=COUNTED,
                )
                done += len(texts)

    return run


def _gather(ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of the rows, row after row, and how many each row has."""
    sizes = ends[rows + 1] - ends[rows]
    total = np.cumsum(sizes)
    return np.repeat(ends[rows] - (total - sizes), sizes) + np.arange(total[-1] if len(total) else 0), sizes


class BlockedIndex:
    """Documents as rows of (term, impact), and for each term its documents in blocks of similar ones.

    A block keeps the greatest impact of every term in any of its documents. The weighted sum of
    these is no less than the score of any document in the block, so a block whose sum is below the
    kth best score so far holds nothing that is missing.
    """

    def __init__(self, ends: np.ndarray, columns: np.ndarray, impacts: np.ndarray, n_terms: int):
        self.ends, self.columns, self.impacts, self.n_terms = ends, columns, impacts, n_terms
        self.n = len(ends) - 1
        self.docs = np.repeat(np.arange(self.n), np.diff(ends))
        order = np.argsort(columns, kind="stable")
        self.listed = self.docs[order]
        self.list_ends = np.append(0, np.cumsum(np.bincount(columns, minlength=n_terms)))
        self.highest = np.zeros(n_terms, np.int64)
        np.maximum.at(self.highest, columns, impacts)
        signs = np.random.default_rng(1).choice(np.array([-1.0, 1.0]), (SKETCH, n_terms))
        sketch = np.stack([np.bincount(self.docs, s[columns] * impacts, self.n) for s in signs], axis=1)
        self.sketch = sketch / np.maximum(np.sqrt((sketch**2).sum(axis=1, keepdims=True)), 1e-9)
        self.made: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.scored = 0

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of one posting list: its documents by block, where blocks end, and the summaries' ends, terms and maxima."""
        if term in self.made:
            return self.made[term]
        docs = self.listed[self.list_ends[term] : self.list_ends[term + 1]]
        n_blocks = -(-len(docs) // BLOCK)
        # Each document goes to the most similar of some that stand for their blocks.
        heads = docs[np.linspace(0, len(docs) - 1, n_blocks).astype(np.int64)]
        block = (self.sketch[docs] @ self.sketch[heads].T).argmax(axis=1)
        order = np.argsort(block, kind="stable")
        docs, block = docs[order], block[order]
        cuts = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(docs))
        ends, places, maxima = [0], [], []
        step = max(1, CELLS // self.n_terms)
        for a in range(0, len(cuts) - 1, step):
            b = min(a + step, len(cuts) - 1)
            at, sizes = _gather(self.ends, docs[cuts[a] : cuts[b]])
            number = np.repeat(np.arange(b - a), np.diff(cuts[a : b + 1]))
            table = np.zeros((b - a) * self.n_terms, np.int32)
            np.maximum.at(table, np.repeat(number, sizes) * self.n_terms + self.columns[at], self.impacts[at].astype(np.int32))
            filled = np.flatnonzero(table)
            ends += (ends[-1] + np.cumsum(np.bincount(filled // self.n_terms, minlength=b - a))).tolist()
            places.append((filled % self.n_terms).astype(np.int32))
            maxima.append(table[filled])
        self.made[term] = docs, cuts, np.array(ends), np.concatenate(places), np.concatenate(maxima)
        return self.made[term]

    def search(self, asked: np.ndarray, weights: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``(scores, documents)`` of the k best documents with a score above 0; of equal scores the smaller id is better.

        Lists are opened from the greatest contribution down. A document not met before has none of the
        terms opened earlier, so these are left out of the bounds, and the search ends where all terms left
        together cannot reach the kth score.
        """
        weight = np.zeros(self.n_terms, np.int64)
        weight[asked] = weights
        most = weight * self.highest
        left = weight.copy()
        met = np.zeros(self.n, bool)
        scores, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least = 1
        for term in sorted(np.flatnonzero(most), key=lambda t: (-most[t], t)):
            if int((left * self.highest).sum()) < least:
                break
            listed, cuts, ends, places, maxima = self.blocks(term)
            sums = np.add.reduceat(left[places] * maxima, ends[:-1])
            order = np.argsort(-sums, kind="stable")
            done, step = 0, 1
            while done < len(order) and sums[order[done]] >= least:
                now = order[done : done + step]
                now = now[sums[now] >= least]
                done, step = done + len(now), 2 * step
                rows = np.concatenate([listed[cuts[b] : cuts[b + 1]] for b in now])
                rows = rows[~met[rows]]
                if not len(rows):
                    continue
                at, sizes = _gather(self.ends, rows)
                # A listed document has an entry, so no sum is over nothing.
                new = np.add.reduceat(weight[self.columns[at]] * self.impacts[at], np.cumsum(sizes) - sizes)
                self.scored += len(rows)
                scores, docs = np.append(scores, new), np.append(docs, rows)
                best = np.lexsort((ids[docs], -scores))[:k]
                scores, docs = scores[best], docs[best]
                if len(scores) == k:
                    least = max(least, int(scores[-1]))
            met[listed] = True
            left[term] = 0
        good = scores > 0
        return scores[good], docs[good]


def _entries(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Entries per row, and their terms and values end to end."""
    column = pa.chunked_array([b.column("entries") for b in batches]).combine_chunks()
    flat = column.flatten()
    return column.value_lengths().to_numpy(zero_copy_only=False), flat.field("term"), flat.field("value").to_numpy(zero_copy_only=False)


def build_index(data: list[pa.RecordBatch], wanted: pa.Array, n_docs: int, n_terms: int) -> tuple[BlockedIndex, list[int | None], np.ndarray]:
    """The index of the rows over the wanted terms, the rows' ids, and places that order them by id, none last."""
    sizes, names, tf = _entries(data)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    column = pc.index_in(names, value_set=wanted)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    rows, tf, column = rows[known], tf[known], column.drop_null().to_numpy().astype(np.int64)
    n = np.concatenate([b.column("n").to_numpy() for b in data])
    m = 100 - 25 + (25 * n * n_docs) // n_terms
    impacts = (1_000_000_000 * tf) // (1000 * tf + 12 * m[rows])
    ends = np.append(0, np.cumsum(np.bincount(rows, minlength=len(sizes))))
    ids = [i for b in data for i in b.column("id").to_pylist()]
    order = sorted(range(len(ids)), key=lambda r: (ids[r] is None, ids[r] or 0))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    return BlockedIndex(ends, column, impacts, len(wanted)), ids, place


def _answer(data: list[pa.RecordBatch], asked: pa.RecordBatch, n_docs: int, n_terms: int, k: int) -> pa.RecordBatch:
    sizes, names, weights = _entries([asked])
    wanted = pc.unique(names)
    places = pc.index_in(names, value_set=wanted).to_numpy()
    index, ids, place = build_index(data, wanted, n_docs, n_terms)
    ends = np.append(0, np.cumsum(sizes))
    row, docs, scores = [], [], []
    for i in range(len(sizes)):
        part = slice(ends[i], ends[i + 1])
        score, found = index.search(places[part], weights[part], place, k)
        row += [i] * len(found)
        docs += [ids[d] for d in found]
        scores += score.tolist()
    items = asked.select(["number"]).take(pa.array(row, pa.int64()))
    return pa.RecordBatch.from_arrays(
        [*items.columns, pa.array(docs, pa.int64()), pa.array(scores, pa.int64())], ["number", "doc_id", "score"]
    )


def _shards(n_docs: int, n_terms: int, k: int):
    """Reads the documents and then the items of one shard after the other, and answers the items as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, data = None, []
        for batch in batches:
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            key = 2 * shard.astype(np.int64) + kind
            cuts = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1) if len(key) else []
            for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
                if shard[a] != here:
                    here, data = shard[a], []
                part = batch.slice(a, b - a)
                if not kind[a]:
                    data.append(part)
                elif data:
                    for c in range(0, len(part), ITEM_ROWS):
                        yield _answer(data, part.slice(c, ITEM_ROWS), n_docs, n_terms, k)

    return run


def rank(
    items: DataFrame, docs: DataFrame, k: int = 20, item_key: str = "item_id", item_text: str = "text",
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k best documents of every item, those with a score above 0.

    Terms are maximal runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case;
    whole texts count, null has none. With N documents that have a term, L terms in all, n terms in a document,
    df documents with a term and tf occurrences in one, a term weighs ``floor(1000 ln((2N + 2) / (2 df + 1)))``, a
    document's m is ``75 + 25 n N div L``, and its score sums ``weight (10^9 tf div (1000 tf + 12 m))`` over the
    item's terms with repeats. Equal scores go by ascending id, none last.

    Every row of ``docs`` is a document, rows that repeat an id too. Items alike in id and text are one. Other
    columns are ignored; empty tables give no rows, nor does an item without a term that documents have.

    Documents alike in their counts score alike, so of each kind only the k smallest ids go on, cut before
    the shuffle. The others are dealt to shards of bounded size by hash; the items go to every shard, in
    batches, and documents to one.
    """
    named = items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text")).distinct()
    named = stage(named.withColumn("number", F.struct("item_id", F.xxhash64("text"))), "items")
    schema = "id long, n long, profile binary, entries " + ENTRIES
    # The item goes by its text here; its number is joined to the terms again.
    counted = named.select(F.xxhash64("text").alias("id"), "text").distinct().mapInArrow(_count(None), schema)
    asked = stage(counted.select("id", F.explode("entries").alias("e")).select("id", "e.term", F.col("e.value").alias("times")), "asked")
    vocabulary = asked.select("term").distinct()
    size = vocabulary.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    wanted = frozenset(r["term"].encode() for r in vocabulary.collect()) if size <= ASKED_BYTES else None

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    rows = stage(rows.mapInArrow(_count(wanted), schema).where("n > 0"), "counted")
    n_docs, n_terms = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequencies = rows.select(F.explode("entries.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(n_docs)) + 2) / (2 * F.col("df") + 1)))
    weighted = asked.join(frequencies, "term").select("id", F.struct("term", (weight * F.col("times")).alias("value")).alias("e"))
    weighted = weighted.where("e.value > 0").groupBy("id").agg(F.collect_list("e").alias("entries"))
    queries = stage(named.select("number", F.col("number")["col2"].alias("id")).join(weighted, "id").select("number", "entries"), "queries")

    first = Window.partitionBy("profile").orderBy(F.col("id").asc_nulls_last())
    kept = rows.where(F.size("entries") > 0).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= k).drop("_n")
    shards = max(1, -(-n_docs // SHARD_DOCS))
    data = kept.select(F.pmod(F.xxhash64("profile"), F.lit(shards)).cast("int").alias("shard"), F.lit(0).alias("kind"), "id", "n", "entries")
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    went = queries.select(every.alias("shard"), F.lit(1).alias("kind"), "number", "entries")
    both = data.unionByName(went, allowMissingColumns=True).repartition(shards, "shard").sortWithinPartitions("shard", "kind")
    number = queries.schema["number"].dataType.simpleString()
    found = both.mapInArrow(_shards(n_docs, n_terms, k), f"number {number}, doc_id long, score long")
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("number")["item_id"].alias("item_id"), "rank", "doc_id", "score")
