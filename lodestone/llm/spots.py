"""SpotSigs fingerprints: chains of content words after common words, compared by pruned Jaccard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import components
from lodestone.llm.text import NOT_ALNUM, blocks, distinct, mix, word_hashes
from lodestone.session import stage

#: Common words that anchor a chain, in the four languages of the corpus; a parameter of every function.
ANCHORS = tuple(
    # English
    "the a an is are was were be to of and in that it for on with as by at this from or "
    # German
    "der die das und ist ein eine den dem von zu mit sich auf für im nicht "
    # Spanish
    "el la los las un una de que y en es por con para se del al "
    # French
    "le les des et dans est une du pour qui sur par au aux".split()
)
#: Content words in a chain, and the step from one to the next.
CHAIN = 2
DISTANCE = 1
BLOCK_BYTES = 1 << 20
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def anchor_hashes(anchors: Sequence[str]) -> np.ndarray:
    return np.sort(np.concatenate([word_hashes(a.lower().encode(), NOT_ALNUM)[0] for a in anchors]))


def signature_sets(
    texts: list[str | None], anchors: np.ndarray, chain: int = CHAIN, distance: int = DISTANCE
) -> list[np.ndarray]:
    """The sorted 32-bit signatures of each text.

    Words are runs of letters and digits, lower-cased. At each anchor, a signature is made of
    the anchor and the next ``chain`` content words (words that are no anchors), taking every
    ``distance``-th. A text in which no chain fits is its own single signature: the hash of
    its whole characters, so that texts without one are alike only when equal.
    """
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
    raw = [(t or "").lower().encode() for t in texts]
    for a, b in blocks([len(r) for r in raw], BLOCK_BYTES):
        words, starts, _ = word_hashes(b"\n".join(raw[a:b]), NOT_ALNUM)
        begins = np.cumsum([0, *(len(r) + 1 for r in raw[a : b - 1])])
        first = np.searchsorted(starts, begins)
        ends = np.append(first[1:], len(words))
        at = np.minimum(np.searchsorted(anchors, words), len(anchors) - 1)
        anchor = anchors[at] == words
        content = words[~anchor]
        before = np.cumsum(~anchor)  # content words up to each place
        spots = np.flatnonzero(anchor)
        doc = np.searchsorted(ends, spots, side="right")
        content_end = np.append(0, before)[ends]
        last = before[spots] + (chain - 1) * distance
        fits = last < content_end[doc]
        spots, doc = spots[fits], doc[fits]
        sig = words[spots] * _MULT[0]
        for k in range(chain):
            sig = mix(sig ^ (content[before[spots] + k * distance] * _MULT[1 + k % 2]))
        sig = (sig >> np.uint64(32)) | (doc.astype(np.uint64) << np.uint64(32))
        sig = distinct(sig)
        cuts = np.searchsorted(sig >> np.uint64(32), np.arange(b - a + 1).astype(np.uint64))
        low = sig.astype(np.uint32)
        for i in range(b - a):
            out[a + i] = low[cuts[i] : cuts[i + 1]]
    for i, sigs in enumerate(out):
        if not len(sigs):
            digest = hashlib.sha256((texts[i] or "").encode()).digest()
            out[i] = np.frombuffer(digest[:4], "<u4")
    return out


def fingerprint_text(signatures: np.ndarray) -> str:
    """The signatures as hex digits, eight each, in ascending order."""
    return signatures.astype(">u4").tobytes().hex()


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Shared part of two sorted sets; 0 where their sizes alone rule out ``least``."""
    small, large = min(len(a), len(b)), max(len(a), len(b))
    if small < least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if large else 1.0


RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
])


def _compare_with_next(anchors: np.ndarray):
    """Rows come in the order of the documents; each is finished when the next one is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # the last row of the batch before: bucket, own, id, text, signatures
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for a, b in blocks([len(r[3]) for r in rows], BLOCK_BYTES):
                part = rows[a:b]
                known = held + [(*r, s) for r, s in zip(part, signature_sets([r[3] for r in part], anchors), strict=True)]
                pairs = [(x, y) for x, y in zip(known[:-1], known[1:], strict=True) if x[0] == y[0] and x[1]]
                held = known[-1:]
                edited = []
                for x, y in pairs:
                    half = len(x[3]) // 2
                    edited.append(x[3][: len(x[3]) - half] + y[3][:half])
                out = [
                    (x[2], len(x[3]), hashlib.sha256(e.encode()).hexdigest(), fingerprint_text(x[4]), fingerprint_text(s),
                     jaccard(x[4], s), jaccard(x[4], y[4]))
                    for (x, y), e, s in zip(pairs, edited, signature_sets(edited, anchors), strict=True)
                ]
                if out:
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), RESULT, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, schema=RESULT)

    return run


def compare_with_next(
    docs: DataFrame, anchors: Sequence[str] = ANCHORS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike it is to both that and the next document's.

    Documents follow each other in descending order of id, null last, repeated rows by text;
    after the last comes the first. The edited text has its last ``floor(n_chars / 2)``
    code points replaced by as many of the next document (or all it has). Null text is
    empty. Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``; other columns are ignored; an empty table gives no rows, and a
    single document is its own next.

    Ids are cut into ranges at quantiles that are ids themselves. The first document of each
    range also goes to the range before it, so every range is compared in one sorted stream
    that holds two documents at a time, and no task sees the whole table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # Ascending order of rank is descending order of id; null ids, if any, come last, behind the smallest id.
    rows = rows.withColumn("_rank", F.coalesce(F.bitwise_not("doc_id"), F.lit((1 << 63) - 1)))
    rows = rows.withColumn("_none", F.col("doc_id").isNull())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    cuts = rows.agg(
        F.percentile_approx("_rank", [i / parts for i in range(parts)], 100 * parts).alias("at"), F.min("_rank").alias("least")
    ).first()
    bounds = sorted({*(cuts["at"] or []), cuts["least"]} - {None}) or [0]  # as many as there are ranges
    listed = F.array(*[F.lit(b) for b in bounds])
    # The ranges begin at the bounds; a document's range is the last that begins at or before it.
    home = F.size(F.filter(listed, lambda b: b <= F.col("_rank"))) - 1
    # The whole order is told by rank and text, so the first row of a range is its least in both.
    firsts = stage(
        rows.withColumn("_home", home).where(F.col("_rank").isin(bounds))
        .groupBy("_home").agg(F.min(F.struct("_rank", "_none", "text", "doc_id")).alias("f")).select("_home", "f.*"),
        "firsts",
    )
    own = rows.select(home.alias("_range"), F.lit(True).alias("_own"), "doc_id", "text", "_rank", "_none")
    follow = firsts.select(
        F.pmod(F.col("_home") - 1, F.lit(len(bounds))).alias("_range"), F.lit(False).alias("_own"), "doc_id", "text", "_rank", "_none"
    )
    ordered = own.unionByName(follow).repartition("_range").sortWithinPartitions(
        F.col("_range"), F.col("_own").desc(), "_rank", "_none", "text"
    )
    return ordered.select("_range", "_own", "doc_id", "text").mapInArrow(
        _compare_with_next(anchor_hashes(anchors)),
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double",
    )


def length_class(size: int, likeness: float) -> int:
    """Sets of one class differ in size by at most the factor ``likeness``; alike sets are in one class or the next."""
    return int(np.floor(np.log(max(size, 1)) / -np.log(likeness) + 1e-9))


def _class_links(likeness: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between the sets of one block and those that share a rare signature with them: a forest."""
        pdf = pdf.drop_duplicates("fp").sort_values("size", ignore_index=True)
        sets = [np.frombuffer(s, "<u4") for s in pdf["sigs"]]
        root = list(range(len(sets)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for j in range(len(sets)):
            for i in range(j - 1, -1, -1):
                if len(sets[i]) < likeness * len(sets[j]):
                    break  # the rest is shorter still
                a, b = find(i), find(j)
                if a != b and jaccard(sets[i], sets[j], likeness) >= likeness:
                    root[max(a, b)] = min(a, b)
        links = [(pdf["fp"][i], pdf["fp"][find(i)]) for i in range(len(sets)) if find(i) != i]
        return pd.DataFrame(links, columns=["a", "b"])

    return run


def _sets(anchors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = signature_sets(batch.column("text").to_pylist(), anchors)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([s.astype("<u4").tobytes() for s in sets], pa.binary())], ["doc_id", "sigs"]
            )

    return run


def near_duplicates(
    docs: DataFrame, likeness: float = 0.8, anchors: Sequence[str] = ANCHORS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, class_id``: the smallest id reachable over links of Jaccard ``likeness`` or more between signature sets.

    Equal sets are compared once. A set goes to the partition of its length class and the one
    below, under each signature of its prefix: the ``size - ceil(likeness * size) + 1``
    rarest, of which two alike sets must share one. Within a partition, pairs are pruned by
    size. Null text is empty; null ids are never the smallest; an empty table gives no rows.
    A partition is one group in memory and one task, whose time grows with the square of its
    sets: the distinct sets of near-copies that share one rare signature and a length class.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    table = stage(
        rows.mapInArrow(_sets(anchor_hashes(anchors)), "doc_id long, sigs binary").withColumn("fp", F.sha2("sigs", 256)),
        "sets",
    )
    distinct = table.groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("sigs").alias("sigs"))
    distinct = stage(distinct.withColumn("size", F.octet_length("sigs") / 4), "distinct")
    sig = F.transform(F.sequence(F.lit(0), F.col("size").cast("int") - 1), lambda i: F.substring(F.col("sigs"), i * 4 + 1, 4))
    each = distinct.select("fp", "size", F.explode(sig).alias("sig"))
    counts = each.groupBy("sig").agg(F.count("*").alias("n"))
    ranked = each.join(counts, "sig").groupBy("fp", "size").agg(F.sort_array(F.collect_list(F.struct("n", "sig"))).alias("s"))
    keep = (F.col("size") - F.ceil(F.col("size") * likeness) + 1).cast("int")
    prefix = ranked.select("fp", "size", F.explode(F.slice("s", F.lit(1), keep)).alias("p")).select("fp", "size", "p.sig")
    level = F.floor(F.log(F.greatest("size", F.lit(1.0))) / F.lit(-float(np.log(likeness))) + F.lit(1e-9))
    dealt = prefix.withColumn("class", F.explode(F.array(level, level - 1)))
    alone = dealt.groupBy("sig", "class").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = dealt.join(alone, ["sig", "class"]).join(distinct.select("fp", "sigs"), "fp")
    links = dealt.groupBy("sig", "class").applyInPandas(_class_links(likeness), "a string, b string")
    roots = components(stage(links, "links"))
    linked = roots.join(distinct.select("fp", "least"), roots["node"] == F.col("fp")).select("fp", "root", "least")
    reached = linked.groupBy("root").agg(F.min("least").alias("reached"))
    moved = linked.join(reached, "root").select(F.col("fp").alias("_fp"), "reached")
    named = distinct.join(moved, F.col("fp") == F.col("_fp"), "left").select(
        F.col("fp").alias("_fp"), F.coalesce("reached", "least").alias("class_id")
    )
    return table.join(named, F.col("fp") == F.col("_fp")).select("doc_id", "class_id")
