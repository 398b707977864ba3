"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges of the key hash into which the rows of each shard are cut to number them.
SLOT_RANGES = 256


def key_hash(key: Column, salt: Column | None = None) -> Column:
    """13 hex digits of MD5, as a whole number below 2**52; any engine with MD5 gives the same."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    text = F.concat_ws(":", text, salt) if salt is not None else text
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the least ``-ln(u) / weight``, u being a draw of key and shard.

    Each shard draws for itself, so a change of the weight list moves only the rows
    that the changed shard wins or loses: with one more shard, rows move into it and
    nowhere else. Expected shares are proportional to the weights.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("shards need positive weights")
    draws = [
        F.struct(
            (-F.log((key_hash(key, F.lit(str(i))) + 0.5) / float(1 << 52)) / F.lit(float(w))).alias("score"),
            F.lit(i).alias("shard"),
        )
        for i, w in enumerate(weights)
    ]
    return (F.least(*draws) if len(draws) > 1 else draws[0])["shard"]


def with_slots(rows: DataFrame, shard: str, key: str, order: Sequence[str]) -> DataFrame:
    """Add ``slot``: a gapless number from 0 within each shard.

    A shard is cut into ranges of the key hash; rows are numbered within a range and
    the counts of the ranges before it are added, so no task sorts a whole shard.
    """
    cut = rows.withColumn("_draw", key_hash(F.col(key))).withColumn(
        "_range", F.shiftright("_draw", 52 - (SLOT_RANGES - 1).bit_length())
    )
    # One row for each shard and range, whatever the table holds.
    counts = cut.groupBy(shard, "_range").agg(F.count("*").alias("_count"))
    before = Window.partitionBy(shard).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(shard, "_range", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(shard, "_range").orderBy("_draw", key, *order)
    return (
        cut.withColumn("_within", F.row_number().over(within))
        .join(F.broadcast(offsets), [shard, "_range"])
        .withColumn("slot", F.col("_before") + F.col("_within") - 1)
        .drop("_draw", "_range", "_within", "_before")
    )


def shard_documents(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Place every document in a shard by its key alone.

    Returns the key, ``size`` (UTF-8 bytes of the text plus 8; null text: 8),
    ``text_crc32`` (unsigned; null text: that of the empty string), ``law``,
    ``shard``, ``slot`` and ``grown_shard``, the shard if one more of the mean weight
    joined. A null key counts as a key of its own; rows that repeat a key share its
    shard and get slots of their own, in the order of checksum and size. Other
    columns are ignored. An empty table gives no rows.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    grown = [*weights, sum(weights) / len(weights)]
    placed = rows.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), weights).alias("shard"),
        shard_of(F.col("doc_id"), grown).alias("grown_shard"),
    )
    return with_slots(placed, "shard", "doc_id", ("text_crc32", "size")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
