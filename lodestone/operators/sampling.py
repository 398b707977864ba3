"""Repeatable samples. Order comes from ``md5(seed:id)``, so a rerun draws the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: str | Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string") if isinstance(key, str) else key))


def eligible(df: DataFrame, column: str, min_length: int = 8) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.length(column) >= min_length))


def sample_pct(df: DataFrame, pct: float, key: str, seed: int = 42) -> DataFrame:
    """About ``pct`` percent of the rows, decided row by row from the key while scanning.

    The same rows come out however the table is cut into files and tasks.
    """
    place = F.conv(F.substring(draw(key, seed), 1, 8), 16, 10).cast("long")
    return df.where(place < int(pct / 100 * (1 << 32)))


def random_n(df: DataFrame, key: str, n: int, seed: int = 42, prefix: int = 4) -> DataFrame:
    """The ``n`` rows drawn first, in no order; all rows if there are fewer.

    The leading hex digits of the draw cut the rows into 16^prefix even ranges. Rows are counted
    per range by their keys alone; ranges before the one in which the nth row lies are taken
    whole, where they are read, and only the rows of that one are put in order.
    """
    # A null key is drawn first.
    drawn = df.withColumn("_draw", F.coalesce(draw(key, seed), F.lit(""))).withColumn("_range", F.substring("_draw", 1, prefix))
    counts = drawn.groupBy("_range").agg(F.count("*").alias("_count"))
    # At most 16^prefix rows and one more, one per range, whatever the table holds.
    upto = F.sum("_count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    border = counts.withColumn("_upto", upto).where(F.col("_upto") > n).orderBy("_range").first()
    if border is None:
        return df
    left = n - (border["_upto"] - border["_count"])
    whole = drawn.where(F.col("_range") < border["_range"])
    near = drawn.where(F.col("_range") == border["_range"])
    near = near.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy("_draw", key))).where(F.col("_n") <= left)
    return whole.drop("_draw", "_range").unionByName(near.drop("_draw", "_range", "_n"))


def first_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest keys, in no order; only keys are put in order, and rows that share the nth."""
    kth = df.select(key).orderBy(key).limit(n).agg(F.max(key).alias("k"), F.count("*").alias("n")).first()
    if kth["n"] < n:
        return df
    below = df.where(F.col(key).isNull() | (F.col(key) < kth["k"]) if kth["k"] is not None else F.lit(False))
    tied = F.col(key).eqNullSafe(F.lit(kth["k"]))
    left = n - below.count()
    nth = F.row_number().over(Window.partitionBy(key).orderBy(key))
    return below.unionByName(df.where(tied).withColumn("_n", nth).where(F.col("_n") <= left).drop("_n"))


def stratified(
    df: DataFrame, strata: list[str], key: str, per_stratum: int | None, limit: int | None, seed: int = 42
) -> DataFrame:
    """At most ``per_stratum`` drawn rows of each stratum, then at most ``limit`` in all, if there is one."""
    if per_stratum is not None:
        w = Window.partitionBy(*strata).orderBy(draw(key, seed), key)
        df = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_stratum).drop("_n")
    return df if limit is None else random_n(df, key, limit, seed)


def numbered(df: DataFrame, key: str, seed: int = 42, prefix: int = 4) -> DataFrame:
    """Add ``position``, the place of each row in drawn order over the whole table.

    The leading hex digits of the draw cut the rows into 16^prefix even ranges: rows
    are counted per range, numbered within it, and the counts before it are added.
    No task holds more than one range.
    """
    drawn = df.withColumn("_draw", draw(key, seed)).withColumn("_range", F.substring("_draw", 1, prefix))
    counts = drawn.groupBy("_range").agg(F.count("*").alias("_count"))
    # At most 16^prefix rows, one per range, whatever the table holds.
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_draw", key))
    return (
        drawn.withColumn("_within", within)
        .join(F.broadcast(offsets), "_range")
        .withColumn("position", F.col("_before") + F.col("_within"))
        .drop("_draw", "_range", "_within", "_before")
    )
