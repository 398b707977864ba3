"""Checks on an embedding store: how distinct its vectors are, and whether it is sound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _digest(column: str):
    """A 32-byte stand-in for a long value, so distinct counts shuffle digests and not text or vectors."""
    return F.unhex(F.sha2(F.col(column).cast("string"), 256))


def embedding_health(store: DataFrame) -> DataFrame:
    """Rows, distinct contents, distinct vectors and their ratio, per table and column.

    Distinct values are first spread by value, so one column with a third of all rows
    is counted by many tasks.
    """
    return (
        store.select("table_name", "column_name", _digest("content").alias("c"), _digest("embedding").alias("e"))
        .groupBy("table_name", "column_name")
        .agg(
            F.count("*").alias("rows_total"),
            F.countDistinct("c").alias("distinct_contents"),
            F.countDistinct("e").alias("distinct_embeddings"),
        )
        .withColumn(
            "distinct_ratio",
            F.round(F.col("distinct_embeddings") / F.nullif(F.col("rows_total"), F.lit(0)), 4),
        )
    )


def embedding_health_approx(store: DataFrame, error: float = 0.02) -> DataFrame:
    """The same figures from sketches: one pass, one small row per table and column shuffled."""
    return (
        store.groupBy("table_name", "column_name")
        .agg(
            F.count("*").alias("rows_total"),
            F.approx_count_distinct("content", error).alias("distinct_contents"),
            F.approx_count_distinct("embedding", error).alias("distinct_embeddings"),
        )
        .withColumn(
            "distinct_ratio",
            F.round(F.col("distinct_embeddings") / F.nullif(F.col("rows_total"), F.lit(0)), 4),
        )
    )


#: Registers of a sketch, as a power of two; 16 KB per sketch at most.
SKETCH_BITS = 14
#: Three standard errors of a distinct count from such a sketch, merged or not.
SKETCH_BOUND = 3 * 1.04 / 2 ** (SKETCH_BITS / 2)


def health_sketches(rows: DataFrame) -> DataFrame:
    """(table_name, column_name, rows_written, contents, embeddings): sketches of the distinct values of a batch."""
    return rows.groupBy("table_name", "column_name").agg(
        F.count("*").alias("rows_written"),
        F.hll_sketch_agg(_digest("content"), F.lit(SKETCH_BITS)).alias("contents"),
        F.hll_sketch_agg(_digest("embedding"), F.lit(SKETCH_BITS)).alias("embeddings"),
    )


def keep_sketches(rows: DataFrame, path: str, batch: int) -> None:
    """Write the sketches of an upserted batch under ``path``; a batch written again replaces its own."""
    health_sketches(rows).write.mode("overwrite").parquet(f"{path}/batch={batch}")


def sketched_health(sketches: DataFrame) -> DataFrame:
    """The figures of ``embedding_health`` from the sketches of any number of batches, without reading a row of the store.

    A sketch forgets nothing: values that a later batch replaced still count, until the sketches are taken anew of a
    compacted store. Each estimate is within ``SKETCH_BOUND`` of the distinct values written, as a share of them, but
    for about three cases in a thousand.
    """
    return (
        sketches.groupBy("table_name", "column_name")
        .agg(
            F.sum("rows_written").alias("rows_written"),
            F.hll_sketch_estimate(F.hll_union_agg("contents")).alias("distinct_contents"),
            F.hll_sketch_estimate(F.hll_union_agg("embeddings")).alias("distinct_embeddings"),
        )
        .withColumn(
            "distinct_ratio", F.round(F.col("distinct_embeddings") / F.nullif(F.col("rows_written"), F.lit(0)), 4)
        )
    )


def check_sketches(estimated: DataFrame, exact: DataFrame) -> DataFrame:
    """Exact counts, the estimates beside them, and whether each error is within the bound."""
    key = ["table_name", "column_name"]
    counts = ["distinct_contents", "distinct_embeddings"]
    guesses = estimated.select(*key, *[F.col(c).alias(f"{c}_estimate") for c in counts])

    def within(c: str):
        return (F.abs(F.col(f"{c}_estimate") - F.col(c)) <= F.ceil(F.col(c) * SKETCH_BOUND)).alias(f"{c}_within")

    return exact.join(guesses, key).select(*key, *counts, *[f"{c}_estimate" for c in counts], *[within(c) for c in counts])


def validate_store(store: DataFrame, dim: int) -> DataFrame:
    """(rows_total, null_vectors, wrong_dimension, duplicate_keys); duplicates count the rows beyond the first."""
    key = ["table_name", "column_name", "row_id"]
    per_key = store.groupBy(*key).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("embedding").isNull()).alias("null_vectors"),
        F.count_if(F.size("embedding") != dim).alias("wrong_dimension"),
    )
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_total"),
        F.coalesce(F.sum("null_vectors"), F.lit(0)).alias("null_vectors"),
        F.coalesce(F.sum("wrong_dimension"), F.lit(0)).alias("wrong_dimension"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_keys"),
    )


def collapsed_vectors(store: DataFrame) -> DataFrame:
    """(first_id, rows_total, contents) for each vector that several distinct contents share."""
    return (
        store.where(F.col("embedding").isNotNull())
        .select("id", _digest("content").alias("c"), _digest("embedding").alias("e"))
        .groupBy("e", "c")
        .agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
        .groupBy("e")
        .agg(
            F.min("first_id").alias("first_id"), F.sum("n").alias("rows_total"), F.count("*").alias("contents")
        )
        .where(F.col("contents") > 1)
        .drop("e")
    )
