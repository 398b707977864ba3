"""Relational building blocks shared by the reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def money(amount: Column) -> Column:
    """Amounts as exact decimals, so that sums do not depend on the order of rows."""
    return amount.cast("decimal(18,2)")


def fiscal_year(day: Column) -> Column:
    """Fiscal years start in October and are named after the calendar year they end in."""
    return F.year(day) + (F.month(day) >= 10).cast("int")


def in_fiscal_year(day: Column, year: int) -> Column:
    """The same test as a plain range, which a Parquet scan can push down."""
    start = F.lit(f"{year - 1}-10-01").cast("timestamp_ntz")
    end = F.lit(f"{year}-10-01").cast("timestamp_ntz")
    return (day >= start) & (day < end)


def latest_per(df: DataFrame, keys: list[str], newest_first: list[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*newest_first)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == 1).drop("_n")


def latest_run(runs: DataFrame, track: str) -> DataFrame:
    """run_id of the newest run of a track; at most one row, so joining it never shuffles the other side."""
    return (
        runs.where(F.col("track") == track).orderBy(F.col("ran_at").desc(), F.col("run_id").desc())
        .limit(1).select("run_id")
    )


def rows_of_latest(items: DataFrame, runs: DataFrame, track: str) -> DataFrame:
    return items.join(latest_run(runs, track), "run_id", "left_semi")


def fk_check(tables: dict[str, DataFrame], pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """(child, column_name, parent, rows_total, orphans) for each (child, column, parent, key).

    A child table is read once for all its pairs: a row gives one key for each. Child keys are counted
    before the join, so a key that fills a third of the table reaches it as one row. Keys are compared as
    the parent's type, written as text. NULL keys refer to nothing and are not orphans.
    """
    spark = tables[pairs[0][0]].sparkSession
    types = [tables[parent].schema[key].dataType for _, _, parent, key in pairs]

    def counts(child: str) -> DataFrame:
        keys = F.array(*[
            F.struct(
                F.lit(n).alias("_pair"), F.col(column).isNotNull().alias("_given"),
                F.col(column).try_cast(types[n]).cast("string").alias("_k"),
            )
            for n, (of, column, _, _) in enumerate(pairs) if of == child
        ])
        keyed = tables[child].select(F.explode(keys).alias("_e")).select("_e.*")
        return keyed.groupBy("_pair", "_given", "_k").agg(F.count("*").alias("_n"))

    def known(n: int, parent: str, key: str) -> DataFrame:
        return tables[parent].select(F.lit(n).alias("_pair"), F.col(key).cast("string").alias("_k"))

    met = reduce(DataFrame.unionByName, [known(n, parent, key) for n, (_, _, parent, key) in enumerate(pairs)])
    asked = reduce(DataFrame.unionByName, [counts(child) for child in dict.fromkeys(pair[0] for pair in pairs)])
    missing = F.col("_known").isNull() & F.col("_given")
    found = asked.join(met.distinct().withColumn("_known", F.lit(True)), ["_pair", "_k"], "left").groupBy("_pair").agg(
        F.sum("_n").alias("rows_total"), F.sum(F.when(missing, F.col("_n"))).alias("orphans")
    )
    names = spark.createDataFrame([(n, *pair[:3]) for n, pair in enumerate(pairs)], "_pair int, child string, column_name string, parent string")
    # An empty child has no counts, but its pairs are listed.
    return names.join(found, "_pair", "left").select(
        "child", "column_name", "parent",
        F.coalesce("rows_total", F.lit(0)).alias("rows_total"), F.coalesce("orphans", F.lit(0)).alias("orphans"),
    )


def missing_keys(needed: DataFrame, key: str, present: DataFrame, present_key: str) -> DataFrame:
    return needed.select(key).join(present.select(F.col(present_key).alias(key)), key, "left_anti")


def table_inventory(tables: dict[str, DataFrame], top: int = 10, bytes_too: bool = False) -> DataFrame:
    """(table_name, rows_total[, bytes]), largest first. Counts come from file footers, no column is read."""

    def one(name: str, df: DataFrame) -> DataFrame:
        if not bytes_too:
            return df.agg(F.lit(name).alias("table_name"), F.count("*").alias("rows_total"))
        files = df.groupBy(F.col("_metadata.file_path").alias("f")).agg(
            F.count("*").alias("n"), F.max("_metadata.file_size").alias("b")
        )
        return files.agg(
            F.lit(name).alias("table_name"), F.sum("n").alias("rows_total"), F.sum("b").alias("bytes")
        )

    rows = reduce(DataFrame.unionByName, [one(name, df) for name, df in tables.items()])
    return rows.orderBy(F.col("bytes" if bytes_too else "rows_total").desc(), "table_name").limit(top)
