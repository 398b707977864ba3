"""Run history and embedding store kept as versioned Parquet folders.

A rewrite makes the next version beside the last and readers take the newest
finished one, so a job lost half way leaves the data as it was. Appending a run
and upserting a batch only add files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.relational import latest_per
from lodestone.operators.sampling import numbered
from lodestone.session import stage

# The key and the columns of the embedding store.
STORE_KEY = ["table_name", "column_name", "row_id"]
STORE_SCHEMA = (
    "id long, table_name string, column_name string, row_id string, content string, embedding array<float>"
)
# The columns of the run history and its child tables.
RUNS_SCHEMA = "run_id long, track string, ran_at timestamp, source_path string, notes string"
CHILDREN = ("endpoint_smoke", "ask_eval", "search_eval", "pytest_runs")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def latest_version(spark: SparkSession, path: str, finished: str = "_SUCCESS") -> int:
    """The newest version under ``path`` that holds the file ``finished``; 0 if there is none."""
    if not _exists(spark, path):
        return 0
    fs, p = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    numbers = [int(n[2:]) for n in names if n.startswith("v=")]
    return max((v for v in numbers if _exists(spark, f"{path}/v={v}/{finished}")), default=0)


# --- run history -----------------------------------------------------------------


def next_run_id(runs: DataFrame, highest: int = 0) -> int:
    """The id after the largest so far; ``highest`` has been given out, though its run may be gone."""
    return max(runs.agg(F.coalesce(F.max("run_id"), F.lit(0))).first()[0], highest) + 1


def run_row(
    runs: DataFrame, run_id: int, track: str, ran_at: Column | None = None,
    source_path: str | None = None, notes: str | None = None,
) -> DataFrame:
    return runs.sparkSession.range(1).select(
        F.lit(run_id).cast("long").alias("run_id"),
        F.lit(track).alias("track"),
        (F.current_timestamp() if ran_at is None else ran_at).alias("ran_at"),
        F.lit(source_path).cast("string").alias("source_path"),
        F.lit(notes).cast("string").alias("notes"),
    )


def cascade(survivors: DataFrame, child: DataFrame) -> DataFrame:
    """The child rows whose run survives."""
    return child.join(survivors.select("run_id"), "run_id", "left_semi")


class RunHistory:
    """``runs`` and its child tables in one folder. One writer at a time.

    The rows of each run lie in a folder of their own, written before the run itself.
    What a lost job leaves behind belongs to no run: it is never read, and the next
    run with that id writes over it.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, version: int | None = None) -> str:
        if version is None:
            version = latest_version(self.spark, self.path, "runs/_SUCCESS") or 1
        return f"{self.path}/v={version}"

    def runs(self) -> DataFrame:
        path = f"{self._folder()}/runs"
        if not _exists(self.spark, f"{path}/_SUCCESS"):
            return self.spark.createDataFrame([], RUNS_SCHEMA)
        return self.spark.read.schema(RUNS_SCHEMA).parquet(path)

    def table(self, name: str) -> DataFrame | None:
        """The rows of a child table, None if no run has written any."""
        path = f"{self._folder()}/{name}"
        if not _exists(self.spark, path):
            return None
        fs, p = _fs(self.spark, path)
        parts = [f"{path}/{s.getPath().getName()}" for s in fs.listStatus(p)]
        parts = [part for part in parts if _exists(self.spark, f"{part}/_SUCCESS")]
        return cascade(self.runs(), self.spark.read.parquet(*parts)) if parts else None

    def append(
        self, track: str, child: str, rows: DataFrame, ran_at: Column | None = None,
        source_path: str | None = None, notes: str | None = None,
    ) -> int | None:
        """Add a run with its rows and return its id; without rows there is no run and None comes back."""
        runs, folder = self.runs(), self._folder()
        rows = stage(rows, "run-rows")
        if rows.isEmpty():
            return None
        run_id = next_run_id(runs, self._highest())
        numbered_rows = rows.select(F.lit(run_id).cast("long").alias("run_id"), "*")
        numbered_rows.write.mode("overwrite").parquet(f"{folder}/{child}/run-{run_id}")
        run_row(runs, run_id, track, ran_at, source_path, notes).write.mode("append").parquet(f"{folder}/runs")
        return run_id

    def _highest(self) -> int:
        """The largest id given out before the last rewrite, 0 if none is known."""
        path = f"{self._folder()}/highest"
        return self.spark.read.parquet(path).first()[0] if _exists(self.spark, f"{path}/_SUCCESS") else 0

    def replace(self, runs: DataFrame, children: dict[str, DataFrame], highest: int = 0) -> None:
        """Make ``runs`` and the child tables given the whole history; ids up to ``highest`` are not given out again."""
        folder = self._folder(latest_version(self.spark, self.path, "runs/_SUCCESS") + 1)
        self.spark.range(1).select(F.lit(highest).cast("long").alias("run_id")).write.mode("overwrite").parquet(f"{folder}/highest")
        for child, rows in children.items():
            rows.write.mode("overwrite").parquet(f"{folder}/{child}/kept")
        runs.write.mode("overwrite").parquet(f"{folder}/runs")

    def delete(self, condition: Column) -> None:
        """Delete the runs meeting ``condition`` and their child rows. Their ids are not given out again."""
        highest = next_run_id(self.runs(), self._highest()) - 1
        survivors = self.runs().where(~F.coalesce(condition, F.lit(False)))
        children = {child: self.table(child) for child in CHILDREN}
        self.replace(survivors, {c: cascade(survivors, rows) for c, rows in children.items() if rows is not None}, highest)

    def truncate(self) -> None:
        """Drop all runs and start counting anew."""
        none = self.runs().where("false")
        children = {child: self.table(child) for child in CHILDREN}
        self.replace(none, {c: rows.where("false") for c, rows in children.items() if rows is not None})


# --- embedding store -------------------------------------------------------------


def changes(store: DataFrame, batch: DataFrame, order_by: str | None = None) -> DataFrame:
    """The rows an upsert of ``batch`` writes: a known key keeps its id and gets the new content
    and vector, a new key gets an id after the largest so far.

    A key repeated within the batch is taken once: the row with the greatest ``order_by``
    (a column of the batch that says in which order its rows came), of equals the one with
    the greatest content and vector. A null in the key or the content is an error. The batch
    is staged, so against a small batch the store's keys are scanned in place, and only
    a batch too large to broadcast makes them shuffle.
    """
    newest = F.struct((F.col(order_by) if order_by else F.lit(0)).alias("at"), "content", "embedding")
    incoming = stage(
        batch.groupBy(*STORE_KEY)
        .agg(F.max(newest).alias("new"), F.bool_or(F.col("content").isNull()).alias("empty"))
        .select(*STORE_KEY, "new.content", "new.embedding", "empty"),
        "upsert-batch",
    )
    unfit = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in STORE_KEY], F.col("empty"))
    if not incoming.where(unfit).isEmpty():
        raise ValueError("an upserted row needs a key and content")
    incoming = incoming.drop("empty")
    columns = ["id", *STORE_KEY, "content", "embedding"]
    known = stage(store.select("id", *STORE_KEY).join(incoming.select(*STORE_KEY), STORE_KEY), "upsert-known")
    replaced = known.join(incoming, STORE_KEY).select(*columns)
    last = store.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    added = incoming.join(known.select(*STORE_KEY), STORE_KEY, "left_anti").withColumn(
        "_key", F.concat_ws("\u0001", *STORE_KEY)
    )
    added = numbered(added, "_key").withColumn("id", F.lit(last) + F.col("position")).select(*columns)
    return replaced.unionByName(added)


class EmbeddingStore:
    """The embedding store as a base and the batches upserted since. One writer at a time.

    An upsert writes the batch and nothing else, however large the store. Reading puts
    the newest row of each changed key in place of the base's; changed keys that are few are
    broadcast to the base, many are met by a shuffle of its rows. ``compact`` folds the batches
    into a new base; it is a job of its own, which no upsert starts. ``state`` names what has been
    written, and ``changed_since`` reads what came after, so an index can follow the store.
    Files are partitioned by table and column, so a search of one table reads no other.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _version(self) -> int:
        return latest_version(self.spark, self.path, "batch=0/_SUCCESS")

    def _batches(self, version: int) -> list[int]:
        if not version:
            return []
        fs, p = _fs(self.spark, f"{self.path}/v={version}")
        numbers = sorted(int(s.getPath().getName()[6:]) for s in fs.listStatus(p))
        return [n for n in numbers if _exists(self.spark, f"{self.path}/v={version}/batch={n}/_SUCCESS")]

    def _rows(self, version: int, batch: int) -> DataFrame:
        rows = self.spark.read.schema(STORE_SCHEMA).parquet(f"{self.path}/v={version}/batch={batch}")
        return rows.select("id", *STORE_KEY, "content", "embedding")

    def read(self) -> DataFrame:
        version = self._version()
        if not version:
            return self.spark.createDataFrame([], STORE_SCHEMA)
        base, *later = self._batches(version)
        rows = self._rows(version, base)
        if not later:
            return rows
        changed = [self._rows(version, n).withColumn("_batch", F.lit(n)) for n in later]
        newest = latest_per(reduce(DataFrame.unionByName, changed), STORE_KEY, [F.col("_batch").desc()]).drop("_batch")
        return rows.join(newest.select(*STORE_KEY), STORE_KEY, "left_anti").select(*newest.columns).unionByName(newest)

    def state(self) -> str:
        """Names what the store holds: its version and the last batch in it."""
        version = self._version()
        return f"{version}.{max(self._batches(version), default=0)}"

    def changed_since(self, state: str) -> DataFrame:
        """The newest row of every key upserted after ``state``; ValueError if the base was written anew since."""
        version, batch = map(int, state.split("."))
        if version != self._version():
            raise ValueError(f"the base was written anew after {state}")
        later = [self._rows(version, n).withColumn("_batch", F.lit(n)) for n in self._batches(version) if n > batch]
        if not later:
            return self.read().limit(0)
        return latest_per(reduce(DataFrame.unionByName, later), STORE_KEY, [F.col("_batch").desc()]).drop("_batch")

    def upsert(self, batch: DataFrame, order_by: str | None = None) -> None:
        """Write ``batch``; of rows with one key the last by ``order_by`` counts."""
        version = self._version()
        batches = self._batches(version)
        rows = changes(self.read(), batch, order_by)
        self._write(rows, version or 1, batches[-1] + 1 if batches else 0)

    def replace(self, rows: DataFrame) -> None:
        """Make ``rows``, ids included, the new base."""
        self._write(rows, self._version() + 1, 0)

    def vacuum(self) -> None:
        """Remove all versions but the newest; nobody may be reading an older one."""
        fs, p = _fs(self.spark, self.path)
        newest = self._version()
        for s in fs.listStatus(p) if newest else ():
            name = s.getPath().getName()
            if name.startswith("v=") and int(name[2:]) < newest:
                fs.delete(s.getPath(), True)

    def compact(self) -> None:
        """Fold all batches into a new base."""
        self.replace(self.read())

    def _write(self, rows: DataFrame, version: int, batch: int) -> None:
        # Rebalanced, a small table is one file and a large one is written by many tasks. Sorted by id, row
        # groups that hold none of the ids asked for are not read.
        (
            rows.select("id", *STORE_KEY, "content", "embedding")
            .hint("rebalance", "table_name", "column_name")
            .sortWithinPartitions("table_name", "column_name", "id")
            .write.mode("overwrite").partitionBy("table_name", "column_name")
            .parquet(f"{self.path}/v={version}/batch={batch}")
        )
