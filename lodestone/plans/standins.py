"""Run history and embedding store as derived from the test tables, in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.registry import Tables
from lodestone.session import stage

ASK, PYTEST, ENDPOINTS, SEARCH = "purchase", "click", "signup", "view"

CORPUS_SQL = """
corpus AS (
    SELECT d.doc_id AS id, d.source AS table_name, 'text' AS column_name,
           CAST(d.doc_id AS VARCHAR) AS row_id, d.text AS content, e.embedding
    FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id
)"""

RUNS_SQL = """
ops_runs AS (
    SELECT min(event_id) AS run_id, event_type AS track, min(ts) AS ran_at
    FROM events GROUP BY event_type, CAST(ts AS DATE)
)"""

ITEMS_SQL = RUNS_SQL + """,
ops_items AS (
    SELECT r.run_id, e.event_id, concat('f', CAST(e.user_id % 5 AS VARCHAR)) AS fixture_id,
           e.value >= 10 AS passed,
           CASE WHEN e.user_id % 7 = 0 THEN NULL ELSE e.value END AS dur_s
    FROM events e JOIN ops_runs r
      ON e.event_type = r.track AND CAST(e.ts AS DATE) = CAST(r.ran_at AS DATE)
)"""

OPS_SEARCH_SQL = RUNS_SQL + """,
ops_search AS (
    SELECT r.run_id,
           CASE e.user_id % 3 WHEN 0 THEN 'vector' WHEN 1 THEN 'bm25' ELSE 'rrf' END AS strategy,
           CASE e.event_id % 3 WHEN 0 THEN '__overall__' WHEN 1 THEN 'typo' ELSE 'truncate' END AS perturbation,
           CAST(sum(CAST(e.value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS recall
    FROM events e JOIN ops_runs r
      ON e.event_type = r.track AND CAST(e.ts AS DATE) = CAST(r.ran_at AS DATE)
    WHERE r.track = 'view' GROUP BY 1, 2, 3
)"""


def corpus(t: Tables) -> DataFrame:
    documents = t.documents.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("table_name"),
        F.lit("text").alias("column_name"),
        F.col("doc_id").cast("string").alias("row_id"),
        F.col("text").alias("content"),
    )
    return documents.join(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id", "left")


def ops_runs(t: Tables) -> DataFrame:
    """The small parent table, staged so that joins see its real size."""
    runs = t.events.groupBy(F.col("event_type").alias("track"), F.to_date("ts").alias("day")).agg(
        F.min("event_id").alias("run_id"), F.min("ts").alias("ran_at")
    )
    return stage(runs.select("run_id", "track", "ran_at", "day"), "runs")


def _events_of_runs(t: Tables, runs: DataFrame) -> DataFrame:
    events = t.events.withColumn("day", F.to_date("ts")).withColumnRenamed("event_type", "track")
    return events.join(runs.select("run_id", "track", "day"), ["track", "day"])


def ops_items(t: Tables, runs: DataFrame) -> DataFrame:
    return _events_of_runs(t, runs).select(
        "run_id", "event_id",
        F.concat(F.lit("f"), (F.col("user_id") % 5).cast("string")).alias("fixture_id"),
        (F.col("value") >= 10).alias("passed"),
        F.when(F.col("user_id") % 7 != 0, F.col("value")).alias("dur_s"),
    )


def ops_search(t: Tables, runs: DataFrame) -> DataFrame:
    user, event = F.col("user_id") % 3, F.col("event_id") % 3
    return (
        _events_of_runs(t, runs.where(F.col("track") == SEARCH))
        .groupBy(
            "run_id",
            F.when(user == 0, "vector").when(user == 1, "bm25").otherwise("rrf").alias("strategy"),
            F.when(event == 0, "__overall__").when(event == 1, "typo").otherwise("truncate").alias("perturbation"),
        )
        .agg((F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("recall"))
    )
