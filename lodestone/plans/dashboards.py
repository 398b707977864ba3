"""The dashboard data sets over run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.relational import latest_per, latest_run, rows_of_latest
from lodestone.plans.registry import Tables, plan
from lodestone.plans.standins import (
    ASK, ENDPOINTS, ITEMS_SQL, OPS_SEARCH_SQL, PYTEST, RUNS_SQL, SEARCH, ops_items, ops_runs, ops_search,
)


def _latest_sql(track: str) -> str:
    return f"latest AS (SELECT run_id FROM ops_runs WHERE track = '{track}' ORDER BY ran_at DESC, run_id DESC LIMIT 1)"


@plan("latest_runs", f"""
WITH {RUNS_SQL}
SELECT track, run_id, ran_at FROM (
    SELECT *, row_number() OVER (PARTITION BY track ORDER BY ran_at DESC, run_id DESC) AS n FROM ops_runs
) WHERE n = 1
""")
def latest_runs(spark: SparkSession, folder: str) -> DataFrame:
    runs = ops_runs(Tables(spark, folder))
    return latest_per(runs, ["track"], [F.col("ran_at").desc(), F.col("run_id").desc()]).select(
        "track", "run_id", "ran_at"
    )


@plan("latest_run_rows", f"""
WITH {ITEMS_SQL}, {_latest_sql(ENDPOINTS)}
SELECT event_id, fixture_id, passed, dur_s FROM ops_items
WHERE run_id IN (SELECT run_id FROM latest) ORDER BY fixture_id, event_id
""")
def latest_run_rows(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    runs = ops_runs(t)
    return (
        rows_of_latest(ops_items(t, runs), runs, ENDPOINTS)
        .select("event_id", "fixture_id", "passed", "dur_s")
        .orderBy("fixture_id", "event_id")
    )


@plan("outcome_counts", f"""
WITH {ITEMS_SQL}, {_latest_sql(PYTEST)}
SELECT CASE WHEN passed THEN 'passed' ELSE 'failed' END AS outcome, count(*) AS n FROM ops_items
WHERE run_id IN (SELECT run_id FROM latest) GROUP BY 1 ORDER BY n DESC
""")
def outcome_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    runs = ops_runs(t)
    outcome = F.when(F.col("passed"), "passed").otherwise("failed")
    return (
        rows_of_latest(ops_items(t, runs), runs, PYTEST)
        .groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "outcome")
    )


@plan("semi_latest", f"""
WITH {ITEMS_SQL}, {_latest_sql(SEARCH)}
SELECT run_id, event_id, fixture_id FROM ops_items WHERE run_id IN (SELECT run_id FROM latest)
""")
def semi_latest(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    runs = ops_runs(t)
    return rows_of_latest(ops_items(t, runs), runs, SEARCH).select("run_id", "event_id", "fixture_id")


@plan("join_using", f"""
WITH {ITEMS_SQL}
SELECT r.track, count(*) AS items, count(i.dur_s) AS timed,
       CAST(sum(CAST(i.dur_s AS DECIMAL(18,2))) AS DOUBLE) AS total_dur
FROM ops_runs r JOIN ops_items i USING (run_id) GROUP BY r.track
""")
def join_using(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    runs = ops_runs(t)
    return (
        ops_items(t, runs).join(runs, "run_id").groupBy("track")
        .agg(
            F.count("*").alias("items"),
            F.count("dur_s").alias("timed"),
            F.sum(F.col("dur_s").cast("decimal(18,2)")).cast("double").alias("total_dur"),
        )
    )


@plan("pass_rate", f"""
WITH {ITEMS_SQL}
SELECT r.ran_at, round(avg(CASE WHEN i.passed THEN 1.0 ELSE 0.0 END), 9) AS pass_rate, count(*) AS fixtures
FROM ops_runs r JOIN ops_items i USING (run_id) WHERE r.track = '{ASK}' GROUP BY r.ran_at ORDER BY r.ran_at
""")
def pass_rate(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    runs = ops_runs(t).where(F.col("track") == ASK)
    return (
        ops_items(t, runs).join(runs.select("run_id", "ran_at"), "run_id")
        .groupBy("ran_at")
        .agg(
            F.round(F.avg(F.when(F.col("passed"), 1.0).otherwise(0.0)), 9).alias("pass_rate"),
            F.count("*").alias("fixtures"),
        )
        .orderBy("ran_at")
    )


@plan("fixture_trend", f"""
WITH {ITEMS_SQL}
SELECT i.fixture_id, CAST(r.ran_at AS DATE) AS day, max(CASE WHEN i.passed THEN 1 ELSE 0 END) AS passed
FROM ops_runs r JOIN ops_items i USING (run_id) WHERE r.track = '{ASK}'
GROUP BY 1, 2 ORDER BY 1, 2
""")
def fixture_trend(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    runs = ops_runs(t).where(F.col("track") == ASK)
    return (
        ops_items(t, runs).join(runs.select("run_id", "ran_at"), "run_id")
        .groupBy("fixture_id", F.to_date("ran_at").alias("day"))
        .agg(F.max(F.when(F.col("passed"), 1).otherwise(0)).alias("passed"))
        .orderBy("fixture_id", "day")
    )


@plan("latency_latest", f"""
WITH {ITEMS_SQL}, {_latest_sql(ASK)}
SELECT event_id, fixture_id, dur_s FROM ops_items WHERE run_id IN (SELECT run_id FROM latest)
ORDER BY dur_s DESC NULLS LAST, event_id
""")
def latency_latest(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    runs = ops_runs(t)
    return (
        rows_of_latest(ops_items(t, runs), runs, ASK)
        .select("event_id", "fixture_id", "dur_s")
        .orderBy(F.col("dur_s").desc_nulls_last(), "event_id")
    )


@plan("nulls_last", f"""
WITH {ITEMS_SQL}
SELECT event_id, dur_s FROM ops_items ORDER BY dur_s DESC NULLS LAST, event_id
""")
def nulls_last(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return ops_items(t, ops_runs(t)).select("event_id", "dur_s").orderBy(F.col("dur_s").desc_nulls_last(), "event_id")


@plan("recall_trend", f"""
WITH {OPS_SEARCH_SQL}
SELECT r.ran_at, s.strategy, s.recall FROM ops_runs r JOIN ops_search s USING (run_id)
WHERE r.track = '{SEARCH}' AND s.perturbation = '__overall__' ORDER BY r.ran_at, s.strategy
""")
def recall_trend(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    runs = ops_runs(t)
    return (
        ops_search(t, runs).where(F.col("perturbation") == "__overall__")
        .join(runs.where(F.col("track") == SEARCH), "run_id")
        .select("ran_at", "strategy", "recall").orderBy("ran_at", "strategy")
    )


@plan("recall_pivot", f"""
WITH {OPS_SEARCH_SQL}, {_latest_sql(SEARCH)}
SELECT perturbation,
       max(CASE WHEN strategy = 'bm25' THEN recall END) AS bm25,
       max(CASE WHEN strategy = 'rrf' THEN recall END) AS rrf,
       max(CASE WHEN strategy = 'vector' THEN recall END) AS vector
FROM ops_search WHERE run_id IN (SELECT run_id FROM latest) AND perturbation <> '__overall__'
GROUP BY perturbation ORDER BY perturbation
""")
def recall_pivot(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    runs = ops_runs(t)
    newest = runs.join(latest_run(runs, SEARCH), "run_id", "left_semi")
    return (
        ops_search(t, newest).where(F.col("perturbation") != "__overall__")
        .groupBy("perturbation").pivot("strategy", ["bm25", "rrf", "vector"]).agg(F.max("recall"))
        .orderBy("perturbation")
    )
