"""Result files of the evaluation tracks: TSV and JSON into typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.evaluation import OVERALL

ENDPOINT_SCHEMA = "name string, method string, path string, status int, dur_s double, bytes int"
ASK_SCHEMA = (
    "pass int, fail int, error int, "
    "items array<struct<id:string,ok:boolean,notes:array<string>,sql:string,answer:string,error:string>>"
)
RESPONSE_SCHEMA = "id string, answer string, sql string, _dur_s double"
_SCORES = "struct<hits:int,total:int,recall:double>"
SEARCH_SCHEMA = (
    f"table string, sample int, k int, overall map<string,{_SCORES}>, "
    f"by_perturbation map<string,map<string,{_SCORES}>>"
)
REPORT_SCHEMA = "tests array<struct<nodeid:string,outcome:string,call:struct<duration:double>>>"


def first_text(a: Column, b: Column) -> Column:
    """``a`` unless it is missing or empty, else ``b``."""
    return F.coalesce(F.nullif(a, F.lit("")), b)


def load_endpoints(spark: SparkSession, path: str) -> DataFrame:
    """Endpoint summary, tab-separated without a header; blank lines are skipped."""
    rows = spark.read.schema(ENDPOINT_SCHEMA).csv(path, sep="\t", mode="FAILFAST", ignoreLeadingWhiteSpace=False)
    return rows.where(F.trim(F.coalesce("name", F.lit(""))) != "")


def load_ask(spark: SparkSession, results: str, responses: DataFrame | None = None, multi_line: bool = True) -> DataFrame:
    """(fixture_id, passed, notes, sql_text, answer, dur_s) of response-evaluation results.

    ``responses`` (see ``read_responses``) fills in SQL and answers that the results
    lack, and the latency.
    """
    items = (
        spark.read.schema(ASK_SCHEMA).json(results, multiLine=multi_line)
        .select(F.explode("items").alias("i")).select("i.*")
    )
    if responses is None:
        responses = spark.createDataFrame([], RESPONSE_SCHEMA)
    cached = responses.select(
        "id", F.col("sql").alias("c_sql"), F.col("answer").alias("c_answer"), F.col("_dur_s").alias("dur_s")
    )
    return items.join(cached, "id", "left").select(
        F.col("id").alias("fixture_id"),
        F.coalesce("ok", F.lit(False)).alias("passed"),
        F.nullif(F.array_join(F.coalesce("notes", F.expr("CAST(array() AS array<string>)")), "; "), F.lit("")).alias("notes"),
        first_text(F.col("sql"), F.col("c_sql")).alias("sql_text"),
        first_text(F.col("answer"), F.col("c_answer")).alias("answer"),
        "dur_s",
    )


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Cached responses, one JSON document per file; the file name without ``.json`` is the id.

    Unreadable files yield NULL fields instead of failing the load.
    """
    schema = "answer string, sql string, result struct<row_count:long>, _dur_s double"
    return (
        spark.read.schema(schema).json(path, multiLine=True)
        .withColumn("id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1))
        .select("id", "answer", "sql", F.col("result.row_count").alias("row_count"), "_dur_s")
    )


def load_search(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(strategy, perturbation, k, hits, total, recall) from search-evaluation results."""
    doc = spark.read.schema(SEARCH_SCHEMA).json(path, multiLine=multi_line)
    k = F.coalesce("k", F.lit(0)).alias("k")
    overall = doc.select(k, F.explode("overall").alias("strategy", "s")).select(
        "strategy", F.lit(OVERALL).alias("perturbation"), "k", "s.*"
    )
    detail = (
        doc.select(k, F.explode("by_perturbation").alias("perturbation", "m"))
        .select("k", "perturbation", F.explode("m").alias("strategy", "s"))
        .select("strategy", "perturbation", "k", "s.*")
    )
    return overall.unionByName(detail)


def load_report(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """(nodeid, outcome, dur_s) of a test report."""
    return (
        spark.read.schema(REPORT_SCHEMA).json(path, multiLine=multi_line)
        .select(F.explode("tests").alias("t"))
        .select("t.nodeid", F.coalesce("t.outcome", F.lit("unknown")).alias("outcome"), F.col("t.call.duration").alias("dur_s"))
    )
