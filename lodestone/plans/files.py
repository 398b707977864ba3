"""Result files written from the test tables and loaded again, and response scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.evaluation import score_responses, tally
from lodestone.plans.registry import Tables, plan
from lodestone.session import scratch_path
from lodestone.sources import results


@plan("load_endpoint_tsv", """
SELECT event_type AS name, 'POST' AS method, '/' || event_type AS path,
       CASE WHEN value >= 10 THEN 200 ELSE 500 END AS status, value AS dur_s, CAST(event_id AS INT) AS bytes
FROM events
""")
def load_endpoint_tsv(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{scratch_path(spark, 'tsv')}/summary"
    status = F.when(F.col("value") >= 10, "200").otherwise("500")
    line = F.concat_ws(
        "\t", "event_type", F.lit("POST"), F.concat(F.lit("/"), "event_type"), status,
        F.col("value").cast("string"), F.col("event_id").cast("string"),
    )
    # A blank line after every seventh row, which the loader has to skip.
    lines = F.when(F.col("event_id") % 7 == 0, F.array(line, F.lit(""))).otherwise(F.array(line))
    Tables(spark, folder).events.select(F.explode(lines).alias("value")).write.text(path)
    return results.load_endpoints(spark, path)


@plan("load_ask_items", """
SELECT 'e' || event_id AS fixture_id, value >= 10 AS passed,
       CASE user_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'slow' ELSE 'slow; wrong' END AS notes,
       CASE WHEN event_id % 2 = 0 THEN 'SELECT 1' WHEN user_id % 4 <> 0 THEN 'SELECT ' || user_id END AS sql_text,
       CASE WHEN event_type <> 'view' THEN event_type WHEN user_id % 4 <> 0 THEN 'cached' END AS answer,
       CASE WHEN user_id % 4 <> 0 THEN value END AS dur_s
FROM events
""")
def load_ask_items(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "ask")
    user = F.col("user_id")
    key = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    none = F.expr("CAST(array() AS array<string>)")
    notes = F.when(user % 3 == 0, none).when(user % 3 == 1, F.array(F.lit("slow"))).otherwise(
        F.array(F.lit("slow"), F.lit("wrong"))
    )
    item = F.struct(
        key.alias("id"), (F.col("value") >= 10).alias("ok"), notes.alias("notes"),
        F.when(F.col("event_id") % 2 == 0, "SELECT 1").otherwise("").alias("sql"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("answer"),
    )
    events = Tables(spark, folder).events
    events.select(F.array(item).alias("items")).write.json(f"{path}/results")
    (
        events.where(user % 4 != 0)
        .select(
            key.alias("id"), F.lit("cached").alias("answer"),
            F.concat(F.lit("SELECT "), user.cast("string")).alias("sql"), F.col("value").alias("_dur_s"),
        )
        .write.json(f"{path}/responses")
    )
    cached = spark.read.schema(results.RESPONSE_SCHEMA).json(f"{path}/responses")
    return results.load_ask(spark, f"{path}/results", cached, multi_line=False)


@plan("load_search_maps", """
WITH doc AS (SELECT CAST(user_id AS INT) AS h, CAST(user_id + 10 AS INT) AS t, event_type AS p FROM events),
s AS (SELECT unnest(['vector', 'bm25', 'rrf']) AS strategy)
SELECT strategy, '__overall__' AS perturbation, 10 AS k, h AS hits, t AS total, h / t AS recall FROM doc CROSS JOIN s
UNION ALL
SELECT strategy, p, 10, h, t, h / t FROM doc CROSS JOIN s
UNION ALL
SELECT strategy, 'identity', 10, t, t, 1.0 FROM doc CROSS JOIN s
""")
def load_search_maps(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{scratch_path(spark, 'search')}/results"
    h = F.col("user_id").cast("int")
    t = (F.col("user_id") + 10).cast("int")

    def scores(hits):
        one = F.struct(hits.alias("hits"), t.alias("total"), (hits / t).alias("recall"))
        return F.create_map(*[x for s in ("vector", "bm25", "rrf") for x in (F.lit(s), one)])

    Tables(spark, folder).events.select(
        F.lit("documents").alias("table"), F.lit(100).alias("sample"), F.lit(10).alias("k"),
        scores(h).alias("overall"),
        F.create_map(F.col("event_type"), scores(h), F.lit("identity"), scores(t)).alias("by_perturbation"),
    ).write.json(path)
    return results.load_search(spark, path, multi_line=False)


@plan("load_test_report", """
SELECT 'test_' || event_id AS nodeid, CASE WHEN user_id % 3 = 0 THEN 'unknown' ELSE event_type END AS outcome,
       CASE WHEN user_id % 5 <> 0 THEN value END AS dur_s
FROM events
UNION ALL SELECT 'test_' || event_id || '_setup', 'passed', NULL FROM events
""")
def load_test_report(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{scratch_path(spark, 'report')}/report"
    node = F.concat(F.lit("test_"), F.col("event_id").cast("string"))
    call = F.struct(F.col("value").alias("duration"))
    test = F.struct(
        node.alias("nodeid"),
        F.when(F.col("user_id") % 3 != 0, F.col("event_type")).alias("outcome"),
        F.when(F.col("user_id") % 5 != 0, call).alias("call"),
    )
    setup = F.struct(
        F.concat(node, F.lit("_setup")).alias("nodeid"), F.lit("passed").alias("outcome"),
        F.lit(None).cast("struct<duration:double>").alias("call"),
    )
    Tables(spark, folder).events.select(F.array(test, setup).alias("tests")).write.json(path)
    return results.load_report(spark, path, multi_line=False)


_SCORED_SQL = """
WITH fixtures AS (
    SELECT conv_id || '-' || turn AS id,
           CASE WHEN turn % 4 = 0 THEN 'select' END AS sql_starts_with,
           CASE WHEN conv_id % 5 = 0 THEN 3 END AS row_count_eq,
           CASE WHEN conv_id % 2 = 0 THEN 1 END AS row_count_min,
           ['count', 'DELETE'] AS sql_contains_any,
           CASE WHEN conv_id % 7 = 0 THEN ['from', 'FROM t'] END AS sql_contains_any_2,
           [substr(text, 1, 3), 'QUE '] AS answer_contains_any,
           CASE WHEN turn = 0 THEN ['ENCH', 'delete'] ELSE [] END AS answer_must_not_contain,
           conv_id % 3 = 1 AS select_only
    FROM conversations WHERE role = 'user'
),
responses AS (
    SELECT conv_id || '-' || (turn - 1) AS id, trim(text, ' ') AS answer,
           CASE conv_id % 3 WHEN 0 THEN '((SELECT count(*) FROM t))' WHEN 1 THEN 'DELETE FROM t' ELSE '' END AS sql,
           CASE WHEN conv_id % 6 <> 0 THEN length(text) % 5 END AS row_count
    FROM conversations WHERE role = 'assistant'
),
checked AS (
    SELECT f.id, r.id IS NOT NULL AS answered, [x FOR x IN list_concat(list_concat([
        CASE WHEN sql_starts_with IS NOT NULL AND NOT starts_with(upper(sql), upper(sql_starts_with))
             THEN 'sql does not start with ''' || sql_starts_with || '''' END,
        CASE WHEN row_count_eq IS NOT NULL AND row_count IS DISTINCT FROM row_count_eq
             THEN 'row_count=' || coalesce(row_count::VARCHAR, 'None') || ', expected ' || row_count_eq END,
        CASE WHEN row_count_min IS NOT NULL AND (row_count IS NULL OR row_count < row_count_min)
             THEN 'row_count=' || coalesce(row_count::VARCHAR, 'None') || ', expected >= ' || row_count_min END,
        CASE WHEN len(list_filter(sql_contains_any, lambda n: contains(sql, n))) = 0
             THEN 'sql missing any of [''' || array_to_string(sql_contains_any, ''', ''') || ''']' END,
        CASE WHEN sql_contains_any_2 IS NOT NULL AND len(list_filter(sql_contains_any_2, lambda n: contains(sql, n))) = 0
             THEN 'sql missing any of [''' || array_to_string(sql_contains_any_2, ''', ''') || ''']' END,
        CASE WHEN len(list_filter(answer_contains_any, lambda n: contains(lower(answer), lower(n)))) = 0
             THEN 'answer missing any of [''' || array_to_string(answer_contains_any, ''', ''') || ''']' END
    ], list_transform(
        list_filter(answer_must_not_contain, lambda n: contains(lower(answer || ' ' || sql), lower(n))),
        lambda n: 'forbidden token in output: ' || n)),
    [CASE WHEN select_only AND sql <> '' AND NOT regexp_matches(upper(sql), '^\\(*(SELECT|WITH)')
          THEN 'non-SELECT sql executed: ''' || substr(sql, 1, 60) || '''' END]) IF x IS NOT NULL] AS notes
    FROM fixtures f LEFT JOIN responses r ON r.id = f.id
),
scored AS (
    SELECT id, CASE WHEN NOT answered THEN 'error' WHEN len(notes) = 0 THEN 'pass' ELSE 'fail' END AS status,
           answered AND len(notes) = 0 AS ok,
           CASE WHEN answered THEN array_to_string(notes, '; ') ELSE '' END AS notes
    FROM checked
)"""


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """User turns as fixtures, the assistant turn that follows as the cached response."""
    t = Tables(spark, folder)
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.col("text")
    none = F.expr("CAST(array() AS array<string>)")

    def strings(*values):
        return F.array(*[F.lit(v) if isinstance(v, str) else v for v in values])

    fixtures = t.conversations.where("role = 'user'").select(
        F.concat_ws("-", conv.cast("string"), turn.cast("string")).alias("id"),
        F.struct(
            F.when(turn % 4 == 0, "select").alias("sql_starts_with"),
            F.when(conv % 5 == 0, F.lit(3)).cast("long").alias("row_count_eq"),
            F.when(conv % 2 == 0, F.lit(1)).cast("long").alias("row_count_min"),
            strings("count", "DELETE").alias("sql_contains_any"),
            F.when(conv % 7 == 0, strings("from", "FROM t")).alias("sql_contains_any_2"),
            strings(F.substring(text, 1, 3), "QUE ").alias("answer_contains_any"),
            F.when(turn == 0, strings("ENCH", "delete")).otherwise(none).alias("answer_must_not_contain"),
            (conv % 3 == 1).alias("sql_must_be_select_or_null"),
        ).alias("expect"),
    )
    responses = t.conversations.where("role = 'assistant'").select(
        F.concat_ws("-", conv.cast("string"), (turn - 1).cast("string")).alias("id"),
        text.alias("answer"),
        F.when(conv % 3 == 0, "((SELECT count(*) FROM t))").when(conv % 3 == 1, "DELETE FROM t").alias("sql"),
        F.when(conv % 6 != 0, F.length(text) % 5).alias("row_count"),
    )
    return score_responses(fixtures, responses)


@plan("score_responses", _SCORED_SQL + "\nSELECT * FROM scored")
def scored_responses(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).withColumn("notes", F.array_join("notes", "; "))


@plan("eval_tally", _SCORED_SQL + """
SELECT count(*) FILTER (WHERE status = 'pass') AS pass, count(*) FILTER (WHERE status = 'fail') AS fail,
       count(*) FILTER (WHERE status = 'error') AS error FROM scored
""")
def eval_tally(spark: SparkSession, folder: str) -> DataFrame:
    return tally(_scored(spark, folder))
