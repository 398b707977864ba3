"""Relational reports: projections, filters, joins, aggregates, windows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import words_of
from lodestone.operators.evaluation import recall
from lodestone.operators.relational import fk_check, in_fiscal_year, missing_keys, money
from lodestone.operators.sampling import eligible
from lodestone.operators.sql_access import bounded_query
from lodestone.plans.registry import TABLE_NAMES, Tables, plan


@plan("top_recipients", """
SELECT c.c_custkey, c.c_name, CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_amount
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE year(o.o_orderdate) + CASE WHEN month(o.o_orderdate) >= 10 THEN 1 ELSE 0 END = 1998
GROUP BY c.c_custkey, c.c_name ORDER BY total_amount DESC, c.c_custkey LIMIT 10
""")
def top_recipients(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    totals = (
        t.orders.where(in_fiscal_year(F.col("o_orderdate"), 1998))
        .groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(money(F.col("o_totalprice"))).alias("total"))
    )
    return (
        totals.join(t.customer.select("c_custkey", "c_name"), "c_custkey")
        .orderBy(F.col("total").desc(), "c_custkey").limit(10)
        .select("c_custkey", "c_name", F.col("total").cast("double").alias("total_amount"))
    )


@plan("top_counterparts", """
SELECT s.s_suppkey, s.s_name, count(*) AS contracts
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
JOIN supplier s ON l.l_suppkey = s.s_suppkey
WHERE n.n_name = 'NATION_7'
GROUP BY s.s_suppkey, s.s_name ORDER BY contracts DESC, s.s_suppkey LIMIT 10
""")
def top_counterparts(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    buyers = t.customer.join(t.nation.where("n_name = 'NATION_7'"), F.col("c_nationkey") == F.col("n_nationkey"))
    bought = t.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey")
    counts = (
        t.lineitem.select("l_orderkey", "l_suppkey")
        .join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("contracts"))
    )
    return (
        counts.join(t.supplier.select("s_suppkey", "s_name"), "s_suppkey")
        .orderBy(F.col("contracts").desc(), "s_suppkey").limit(10)
        .select("s_suppkey", "s_name", "contracts")
    )


@plan("project_cast", "SELECT CAST(doc_id AS VARCHAR) AS row_id, text AS content, lang FROM documents")
def project_cast(spark: SparkSession, folder: str) -> DataFrame:
    return Tables(spark, folder).documents.select(
        F.col("doc_id").cast("string").alias("row_id"), F.col("text").alias("content"), "lang"
    )


@plan("min_length_filter", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND length(text) >= 8")
def min_length_filter(spark: SparkSession, folder: str) -> DataFrame:
    return eligible(Tables(spark, folder).documents.select("doc_id", "text"), "text")


@plan("optional_filter", """
SELECT 'src3' AS asked, count(*) AS n FROM documents WHERE source = 'src3'
UNION ALL SELECT 'any' AS asked, count(*) AS n FROM documents
""")
def optional_filter(spark: SparkSession, folder: str) -> DataFrame:
    documents = Tables(spark, folder).documents

    def counted(source: str | None) -> DataFrame:
        rows = documents if source is None else documents.where(F.col("source") == source)
        return rows.agg(F.lit(source or "any").alias("asked"), F.count("*").alias("n"))

    return counted("src3").unionByName(counted(None))


@plan("ilike_count", "SELECT count(*) AS n FROM part WHERE p_name ILIKE '%WIDGET%'")
def ilike_count(spark: SparkSession, folder: str) -> DataFrame:
    return Tables(spark, folder).part.where(F.col("p_name").ilike("%WIDGET%")).agg(F.count("*").alias("n"))


@plan("regex_top5", """
SELECT s_name FROM supplier WHERE s_name IS NOT NULL AND regexp_matches(s_name, '^[A-Za-z].*[02468]$')
ORDER BY s_name LIMIT 5
""")
def regex_top5(spark: SparkSession, folder: str) -> DataFrame:
    name = F.col("s_name")
    return (
        Tables(spark, folder).supplier.where(name.isNotNull() & name.rlike("^[A-Za-z].*[02468]$"))
        .select("s_name").orderBy("s_name").limit(5)
    )


@plan("exclude_list", """
SELECT event_type, count(*) AS n FROM events WHERE event_type NOT IN ('error', 'view') GROUP BY event_type
""")
def exclude_list(spark: SparkSession, folder: str) -> DataFrame:
    return (
        Tables(spark, folder).events.where(~F.col("event_type").isin("error", "view"))
        .groupBy("event_type").agg(F.count("*").alias("n"))
    )


@plan("bound_params", """
SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice >= 100000 GROUP BY o_orderstatus
""")
def bound_params(spark: SparkSession, folder: str) -> DataFrame:
    Tables(spark, folder).orders.createOrReplaceTempView("bound_orders")
    return bounded_query(
        spark,
        "SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total "
        "FROM bound_orders WHERE o_orderpriority = ? AND o_totalprice >= ? GROUP BY o_orderstatus",
        args=["2-HIGH", 100000],
    ).frame


FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("documents", "doc_id", "embeddings", "vec_id"),
]


@plan("fk_check", " UNION ALL ".join(
    f"SELECT '{c}' AS child, '{col}' AS column_name, '{p}' AS parent, count(*) AS rows_total, "
    f"CAST(count(*) FILTER (WHERE {col} IS NOT NULL AND {col} NOT IN (SELECT {key} FROM {p})) AS BIGINT) AS orphans "
    f"FROM {c}"
    for c, col, p, key in FOREIGN_KEYS
))
def check_foreign_keys(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return fk_check({n: getattr(t, n) for n in TABLE_NAMES}, FOREIGN_KEYS)


@plan("count_rows", "SELECT count(*) AS row_count FROM lineitem")
def count_rows(spark: SparkSession, folder: str) -> DataFrame:
    return Tables(spark, folder).lineitem.agg(F.count("*").alias("row_count"))


@plan("distinct_top5", "SELECT DISTINCT p_name FROM part ORDER BY p_name LIMIT 5")
def distinct_top5(spark: SparkSession, folder: str) -> DataFrame:
    return Tables(spark, folder).part.select("p_name").distinct().orderBy("p_name").limit(5)


@plan("distinct_unnest", "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part")
def distinct_unnest(spark: SparkSession, folder: str) -> DataFrame:
    return Tables(spark, folder).part.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()


@plan("recall_at_k", """
WITH marked AS (
    SELECT CASE user_id % 3 WHEN 0 THEN 'vector' WHEN 1 THEN 'bm25' ELSE 'rrf' END AS strategy,
           event_type AS perturbation, value >= 10 AS hit FROM events
)
SELECT strategy, perturbation, hits, total, round(hits / greatest(total, 1), 6) AS recall FROM (
    SELECT strategy, perturbation, count(*) FILTER (WHERE hit) AS hits, count(*) AS total
    FROM marked GROUP BY strategy, perturbation
    UNION ALL
    SELECT strategy, '__overall__', count(*) FILTER (WHERE hit), count(*) FROM marked GROUP BY strategy
)
""")
def recall_at_k(spark: SparkSession, folder: str) -> DataFrame:
    user = F.col("user_id") % 3
    return recall(
        Tables(spark, folder).events.select(
            F.when(user == 0, "vector").when(user == 1, "bm25").otherwise("rrf").alias("strategy"),
            F.col("event_type").alias("perturbation"),
            (F.col("value") >= 10).alias("hit"),
        )
    )


@plan("row_number_limit", """
SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(r AS BIGINT) AS r FROM (
    SELECT l_orderkey, l_linenumber, l_extendedprice,
           row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem
) WHERE r <= 50
""")
def row_number_limit(spark: SparkSession, folder: str) -> DataFrame:
    # The filter on the rank turns the unpartitioned window into a top-n per task.
    w = Window.orderBy(F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey")
    return (
        Tables(spark, folder).lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
        .withColumn("r", F.row_number().over(w)).where(F.col("r") <= 50)
        .select("l_orderkey", "l_linenumber", "l_extendedprice", F.col("r").cast("long").alias("r"))
    )


@plan("top_k", """
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20
""")
def top_k(spark: SparkSession, folder: str) -> DataFrame:
    return (
        Tables(spark, folder).orders.select("o_orderkey", "o_totalprice")
        .orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20)
    )


@plan("missing_keys", """
SELECT doc_id FROM documents EXCEPT SELECT vec_id FROM embeddings
""")
def documents_without_vector(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return missing_keys(t.documents, "doc_id", t.embeddings, "vec_id")


@plan("scalar_mix", r"""
WITH w AS (
    SELECT doc_id, text, lang, source, n_chars,
           list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS words
    FROM documents
)
SELECT doc_id,
       CAST(length(text) AS BIGINT) AS n_text,
       length(text) >= 8 AS long_enough,
       lower(text) AS lowered,
       concat(source, '.', lang) AS qualified,
       array_to_string(words[2:], ' ') AS without_first,
       substr(text, 1, CAST(greatest(4, floor(length(text) / 2)) AS BIGINT)) AS half,
       CAST(CAST(doc_id AS VARCHAR) AS BIGINT) AS key_again,
       coalesce(nullif(lang, 'en'), 'none') AS other_lang,
       round(n_chars / nullif(len(words), 0), 4) AS chars_per_word,
       CASE WHEN n_chars > 2000 THEN 'long' WHEN n_chars > 500 THEN 'middle' ELSE 'short' END AS size_class
FROM w
""")
def scalar_mix(spark: SparkSession, folder: str) -> DataFrame:
    text, n = F.col("text"), F.length("text")
    words = Tables(spark, folder).documents.withColumn("words", words_of(text))
    return words.select(
        "doc_id",
        n.cast("long").alias("n_text"),
        (n >= 8).alias("long_enough"),
        F.lower(text).alias("lowered"),
        F.concat("source", F.lit("."), "lang").alias("qualified"),
        F.array_join(F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))), " ").alias("without_first"),
        F.substring(text, F.lit(1), F.greatest(F.lit(4), F.floor(n / 2).cast("int"))).alias("half"),
        F.col("doc_id").cast("string").cast("long").alias("key_again"),
        F.coalesce(F.nullif("lang", F.lit("en")), F.lit("none")).alias("other_lang"),
        F.round(F.col("n_chars") / F.nullif(F.size("words"), F.lit(0)), 4).alias("chars_per_word"),
        F.when(F.col("n_chars") > 2000, "long").when(F.col("n_chars") > 500, "middle").otherwise("short").alias("size_class"),
    )


@plan("json_props", """
SELECT event_id, coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS k,
       coalesce(json_extract_string(props, '$.absent'), 'unknown') AS absent
FROM events
""")
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    props = F.from_json("props", "k long, absent string")
    return Tables(spark, folder).events.select("event_id", props.alias("p")).select(
        "event_id",
        F.coalesce("p.k", F.lit(0)).cast("long").alias("k"),
        F.coalesce("p.absent", F.lit("unknown")).alias("absent"),
    )
