"""Queries about the tables themselves, and bounded SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import relational
from lodestone.operators.sql_access import bounded_query, catalog_columns, digest_text, schema_digest
from lodestone.plans.registry import TABLE_NAMES, Tables, plan
from lodestone.plans.reports import FOREIGN_KEYS

# The columns of the given tables, as a SQL check needs them spelled out.
_COLUMNS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def _declared():
    for table, columns in _COLUMNS.items():
        for at, column in enumerate(columns.split(", "), 1):
            name, _, kind = column.partition(" ")
            yield table, at, name, kind


def _tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    t = Tables(spark, folder)
    return {name: getattr(t, name) for name in TABLE_NAMES}


@plan("table_inventory", """
SELECT * FROM (
""" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows_total FROM {t}" for t in TABLE_NAMES) + """
) ORDER BY rows_total DESC, table_name LIMIT 10
""")
def table_inventory(spark: SparkSession, folder: str) -> DataFrame:
    return relational.table_inventory(_tables(spark, folder))


@plan("table_bytes")
def table_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return relational.table_inventory(_tables(spark, folder), bytes_too=True)


@plan("schema_digest", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST({at} AS BIGINT) AS ordinal, '{name}' AS column_name, '{kind}' AS data_type, "
    f"count(*) AS rows_total, count(*) - count({name}) AS nulls FROM {t}"
    for t, at, name, kind in _declared()
))
def digest(spark: SparkSession, folder: str) -> DataFrame:
    return schema_digest(_tables(spark, folder))


def _line_sql(t: str, at: int, name: str, kind: str) -> str:
    return (
        f"SELECT '{t}' AS table_name, {at} AS ordinal, '- {name} {kind}' || "
        f"CASE WHEN count(*) > 0 AND count(*) = count({name}) THEN ' NOT NULL' ELSE '' END AS line FROM {t}"
    )


@plan("schema_digest_text", "WITH lines AS (" + " UNION ALL ".join(
    [_line_sql(*c) for c in _declared()]
    + [f"SELECT '{c}', 1000, '- FK {col} -> {p}.{key}'" for c, col, p, key in FOREIGN_KEYS]
) + """)
SELECT table_name, '## ' || table_name || chr(10) || string_agg(line, chr(10) ORDER BY ordinal, line) AS text
FROM lines GROUP BY table_name
""")
def digest_as_text(spark: SparkSession, folder: str) -> DataFrame:
    references = spark.createDataFrame(
        FOREIGN_KEYS, "child string, column_name string, parent string, parent_column string"
    )
    return digest_text(schema_digest(_tables(spark, folder)), references)


@plan("digest_column_count", "SELECT count(*) AS columns_in_digest, CAST(sum(n) AS BIGINT) AS cells FROM (" + " UNION ALL ".join(
    f"SELECT '{name}' AS c, count(*) AS n FROM {t}" for t, _, name, _ in _declared()
) + ")")
def digest_column_count(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of all tables, and the cells they hold; the rows of a table are read off its file footers."""
    return schema_digest(_tables(spark, folder), nulls=False).agg(
        F.count("*").alias("columns_in_digest"), F.sum("rows_total").alias("cells")
    )


@plan("list_columns", " UNION ALL ".join(
    f"SELECT '{name}' AS column_name, CAST({at} AS BIGINT) AS ordinal, '{kind}' AS data_type, count(*) AS rows_total FROM {t}"
    for t, at, name, kind in _declared() if t == "lineitem"
))
def list_columns(spark: SparkSession, folder: str) -> DataFrame:
    listed = schema_digest({"lineitem": Tables(spark, folder).lineitem}, nulls=False)
    return listed.select("column_name", "ordinal", "data_type", "rows_total").orderBy("ordinal")


@plan("digest_from_listing", "WITH lines AS (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {at} AS ordinal, '- {name} {kind}' || "
    f"CASE WHEN count(*) = count({name}) THEN ' NOT NULL' ELSE '' END AS line FROM {t}"
    for t, at, name, kind in _declared()
) + """)
SELECT 'public.' || table_name AS table_name,
       '## public.' || table_name || chr(10) || string_agg(line, chr(10) ORDER BY ordinal) AS text
FROM lines GROUP BY table_name
""")
def digest_from_listing(spark: SparkSession, folder: str) -> DataFrame:
    """The digest of a database's own listing, which says YES or NO to nulls; here as the tables' contents have it."""
    measured = schema_digest(_tables(spark, folder)).select(
        F.lit("public").alias("table_schema"), "table_name", "column_name", F.col("ordinal").alias("ordinal_position"),
        "data_type", F.when(F.col("nulls") == 0, "NO").otherwise("YES").alias("is_nullable"),
    )
    hidden = measured.withColumn("table_schema", F.lit("information_schema"))
    return digest_text(catalog_columns(measured.unionByName(hidden)))


_BOUNDED = """
WITH per_nation AS (
    SELECT c_nationkey, count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
    FROM {customer} GROUP BY c_nationkey
)
SELECT n_name, customers, balance FROM per_nation JOIN {nation} ON c_nationkey = n_nationkey
WHERE n_name ILIKE 'nation%' ORDER BY n_name LIMIT 1000
"""


@plan("bounded_query", _BOUNDED.format(customer="customer", nation="nation"))
def bounded(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    t.customer.createOrReplaceTempView("bounded_customer")
    t.nation.createOrReplaceTempView("bounded_nation")
    return bounded_query(spark, _BOUNDED.format(customer="bounded_customer", nation="bounded_nation") + ";").frame
