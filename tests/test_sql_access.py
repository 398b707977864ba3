import pytest

from lodestone.operators.sql_access import (
    QueryRefused, QueryTimedOut, bounded_query, catalog_columns, catalog_references, digest_text, schema_digest,
)

REFERENCES = "child string, column_name string, parent string, parent_column string"


@pytest.fixture(scope="module")
def numbers(spark):
    spark.range(2500).createOrReplaceTempView("numbers")


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT count(*) AS n FROM numbers LIMIT 1;",
        "WITH x AS (SELECT id FROM numbers) SELECT count(*) AS n FROM x -- remark",
        "(SELECT count(*) AS n FROM numbers)",
        "SELECT count(*) AS n FROM numbers WHERE cast(id AS string) NOT ILIKE '%reflect%'",
    ],
)
def test_queries_run(spark, numbers, sql):
    assert bounded_query(spark, sql).fetch() == {"columns": ["n"], "rows": [[2500]], "row_count": 1}


def test_rows_are_capped(spark, numbers):
    assert bounded_query(spark, "SELECT id FROM numbers").fetch()["row_count"] == 1000
    assert bounded_query(spark, "SELECT id FROM numbers", cap=7).fetch()["row_count"] == 7


def test_parameters(spark, numbers):
    got = bounded_query(spark, "SELECT count(*) FROM numbers WHERE id < ? AND id >= ?", args=[10, 4]).fetch()
    assert got["rows"] == [[6]]
    got = bounded_query(spark, "SELECT count(*) FROM numbers WHERE id < :top", args={"top": 3}).fetch()
    assert got["rows"] == [[3]]


@pytest.mark.parametrize(
    "sql",
    [
        "DROP VIEW numbers", "CREATE TABLE t (a int)", "INSERT INTO numbers VALUES (1)", "DELETE FROM numbers",
        "SELECT 1; SELECT 2", "SELECT 1; DROP VIEW numbers", "SELECT 1) LIMIT 5; DROP VIEW numbers; SELECT (1",
        "WITH x AS (SELECT 1 AS a) INSERT INTO numbers SELECT a FROM x", "SET spark.sql.shuffle.partitions=1",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
        "SELECT java_method('java.lang.System', 'getProperty', 'user.home')",
        "SELECT * FROM (SELECT (SELECT try_reflect('java.lang.System', 'getProperty', 'x')) AS a)",
        "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`",
        "SELECT * FROM no_such_table", "", "EXPLAIN SELECT 1", "SHOW TABLES",
    ],
)
def test_anything_else_is_refused(spark, numbers, sql):
    with pytest.raises(QueryRefused):
        bounded_query(spark, sql)
    assert spark.table("numbers").count() == 2500
    assert spark.conf.get("spark.sql.runSQLOnFiles") == "true"


def test_digest_measures_not_null(spark):
    t = spark.createDataFrame([(1, "a", [1.0]), (2, None, None)], "k long, name string, v array<float>")
    tables = {"pub.t": t, "a": t.select("k").where("false"), "information_schema.columns": t}
    rows = {(r.table_name, r.column_name): r for r in schema_digest(tables, approx_distinct=True).collect()}
    assert {name for name, _ in rows} == {"pub.t", "a"}
    assert rows["pub.t", "name"].nulls == 1 and rows["pub.t", "k"].nulls == 0
    assert rows["pub.t", "k"].distinct_approx == 2
    references = spark.createDataFrame([("pub.t", "k", "a", "k"), ("lost", "x", "a", "k")], REFERENCES)
    text = {r.table_name: r.text for r in digest_text(schema_digest(tables), references).collect()}
    assert text.keys() == {"pub.t", "a"}
    assert text["pub.t"] == "## pub.t\n- k bigint NOT NULL\n- name string\n- v array<float>\n- FK k -> a.k"
    assert text["a"] == "## a\n- k bigint"


def test_digest_from_a_database_listing(spark):
    columns = spark.createDataFrame(
        [
            ("public", "agency", "id", 1, "integer", "NO"), ("public", "agency", "created", 2, "date", "YES"),
            ("public", "office", "agency_id", 1, "integer", "YES"), ("pg_catalog", "pg_class", "oid", 1, "oid", "NO"),
        ],
        "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string",
    )
    constraints = spark.createDataFrame(
        [("fk_office", "public", "FOREIGN KEY"), ("pk_agency", "public", "PRIMARY KEY"), ("fk_office", "ai", "FOREIGN KEY")],
        "constraint_name string, table_schema string, constraint_type string",
    )
    keys = spark.createDataFrame(
        [("fk_office", "public", "office", "agency_id"), ("pk_agency", "public", "agency", "id"), ("fk_office", "ai", "x", "y")],
        "constraint_name string, table_schema string, table_name string, column_name string",
    )
    referenced = spark.createDataFrame(
        [("fk_office", "public", "public", "agency", "id"), ("fk_office", "ai", "ai", "z", "id")],
        "constraint_name string, constraint_schema string, table_schema string, table_name string, column_name string",
    )
    text = digest_text(catalog_columns(columns), catalog_references(constraints, keys, referenced))
    assert {r.table_name: r.text for r in text.collect()} == {
        "public.agency": "## public.agency\n- id integer NOT NULL\n- created date",
        "public.office": "## public.office\n- agency_id integer\n- FK agency_id -> public.agency.id",
    }


def test_slow_query_is_cancelled(spark):
    slow = "SELECT max(hash(a.id, b.id)) FROM range(2000000) a JOIN range(2000000) b ON a.id <> b.id"
    with pytest.raises(QueryTimedOut):
        bounded_query(spark, slow).fetch(timeout=2)
    assert bounded_query(spark, "SELECT 1 AS one").fetch()["rows"] == [[1]]
