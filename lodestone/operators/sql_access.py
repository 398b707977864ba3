"""Bounded read-only SQL, and a digest of the tables it can reach."""

from __future__ import annotations

import json
import threading
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_LIMIT = 1000
TIMEOUT_SECONDS = 60.0

# Expressions that run code of the caller's choosing inside a SELECT.
_DENIED = ("CallMethodViaReflection", "TryReflect")
# Schemas of a database that its digest leaves out.
_EXCLUDED_SCHEMAS = ("pg_catalog", "information_schema", "ai")
# Queries are parsed one at a time, since parsing switches a setting of the shared session.
_parsing = threading.Lock()


class QueryRefused(ValueError):
    pass


class QueryTimedOut(RuntimeError):
    pass


@dataclass(frozen=True)
class BoundedResult:
    """A query's columns and at most ``cap`` rows; nothing runs until the rows are asked for."""

    frame: DataFrame

    @property
    def columns(self) -> list[str]:
        return self.frame.columns

    def fetch(self, timeout: float = TIMEOUT_SECONDS) -> dict:
        """Run the query; its jobs are cancelled once ``timeout`` seconds have passed."""
        context = self.frame.sparkSession.sparkContext
        group = f"bounded-{uuid.uuid4().hex}"
        late = threading.Event()

        def stop():
            late.set()
            context.cancelJobGroup(group)

        timer = threading.Timer(timeout, stop)
        context.setJobGroup(group, "bounded query", interruptOnCancel=True)
        timer.start()
        try:
            rows = [list(r) for r in self.frame.collect()]
        except Exception as e:
            if late.is_set():
                raise QueryTimedOut(f"cancelled after {timeout} s") from e
            raise
        finally:
            timer.cancel()
            context.setLocalProperty("spark.jobGroup.id", None)
        return {"columns": self.columns, "rows": rows, "row_count": len(rows)}


def _denied_in(node) -> str | None:
    """Look through Spark's own JSON form of an analyzed plan, subqueries included."""
    if isinstance(node, dict):
        name = str(node.get("class", "")).rsplit(".", 1)[-1]
        if name in _DENIED:
            return name
        node = list(node.values())
    if isinstance(node, list):
        return next((hit for child in node if (hit := _denied_in(child))), None)
    return None


def bounded_query(spark: SparkSession, sql: str, args=None, cap: int = ROW_LIMIT) -> BoundedResult:
    """Run one SELECT or WITH over registered tables and keep at most ``cap`` rows.

    The text is placed as a subquery, where a statement that changes anything, or a
    second statement, is a syntax error. Files cannot be named as tables, and
    functions that call into the JVM are refused.
    """
    text = sql.strip().rstrip(";").rstrip()
    by_path = "spark.sql.runSQLOnFiles"
    with _parsing:
        before = spark.conf.get(by_path, "true")
        spark.conf.set(by_path, "false")
        try:
            spark._jsparkSession.sessionState().sqlParser().parseQuery(text)
            frame = spark.sql(f"SELECT * FROM (\n{text}\n) LIMIT {int(cap)}", args=args)
            denied = _denied_in(json.loads(frame._jdf.queryExecution().analyzed().toJSON()))
        except Exception as e:
            raise QueryRefused(str(e)) from e
        finally:
            spark.conf.set(by_path, before)
    if denied:
        raise QueryRefused(f"{denied} is not allowed in a query")
    return BoundedResult(frame)


def schema_digest(
    tables: dict[str, DataFrame], nulls: bool = True, approx_distinct: bool = False
) -> DataFrame:
    """(table_name, ordinal, column_name, data_type, rows_total[, nulls][, distinct_approx]).

    One pass per table, every column counted at once. Parquet declares all columns
    nullable, so NOT NULL is what the data shows: ``nulls = 0``. Without counting nulls
    only the file footers are read. Tables are named ``schema.name`` or bare; those of
    excluded schemas are left out.
    """

    def one(name: str, df: DataFrame) -> DataFrame:
        fields = df.schema.fields
        total = F.count("*")
        measures: list[Column] = [total.alias("_rows")]
        rows = []
        for i, f in enumerate(fields):
            column = F.col(f"`{f.name}`")
            row = {
                "table_name": F.lit(name),
                "ordinal": F.lit(i + 1).cast("long"),
                "column_name": F.lit(f.name),
                "data_type": F.lit(f.dataType.simpleString()),
                "rows_total": F.col("_rows"),
            }
            if nulls:
                measures.append((total - F.count(column)).alias(f"_nulls{i}"))
                row["nulls"] = F.col(f"_nulls{i}")
            if approx_distinct:
                measures.append(F.approx_count_distinct(column).alias(f"_distinct{i}"))
                row["distinct_approx"] = F.col(f"_distinct{i}")
            rows.append(F.struct(*[value.alias(key) for key, value in row.items()]))
        return df.agg(*measures).select(F.inline(F.array(*rows)))

    chosen = {n: df for n, df in tables.items() if n.rpartition(".")[0] not in _EXCLUDED_SCHEMAS}
    return reduce(DataFrame.unionByName, [one(n, df) for n, df in sorted(chosen.items())])


def catalog_columns(columns: DataFrame, excluded=_EXCLUDED_SCHEMAS) -> DataFrame:
    """(table_name, ordinal, column_name, data_type, nullable) from a database's own listing.

    ``columns`` has table_schema, table_name, column_name, ordinal_position, data_type
    and is_nullable (YES or NO), as read over JDBC for instance.
    """
    return columns.where(~F.col("table_schema").isin(*excluded)).select(
        F.concat_ws(".", "table_schema", "table_name").alias("table_name"),
        F.col("ordinal_position").cast("long").alias("ordinal"),
        "column_name",
        "data_type",
        (F.col("is_nullable") == "YES").alias("nullable"),
    )


def catalog_references(
    constraints: DataFrame, key_columns: DataFrame, referenced: DataFrame, excluded=_EXCLUDED_SCHEMAS
) -> DataFrame:
    """(child, column_name, parent, parent_column) from a database's three listings of constraints."""
    of_constraint = ["constraint_name", "constraint_schema"]
    foreign = constraints.where(
        (F.col("constraint_type") == "FOREIGN KEY") & ~F.col("table_schema").isin(*excluded)
    ).select("constraint_name", F.col("table_schema").alias("constraint_schema"))
    child = key_columns.select(
        "constraint_name", F.col("table_schema").alias("constraint_schema"),
        F.concat_ws(".", "table_schema", "table_name").alias("child"), "column_name",
    )
    parent = referenced.select(
        "constraint_name", "constraint_schema",
        F.concat_ws(".", "table_schema", "table_name").alias("parent"), F.col("column_name").alias("parent_column"),
    )
    return foreign.join(child, of_constraint).join(parent, of_constraint).select(
        "child", "column_name", "parent", "parent_column"
    )


def digest_text(digest: DataFrame, references: DataFrame | None = None) -> DataFrame:
    """(table_name, text): each table's columns as lines, then its references.

    ``digest`` comes from ``schema_digest``, where NOT NULL is what the data shows, or
    from ``catalog_columns``; ``references`` holds child, column_name, parent and
    parent_column.
    """
    if "nullable" in digest.columns:
        not_null = ~F.col("nullable")
    else:
        not_null = (F.col("rows_total") > 0) & (F.col("nulls") == 0)
    line = F.concat(F.lit("- "), "column_name", F.lit(" "), "data_type", F.when(not_null, " NOT NULL").otherwise(""))
    lines = digest.select("table_name", F.lit(0).alias("part"), "ordinal", line.alias("line"))
    if references is not None:
        arrow = F.concat(F.lit("- FK "), "column_name", F.lit(" -> "), "parent", F.lit("."), "parent_column")
        lines = lines.unionByName(
            references.select(
                F.col("child").alias("table_name"), F.lit(1).alias("part"),
                F.lit(0).cast("long").alias("ordinal"), arrow.alias("line"),
            )
        )
    # A table with references but no columns is not in the digest.
    return (
        lines.groupBy("table_name")
        .agg(F.sort_array(F.collect_list(F.struct("part", "ordinal", "line"))).alias("l"))
        .where(F.col("l")[0]["part"] == 0)
        .select(
            "table_name",
            F.concat(F.lit("## "), "table_name", F.lit("\n"), F.array_join("l.line", "\n")).alias("text"),
        )
    )
