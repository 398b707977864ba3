"""Run history, embedding store and table sinks, written to scratch and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.keyword import TextIndex, match_rank
from lodestone.operators.relational import money
from lodestone.plans.registry import Tables, plan
from lodestone.plans.search import PASSAGES, keyword_sql
from lodestone.plans.standins import ASK, CORPUS_SQL, ITEMS_SQL, corpus, ops_items, ops_runs
from lodestone.session import scratch_path
from lodestone.sources.store import EmbeddingStore, RunHistory
from lodestone.sources.tables import export_by_fiscal_year, ingest, page_text, parquet_reader, register_tables


@plan("ingest_selected", """
SELECT c.c_custkey, c.c_name, c.c_acctbal, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
""")
def ingest_selected(spark: SparkSession, folder: str) -> DataFrame:
    target = scratch_path(spark, "ingest")
    written = ingest(parquet_reader(spark, folder), ["nation", "public.customer", "public.nation"], target)
    nation, customer = (spark.read.parquet(written[f"public.{n}"]) for n in ("nation", "customer"))
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_name", "c_acctbal", "n_name"
    )


def _history(spark: SparkSession, folder: str) -> tuple[RunHistory, DataFrame]:
    """Run history filled with the stand-in runs and their items."""
    t = Tables(spark, folder)
    runs = ops_runs(t)
    history = RunHistory(spark, scratch_path(spark, "history"))
    items = ops_items(t, runs)
    none = F.lit(None).cast("string")
    history.replace(
        runs.select(
            "run_id", "track", F.col("ran_at").cast("timestamp").alias("ran_at"),
            none.alias("source_path"), none.alias("notes"),
        ),
        {"ask_eval": items},
    )
    return history, items


@plan("append_run", f"""
WITH {ITEMS_SQL},
new_id AS (SELECT max(run_id) + 1 AS run_id FROM ops_runs),
runs AS (
    SELECT run_id, track, NULL AS notes FROM ops_runs
    UNION ALL SELECT run_id, 'ask_eval', 'again' FROM new_id
),
children AS (
    SELECT run_id, event_id, passed FROM ops_items
    UNION ALL SELECT (SELECT run_id FROM new_id), event_id, NOT passed FROM ops_items WHERE fixture_id = 'f1'
)
SELECT r.run_id, r.track, r.notes, count(*) AS items, count(*) FILTER (WHERE c.passed) AS passed
FROM runs r JOIN children c USING (run_id) GROUP BY r.run_id, r.track, r.notes
""")
def append_run(spark: SparkSession, folder: str) -> DataFrame:
    history, items = _history(spark, folder)
    again = items.where("fixture_id = 'f1'").select(
        "event_id", "fixture_id", (~F.col("passed")).alias("passed"), "dur_s"
    )
    history.append("ask_eval", "ask_eval", again, notes="again")
    return (
        history.table("ask_eval").groupBy("run_id")
        .agg(F.count("*").alias("items"), F.count_if("passed").alias("passed"))
        .join(history.runs(), "run_id")
        .select("run_id", "track", "notes", "items", "passed")
    )


@plan("cascade_delete", f"""
WITH {ITEMS_SQL}
SELECT r.track, i.run_id, i.event_id, i.fixture_id, i.passed
FROM ops_items i JOIN ops_runs r USING (run_id) WHERE r.track <> '{ASK}'
""")
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    history, _ = _history(spark, folder)
    history.delete(F.col("track") == ASK)
    # Joined from the children, a child left behind would show with a NULL track.
    return history.table("ask_eval").join(history.runs(), "run_id", "left").select(
        "track", "run_id", "event_id", "fixture_id", "passed"
    )


MERGED_SQL = f"""{CORPUS_SQL},
batch AS (
    SELECT d.source AS table_name, 'text' AS column_name, CAST(d.doc_id AS VARCHAR) AS row_id,
           concat('revised: ', d.text) AS content, e.embedding
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings)
    UNION ALL
    SELECT 'benchmark', 'text', CAST(item_id AS VARCHAR), text, NULL FROM benchmark
),
added AS (
    SELECT *, row_number() OVER (ORDER BY md5('42:' || k), k) + (SELECT max(id) FROM corpus) AS id FROM (
        SELECT *, table_name || chr(1) || column_name || chr(1) || row_id AS k FROM batch b
        WHERE NOT EXISTS (SELECT 1 FROM corpus c WHERE c.table_name = b.table_name
                          AND c.column_name = b.column_name AND c.row_id = b.row_id)
    )
),
merged AS (
    SELECT c.id, c.table_name, c.column_name, c.row_id,
           CASE WHEN b.row_id IS NULL THEN c.content ELSE b.content END AS content,
           CASE WHEN b.row_id IS NULL THEN c.embedding ELSE b.embedding END AS embedding
    FROM corpus c LEFT JOIN batch b USING (table_name, column_name, row_id)
    UNION ALL SELECT id, table_name, column_name, row_id, content, embedding FROM added
)"""


def _revisions(t: Tables) -> DataFrame:
    """A batch that revises the labelled documents and adds the benchmark passages."""
    known = (
        t.documents.join(t.labels, "doc_id", "left_semi")
        .join(t.embeddings, F.col("vec_id") == F.col("doc_id") % t.embeddings.count(), "left")
        .select(
            F.col("source").alias("table_name"), F.lit("text").alias("column_name"),
            F.col("doc_id").cast("string").alias("row_id"), F.concat(F.lit("revised: "), "text").alias("content"), "embedding",
        )
    )
    new = t.benchmark.select(
        F.lit("benchmark").alias("table_name"), F.lit("text").alias("column_name"),
        F.col("item_id").cast("string").alias("row_id"), F.col("text").alias("content"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )
    return known.unionByName(new)


@plan("upsert_embeddings", f"""
WITH {MERGED_SQL}
SELECT id, table_name, column_name, row_id, content, embedding[1]::DOUBLE AS first_value FROM merged
""")
def upsert_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    store = EmbeddingStore(spark, scratch_path(spark, "store"))
    store.replace(corpus(t))
    store.upsert(_revisions(t))
    return store.read().select(
        "id", "table_name", "column_name", "row_id", "content",
        F.get("embedding", F.lit(0)).cast("double").alias("first_value"),
    )


@plan("keyword_after_upsert", f"""
WITH {MERGED_SQL}, {keyword_sql(PASSAGES, "merged", 10)}
SELECT query_id, id, score, CAST(r AS BIGINT) AS rank FROM kw
""")
def keyword_after_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """The index follows an upsert by a segment of the batch; nothing is indexed anew."""
    t = Tables(spark, folder)
    store = EmbeddingStore(spark, scratch_path(spark, "store"))
    store.replace(corpus(t))
    path = f"{scratch_path(spark, 'index')}/text"
    TextIndex.write(store.read(), path, buckets=16, covers=store.state())
    store.upsert(_revisions(t))
    index = TextIndex.read(spark, path)
    index.append(store.changed_since(index.covers), covers=store.state())
    passages = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return match_rank(passages, TextIndex.read(spark, path, covers=store.state()), 10)


_FISCAL = "year(o_orderdate) + CASE WHEN month(o_orderdate) >= 10 THEN 1 ELSE 0 END"


@plan("export_fiscal_year", f"""
SELECT CAST({_FISCAL} AS BIGINT) AS fiscal_year, count(*) AS n,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders GROUP BY 1
""")
def export_fiscal_year(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{scratch_path(spark, 'export')}/orders"
    export_by_fiscal_year(Tables(spark, folder).orders, F.col("o_orderdate"), path)
    return (
        spark.read.parquet(path).groupBy(F.col("fiscal_year").cast("long").alias("fiscal_year"))
        .agg(F.count("*").alias("n"), F.sum(money(F.col("o_totalprice"))).cast("double").alias("total"))
    )


@plan("register_table", f"""
SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders WHERE {_FISCAL} = 1997 GROUP BY o_orderstatus
""")
def register_table(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{scratch_path(spark, 'register')}/orders"
    export_by_fiscal_year(Tables(spark, folder).orders, F.col("o_orderdate"), path)
    register_tables(spark, {"exported.orders": path})
    return spark.sql(
        "SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total "
        "FROM exported_orders WHERE fiscal_year = 1997 GROUP BY o_orderstatus"
    )


@plan("page_text_lookup", "SELECT url, substr(html, 1, 8000) AS page_text FROM pages")
def page_text_lookup(spark: SparkSession, folder: str) -> DataFrame:
    pages = Tables(spark, folder).pages
    return page_text(pages, pages)
