import datetime

import pytest
from pyspark.sql import functions as F

from lodestone.operators.relational import fiscal_year, fk_check, in_fiscal_year
from lodestone.operators.sampling import draw, first_n, numbered, random_n
from lodestone.operators.store_health import embedding_health, embedding_health_approx, validate_store
from lodestone.session import scratch_path, spread, stage
from lodestone.sources.store import STORE_SCHEMA, EmbeddingStore, RunHistory
from lodestone.sources.tables import (
    chosen_tables, distinct_entries, export_by_fiscal_year, ingest, page_text, parquet_reader, read_table, register_tables,
)

SF = "/root/testdata/sf0.001"
KEYED = "table_name string, column_name string, row_id string, content string, embedding array<float>"


def test_chosen_tables():
    assert chosen_tables(["agency", "rpt.x", "public.agency"]) == [("public", "agency"), ("rpt", "x")]
    assert chosen_tables([]) == [("public", "agency"), ("rpt", "recipient_lookup")]


def test_ingest(spark, tmp_path):
    written = ingest(parquet_reader(spark, SF), ["region", "public.nation", "region"], str(tmp_path))
    assert list(written) == ["public.region", "public.nation"]
    assert spark.read.parquet(written["public.nation"]).count() == 25


def test_distinct_entries(spark):
    e = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "p long, e string")
    assert sorted(tuple(r) for r in distinct_entries(e, "p", "e").collect()) == [("a", 1), ("b", 2)]


def test_fiscal_year(spark):
    days = [datetime.datetime(1997, 9, 30), datetime.datetime(1997, 10, 1), datetime.datetime(1998, 9, 30, 23), datetime.datetime(1998, 10, 1)]
    df = spark.createDataFrame([(d,) for d in days], "d timestamp_ntz")
    got = df.select(fiscal_year(F.col("d")).alias("y"), in_fiscal_year(F.col("d"), 1998).alias("i")).collect()
    assert [tuple(r) for r in got] == [(1997, False), (1998, True), (1998, True), (1999, False)]


def test_export_reads_one_partition(spark, tmp_path):
    orders = read_table(spark, SF, "orders")
    path = str(tmp_path / "orders")
    export_by_fiscal_year(orders, F.col("o_orderdate"), path)
    back = spark.read.parquet(path)
    assert back.count() == orders.count()
    one = back.where("fiscal_year = 1998")
    assert "PartitionFilters: [isnotnull(fiscal_year" in one._jdf.queryExecution().toString()
    assert one.count() == orders.where(in_fiscal_year(F.col("o_orderdate"), 1998)).count()


def test_register_views_and_tables(spark, tmp_path):
    path = str(tmp_path / "orders")
    export_by_fiscal_year(read_table(spark, SF, "orders"), F.col("o_orderdate"), path)
    register_tables(spark, {"pub.orders": path})
    register_tables(spark, {"orders_in_place": path}, catalog=True)
    try:
        views, tables = (spark.table(t).count() for t in ("pub_orders", "orders_in_place"))
        assert views == tables == 1500
    finally:
        spark.sql("DROP TABLE orders_in_place")


def test_page_text(spark):
    pages = spark.createDataFrame([("u", "x" * 9000), ("v", "y")], "url string, html string")
    wanted = spark.createDataFrame([("u",), ("w",)], "url string")
    assert {r.url: r.page_text for r in page_text(wanted, pages).collect()} == {"u": "x" * 8000, "w": None}


def keyed(spark, rows):
    return spark.createDataFrame([("t", "c", k, v, [float(len(v))]) for k, v in rows], KEYED)


def contents(store):
    rows = store.read().collect()
    found = {r.row_id: (r.id, r.content, r.embedding) for r in rows}
    assert len(found) == len(rows)
    return found


def test_upsert(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "store"))
    assert store.read().count() == 0
    store.upsert(keyed(spark, [("1", "one"), ("2", "two")]))
    first = contents(store)
    assert sorted(i for i, _, _ in first.values()) == [1, 2]
    batch = keyed(spark, [("2", "zwei"), ("3", "three"), ("4", "four")])
    store.upsert(batch)
    second = contents(store)
    assert second["1"] == first["1"]
    assert second["2"] == (first["2"][0], "zwei", [4.0])
    assert sorted(second[k][0] for k in "34") == [3, 4]
    store.upsert(batch)
    assert contents(store) == second
    store.compact()
    assert contents(store) == second
    store.upsert(keyed(spark, [("3", "drei"), ("5", "five")]))
    assert contents(store)["3"][:2] == (second["3"][0], "drei") and contents(store)["5"][0] == 5


def test_reading_one_table_of_the_store(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "store"))
    rows = [("2024", "c", "1", "number-like name", None), ("a.b", "c", "1", "dotted name", None)]
    store.upsert(spark.createDataFrame(rows, KEYED))
    one = store.read().where("table_name = '2024'")
    assert [(r.table_name, r.content) for r in one.collect()] == [("2024", "number-like name")]
    assert "PartitionFilters: [isnotnull(table_name" in one._jdf.queryExecution().toString()


def test_upserts_leave_the_base_alone(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "store"))
    for n in range(4):
        store.upsert(keyed(spark, [("same", f"v{n}"), (str(n), "x")]))
    found = contents(store)
    assert found["same"][1] == "v3" and sorted(i for i, _, _ in found.values()) == list(range(1, 6))
    assert store.state() == "1.3" and not (tmp_path / "store" / "v=2").exists()
    assert sorted((r.row_id, r.content) for r in store.changed_since("1.1").collect()) == [("2", "x"), ("3", "x"), ("same", "v3")]
    assert store.changed_since("1.3").collect() == []
    store.compact()
    assert store.state() == "2.0" and contents(store) == found
    with pytest.raises(ValueError, match="written anew"):
        store.changed_since("1.3")


def test_small_batch_does_not_shuffle_the_store(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "store"))
    store.upsert(keyed(spark, [(str(i), "text") for i in range(1000)]))
    store.upsert(keyed(spark, [("7", "new")]))
    rows = store.read()
    assert rows.count() == 1000
    assert "BroadcastHashJoin" in rows._jdf.queryExecution().toString()


def test_unfinished_batch_is_ignored(spark, tmp_path):
    path = tmp_path / "store"
    store = EmbeddingStore(spark, str(path))
    store.upsert(keyed(spark, [("1", "one")]))
    for lost in ("v=1/batch=1", "v=2/batch=0"):
        (path / lost).mkdir(parents=True)
        (path / lost / "part-0.parquet").write_text("cut short")
    assert contents(store).keys() == {"1"}
    store.upsert(keyed(spark, [("2", "two")]))
    assert contents(store).keys() == {"1", "2"}


def test_upsert_takes_the_last_row_of_a_key(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "s"))
    rows = [("t", "c", "1", "zzz first", [1.0], 1), ("t", "c", "1", "aaa last", [2.0], 2), ("t", "c", "2", "same", [3.0], 1),
            ("t", "c", "2", "same", [4.0], 2)]
    batch = spark.createDataFrame(rows, KEYED + ", at int")
    store.upsert(batch, order_by="at")
    assert {(r.row_id, r.content, r.embedding[0]) for r in store.read().collect()} == {("1", "aaa last", 2.0), ("2", "same", 4.0)}
    for unfit in (("t", "c", "3", None, [1.0], 1), ("t", None, "3", "x", [1.0], 1)):
        with pytest.raises(ValueError, match="key and content"):
            store.upsert(spark.createDataFrame([unfit], KEYED + ", at int"), order_by="at")
    store.compact()
    store.vacuum()
    assert store.read().count() == 2 and [p.name for p in (tmp_path / "s").glob("v=*")] == ["v=2"]


def test_run_history(spark, tmp_path):
    h = RunHistory(spark, str(tmp_path / "h"))
    rows = spark.createDataFrame([("f1", True), ("f2", False)], "fixture_id string, passed boolean")
    assert h.append("ask_eval", "ask_eval", rows, notes="1/2 pass") == 1
    assert h.append("ask_eval", "ask_eval", rows) == 2
    assert h.append("pytest", "pytest_runs", rows.selectExpr("fixture_id AS nodeid", "'passed' AS outcome")) == 3
    assert h.runs().count() == 3 and h.table("ask_eval").count() == 4
    assert h.table("endpoint_smoke") is None
    h.delete(F.col("run_id") == 1)
    assert sorted(r.run_id for r in h.runs().collect()) == [2, 3]
    assert {r.run_id for r in h.table("ask_eval").collect()} == {2}
    assert h.append("ask_eval", "ask_eval", rows) == 4
    assert {r.run_id for r in h.table("ask_eval").collect()} == {2, 4}
    # The newest run goes, and its id with it; nothing to load is no run.
    h.delete(F.col("run_id") == 4)
    assert h.append("ask_eval", "ask_eval", rows.where("false")) is None and h.runs().count() == 2
    assert h.append("ask_eval", "ask_eval", rows) == 5
    h.truncate()
    assert h.runs().count() == h.table("ask_eval").count() == h.table("pytest_runs").count() == 0
    assert h.append("ask_eval", "ask_eval", rows) == 1


def test_rows_of_a_lost_run_are_not_read(spark, tmp_path):
    h = RunHistory(spark, str(tmp_path / "h"))
    rows = spark.createDataFrame([("f1", True)], "fixture_id string, passed boolean")
    h.append("ask_eval", "ask_eval", rows)
    # A job that wrote its rows and was lost before it wrote its run.
    rows.selectExpr("2L AS run_id", "'lost' AS fixture_id", "passed").write.parquet(f"{h.path}/v=1/ask_eval/run-2")
    assert [r.fixture_id for r in h.table("ask_eval").collect()] == ["f1"]
    assert h.append("ask_eval", "ask_eval", rows) == 2
    assert [r.fixture_id for r in h.table("ask_eval").collect()] == ["f1", "f1"]


def test_numbered_is_a_dense_order(spark):
    df = spark.range(3000)
    got = numbered(df, "id").orderBy("position").collect()
    want = [r.id for r in df.orderBy(draw("id", 42), "id").collect()]
    assert [r.position for r in got] == list(range(1, 3001))
    assert [r.id for r in got] == want


def test_health(spark):
    rows = [(i, "t", "c" if i < 60 else "d", str(i % 99), f"text {i % 50}", [float(i % 10), 1.0]) for i in range(100)]
    rows.append((100, "t", "d", "100", "text", None))
    store = spark.createDataFrame(rows, STORE_SCHEMA)
    got = {r.column_name: tuple(r)[2:] for r in embedding_health(store).collect()}
    assert got == {"c": (60, 50, 10, 0.1667), "d": (41, 41, 10, 0.2439)}
    about = {r.column_name: r.distinct_contents for r in embedding_health_approx(store).collect()}
    assert about["c"] == pytest.approx(50, rel=0.1)
    assert validate_store(store, 2).first().asDict() == {
        "rows_total": 101, "null_vectors": 1, "wrong_dimension": 0, "duplicate_keys": 0,
    }
    assert validate_store(store, 3).first().wrong_dimension == 100
    assert validate_store(store.union(store.limit(3)), 2).first().duplicate_keys == 3


def test_fk_check_counts_orphans(spark):
    parent = spark.createDataFrame([(1,), (2,), (2,)], "k long")
    child = spark.createDataFrame([(1,), (1,), (3,), (3,), (None,)], "c long")
    got = fk_check({"p": parent, "c": child}, [("c", "c", "p", "k")]).first()
    assert (got.rows_total, got.orphans) == (5, 2)


@pytest.mark.parametrize("prefix", [1, 4])
def test_samples_put_only_a_few_rows_in_order(spark, prefix):
    keys = [*range(400), *[7] * 50, None, None]
    df = spark.createDataFrame([(k, f"text {k}") for k in keys], "id long, text string")
    for n in (0, 1, 2, 3, 57, 399, 451, 452, 600):
        want = sorted(r.text for r in df.orderBy(draw("id", 42), "id").limit(n).collect())
        got = random_n(df, "id", n, prefix=prefix)
        assert sorted(r.text for r in got.collect()) == want
        assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()
        want = sorted(r.text for r in df.orderBy("id").limit(n).collect())
        got = first_n(df, "id", n)
        assert sorted(r.text for r in got.collect()) == want
        assert "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


def test_fk_check_reads_a_child_once(spark):
    tables = {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("lineitem", "orders", "part", "supplier")}
    pairs = [("lineitem", f"l_{c}key", t, f"{c[0]}_{c}key") for c, t in (("order", "orders"), ("part", "part"), ("supp", "supplier"))]
    found = fk_check(tables, pairs)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("l_orderkey" in line and "Relation" in line for line in plan.splitlines()) == 1
    assert sorted((r.column_name, r.rows_total, r.orphans) for r in found.collect()) == [
        (c, tables["lineitem"].count(), 0) for c in ("l_orderkey", "l_partkey", "l_suppkey")
    ]
    odd = spark.createDataFrame([("1", 2.0), ("x", None), (None, 9.0)], "a string, b double")
    keys = spark.createDataFrame([(1,), (2,)], "k long")
    got = fk_check({"c": odd, "p": keys, "none": odd.where("false")}, [("c", "a", "p", "k"), ("c", "b", "p", "k"), ("none", "a", "p", "k")])
    assert sorted((r.child, r.column_name, r.rows_total, r.orphans) for r in got.collect()) == [("c", "a", 3, 1), ("c", "b", 3, 1), ("none", "a", 0, 0)]


def test_scratch_folder_comes_from_the_session():
    from types import SimpleNamespace

    from lodestone.session import _base_dir

    def session(master, **conf):
        context = SimpleNamespace(master=master, applicationId=f"app-{master}")
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf.get(k, d)), sparkContext=context)

    assert _base_dir(session("yarn", **{"spark.checkpoint.dir": "hdfs://shared/scratch/"})) == "hdfs://shared/scratch"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _base_dir(session("yarn"))
    assert _base_dir(session("local[2]")) == _base_dir(session("local[2]"))


def test_scratch_and_stage(spark):
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    staged = stage(spark.range(10).withColumn("s", F.lit("a")))
    assert staged.count() == 10 and "FileScan parquet" in staged._jdf.queryExecution().toString()


def test_spread_leaves_large_inputs_alone(spark, monkeypatch):
    import lodestone.session as session

    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert spread(df, "doc_id").count() == df.count()
    monkeypatch.setattr(session, "SMALL_INPUT_PER_CORE", 1)
    assert spread(df, "doc_id") is df
