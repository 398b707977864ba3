"""The table of words and lexemes against word-by-word analysis, and sketches against exact counts."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import analyze, analyze_placed
from lodestone.operators import lexicon, store_health
from lodestone.operators.keyword import match_rank

TEXTS = [
    (1, "The running dogs were running after the Ponies"),
    (2, "a dog runs; generously, agencies AGENCY agency's"),
    (3, ""), (4, None), (5, "the of and"), (6, "été 漢字 ponies 42nd skies dying"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(TEXTS, "id long, content string").repartition(3)


@pytest.fixture(scope="module")
def english(rows):
    return lexicon.lexicon(rows).cache()


def test_english_lexemes_equal_those_found_word_by_word(spark, rows, english):
    got = {r.id: r.content for r in lexicon.lexeme_text(rows, english).collect()}
    words = F.array_join(analyze(F.coalesce("content", F.lit("")), "english"), " ")
    assert got == {r.id: r.t for r in rows.select("id", words.alias("t")).collect()}
    assert got[3] == got[4] == got[5] == ""


def test_documents_by_lexicon_equal_word_by_word(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    by_table = lexicon.lexeme_text(docs, lexicon.lexicon(docs)).withColumnRenamed("content", "t")
    by_word = docs.select("id", F.array_join(analyze(F.col("content"), "english"), " ").alias("w"))
    joined = by_table.join(by_word, "id")
    assert joined.count() == docs.count() and joined.where(~F.col("t").eqNullSafe(F.col("w"))).count() == 0


def test_each_word_is_listed_once_and_stop_words_have_no_lexeme(english):
    listed = {r.word: r.lexeme for r in english.collect()}
    assert english.count() == len(listed)
    assert listed["the"] is None and listed["running"] == "run" and listed["agencies"] == listed["agency"]


def test_postings_of_words_with_one_lexeme_are_one(rows, english):
    got = {(r.id, r.lexeme): (r.tf, r.positions) for r in lexicon.lexeme_postings(rows, english).collect()}
    want = {}
    for r in rows.select("id", F.explode(analyze_placed(F.col("content"), "english")).alias("t")).collect():
        want.setdefault((r.id, r.t.lexeme), []).append(r.t.pos)
    assert got == {k: (len(v), sorted(v)) for k, v in want.items()}
    assert got[1, "run"] == (2, [2, 5])


def test_extension_holds_only_what_is_new_and_stems_nothing_else(spark, rows, english, tmp_path):
    english.write.parquet(str(tmp_path / "l"))
    known = spark.read.parquet(str(tmp_path / "l"))
    later = spark.createDataFrame([("the dogs flying and running kites",), (None,)], "content string")
    added = {r.word: r.lexeme for r in lexicon.extend(known, later).collect()}
    assert added == {"flying": "fli", "kites": "kite"}
    assert lexicon.extend(known, rows).isEmpty()


def test_a_word_the_lexicon_lacks_is_its_own_lexeme(spark, rows, english):
    got = lexicon.lexeme_text(rows.where("id = 1"), english.where("word <> 'ponies'")).first()
    assert got.content == "run dog run ponies"


@pytest.mark.parametrize("word, lexeme", [
    ("queries", "query"), ("zombaies", "zombaies"), ("boxes", "boxe"), ("trees", "trees"), ("shoes", "shoes"),
    ("cats", "cat"), ("bus", "bus"), ("glass", "glass"), ("s", "s"), ("cat", "cat"),
])
def test_plural_rule(spark, word, lexeme):
    assert spark.range(1).select(lexicon.plural(F.lit(word))).first()[0] == lexeme


def test_search_by_lexeme_finds_other_forms(spark, rows, english):
    asked = spark.createDataFrame([(1, "the pony dog"), (2, "agencies")], "query_id long, query_text string")
    hits = match_rank(lexicon.lexeme_text(asked, english, "query_id", "query_text"), lexicon.lexeme_text(rows, english), 5)
    assert {(r.query_id, r.id) for r in hits.collect()} == {(2, 2)}
    english_too = english.unionByName(lexicon.extend(english, asked, "query_text"))
    hits = match_rank(lexicon.lexeme_text(asked, english_too, "query_id", "query_text"), lexicon.lexeme_text(rows, english_too), 5)
    assert {(r.query_id, r.id) for r in hits.collect()} == {(1, 1), (2, 2)}


@pytest.mark.parametrize("ranking", ["bm25", "ts_rank"])
def test_search_by_lexicon_equals_search_by_stems(spark, ranking):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    docs = read("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    # Short queries from the documents themselves, and one of no known word.
    asked = docs.select(F.col("id").alias("query_id"), F.array_join(F.slice(analyze("content"), 3, 4), " ").alias("query_text"))
    asked = asked.unionByName(spark.createDataFrame([(-1, "qqqqzz the"), (-2, "the of"), (-3, None)], asked.schema))
    words = lexicon.lexicon(docs)
    got = match_rank(asked, docs, 5, ranking=ranking, lexemes=words)
    want = match_rank(asked, docs, 5, ranking=ranking, language="english")
    assert got.count() > 50 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))


def test_an_empty_table_has_no_words_and_an_unknown_rule_is_refused(rows):
    none = rows.where("false")
    words = lexicon.lexicon(none)
    assert words.collect() == [] and lexicon.lexeme_text(none, words).collect() == []
    with pytest.raises(ValueError, match="unknown rule"):
        lexicon.lexicon(none, rule="klingon")


def test_sketches_of_batches_merge_within_the_bound(spark, tmp_path):
    def batch(low, high):
        return spark.range(low, high).select(
            F.lit("t").alias("table_name"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("column_name"),
            (F.col("id") % 90_000).cast("string").alias("content"),
            F.when(F.col("id") % 2 == 0, F.array((F.col("id") % 1000).cast("float"))).alias("embedding"),
        )

    path = str(tmp_path / "sketches")
    for i in range(3):
        store_health.keep_sketches(batch(i * 60_000, (i + 1) * 60_000), path, i)
    # Written again, a batch counts once.
    store_health.keep_sketches(batch(0, 60_000), path, 0)
    estimated = store_health.sketched_health(spark.read.parquet(path))
    checked = store_health.check_sketches(estimated, store_health.embedding_health(batch(0, 180_000))).collect()
    assert len(checked) == 2 and all(r.distinct_contents_within and r.distinct_embeddings_within for r in checked)
    assert {r.column_name: r.distinct_contents for r in checked} == {"a": 30_000, "b": 60_000}
    assert sum(r.rows_written for r in estimated.collect()) == 180_000


def test_sketch_of_a_column_without_vectors(spark):
    rows = spark.createDataFrame([("t", "c", "x", None)], "table_name string, column_name string, content string, embedding array<float>")
    got = store_health.sketched_health(store_health.health_sketches(rows)).first()
    assert (got.distinct_contents, got.distinct_embeddings, got.distinct_ratio) == (1, 0, 0)
