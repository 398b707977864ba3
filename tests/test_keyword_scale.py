"""What keyword search and the lexicon shuffle and look up, and that the ways for large inputs give the same."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.functions.text import analyze, analyze_placed, term_counts, term_positions, with_terms
from lodestone.operators import keyword, lexicon
from lodestone.operators.keyword import TextIndex, match_rank
from tests.test_keyword import brute, collected

ROWS = [(1, "b a b"), (2, ""), (3, "the Été, 42 été the b"), (4, "dogs dog the dogs"), (5, "...")]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, content string").coalesce(1)


@pytest.mark.parametrize("language", ["simple", "unstemmed", "english"])
def test_terms_of_many_rows_equal_those_inside_the_row(rows, monkeypatch, language):
    monkeypatch.setattr(text, "_TOKENS_AT_ONCE", 4)
    for positions, words_of, terms_of in ((False, analyze, term_counts), (True, analyze_placed, term_positions)):
        words = words_of(F.col("content"), language)
        want = rows.select("id", F.size(words).alias("n_tokens"), terms_of(words).alias("terms"))
        got = with_terms(rows, "content", language, positions)
        assert got.schema == want.schema and sorted(got.collect()) == sorted(want.collect())


def test_rare_lexemes_are_joined_to_the_same_rows(spark, monkeypatch):
    """With hardly a lexeme broadcast, and hardly a key."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, range(60, 0, -1), k=rng.randint(1, 9)))) for i in range(120)]
    docs += [(500, docs[3][1]), (501, docs[3][1].upper()), (502, "w0")]
    for name, value in (("OFTEN", 3), ("FEW", 1), ("FIRST_ROWS", 4), ("BLOCK_ROWS", 1)):
        monkeypatch.setattr(keyword, name, value)
    table = spark.createDataFrame(docs, "id long, content string")
    got = collected(match_rank(table, table, 4, query_key="id", query_text="content"))
    want = brute(docs, docs, 4)
    assert {key: rank for key, (_, rank) in got.items()} == {key: rank for key, (_, rank) in want.items()}
    assert all(got[key][0] == pytest.approx(score, abs=2e-6) for key, (score, _) in want.items())


def test_a_row_with_just_the_lexemes_asked_for_is_not_looked_up_again(spark, monkeypatch):
    docs = spark.range(200).select("id", F.concat_ws(" ", F.lit("same"), F.concat(F.lit("u"), "id"), F.concat(F.lit("v"), "id")).alias("content"))
    seen = []
    real = keyword.stage

    def spy(df, label="staged"):
        staged = real(df, label)
        seen.append((label, staged))
        return staged

    monkeypatch.setattr(keyword, "stage", spy)
    assert match_rank(docs, docs, 3, query_key="id", query_text="content").where("query_id = id AND rank = 1").count() == 200
    assert sum(s.count() for label, s in seen if label == "part-lexemes") == 0
    assert {label for label, _ in seen} >= {"pairs", "part-lexemes"}
    # No hash of 32 bytes goes along with every lexeme.
    assert all("same" not in s.columns or "lexeme" not in s.columns for _, s in seen)


def test_repeated_and_null_ids_count_as_before(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a c"), (None, "a d"), (3, "a")], "id long, content string")
    got = match_rank(spark.createDataFrame([(0, "a")], "query_id long, query_text string"), docs, 9)
    assert sorted(r.id for r in got.collect()) == [2, 3]


def test_postings_of_an_index_carry_no_profile(spark, rows, tmp_path):
    TextIndex.write(rows.withColumn("table_name", F.lit("t")), str(tmp_path / "i"), buckets=2)
    assert not {"p1", "p2"} & set(TextIndex.read(spark, str(tmp_path / "i")).postings.columns)


def test_lexeme_postings_shuffle_no_words(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.createDataFrame(ROWS, "id long, content string").write.parquet(path)
    stored = spark.read.parquet(path)
    found = lexicon.lexeme_postings(stored, lexicon.lexicon(stored, rule="plural"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    got = {(r.id, r.lexeme): (r.tf, r.positions) for r in found.collect()}
    assert got[4, "dog"] == (3, [1, 2, 4]) and (4, "the") not in got


def test_a_lexicon_too_large_to_hand_out_gives_the_same(spark, rows, monkeypatch):
    words = lexicon.lexicon(rows, rule="plural")
    twice = rows.unionByName(rows.where("id = 1"))
    want = [sorted(map(str, lexicon.lexeme_postings(r, words).collect())) for r in (rows, twice)]
    asked = spark.createDataFrame([(1, "dog"), (2, "b a"), (3, "the")], "query_id long, query_text string")
    hits = sorted(map(str, match_rank(asked, rows, 3, lexemes=words).collect()))
    monkeypatch.setattr(lexicon, "HANDED", 0)
    assert want == [sorted(map(str, lexicon.lexeme_postings(r, words).collect())) for r in (rows, twice)]
    assert hits == sorted(map(str, match_rank(asked, rows, 3, lexemes=words).collect())) and len(hits) == 3


def test_words_are_cut_as_spark_cuts_them(spark):
    points = [*range(1, 0x2FF), 0x130, 0x3A3, 0x1E9E, 0x2160, 0x2CEF, 0x3007, 0x4E00, 0xFF21, 0x1D7CE, 0x1F600, 0x20000, 0x10FFFF]
    rng = random.Random(3)
    texts = ["", " ", "a", "...", "é", "x\U0001d7ce", *["".join(map(chr, rng.choices(points, k=rng.randint(1, 80)))) for _ in range(200)]]
    rows = spark.createDataFrame([*enumerate(texts)], "id long, content string").coalesce(2)
    words = analyze(F.col("content"))
    want = rows.select("id", F.size(words).alias("n_tokens"), term_positions(analyze_placed(F.col("content"))).alias("terms"))
    got = with_terms(rows, "content", positions=True)
    assert "regexp" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("k", [2, None])
def test_whole_rows_as_queries_are_not_put_together_from_postings(spark, monkeypatch, k):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, range(40, 0, -1), k=rng.randint(1, 7)))) for i in range(80)] + [(90, ""), (91, "w0"), (92, "w1 w0")]
    asked = [*docs, (200, "w0 nowhere"), (201, "W1, w0!"), (202, "w0 w0 w2")]
    monkeypatch.setattr(keyword, "OFTEN", 6)
    plans, real = {}, keyword.stage

    def spy(df, label="staged"):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return real(df, label)

    monkeypatch.setattr(keyword, "stage", spy)
    found = match_rank(spark.createDataFrame(asked, "query_id long, query_text string"), spark.createDataFrame(docs, "id long, content string"), k).collect()
    want = brute(asked, docs, k or 10_000)
    assert {(r.query_id, r.id) for r in found} == want.keys()
    assert all(r.score == pytest.approx(want[r.query_id, r.id][0], abs=2e-6) for r in found)
    # Lexemes are shuffled to count them and to look up the rare ones of rows that are all a query asks for, not for ways and comparison.
    assert "hashpartitioning(lexeme" in plans["frequencies"]
    assert all("hashpartitioning(lexeme" not in plans[x] for x in ("asked-ways", "ways"))
