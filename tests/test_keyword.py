import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions.stemmer import stem
from lodestone.functions.text import analyze, analyze_placed, term_counts, term_positions
from lodestone.operators import keyword
from lodestone.operators.keyword import TextIndex, document_frequencies, match_rank, postings


def brute(queries, corpus, k):
    docs = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in corpus if t is not None}
    n = len(docs)
    mean = sum(map(len, docs.values())) / n
    df = Counter(w for ws in docs.values() for w in set(ws))
    out = {}
    for qid, text in queries:
        terms = set(re.findall(r"[^\W_]+", (text or "").lower()))
        scored = []
        for i, ws in docs.items():
            tf = Counter(ws)
            if terms and all(tf[t] for t in terms):
                s = sum(
                    math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2
                    / (tf[t] + 1.2 * (0.25 + 0.75 * len(ws) / mean))
                    for t in terms
                )
                scored.append((-round(s, 6), i))
        for rank, (s, i) in enumerate(sorted(scored)[:k], 1):
            out[qid, i] = (-s, rank)
    return out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    corpus = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(150)]
    # A third of the rows are copies, some empty, some odd.
    corpus += [(1000 + i, "Beta, GAMMA: beta!") for i in range(80)]
    corpus += [(2000, ""), (2001, "  ...  "), (2002, "été 42 Été"), (2003, None)]
    queries = [(i, " ".join(rng.choices(words, k=rng.randint(1, 3)))) for i in range(40)]
    queries += [(100 + i, "gamma beta") for i in range(20)]
    queries += [(200, ""), (201, "--"), (202, "alpha nowhere"), (203, "42 été"), (204, "beta beta beta"), (205, None)]
    return queries, corpus


def frames(spark, data):
    queries, corpus = data
    return (
        spark.createDataFrame(queries, "query_id long, query_text string"),
        spark.createDataFrame([(i, "t", t) for i, t in corpus], "id long, table_name string, content string"),
    )


def collected(df):
    return {(r.query_id, r.id): (r.score, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("k", [1, 7, 200])
def test_equals_brute_force(spark, data, k):
    q, c = frames(spark, data)
    got, want = collected(match_rank(q, c, k)), brute(*data, k)
    assert got.keys() == want.keys()
    assert all(got[x][1] == want[x][1] and got[x][0] == pytest.approx(want[x][0], abs=2e-6) for x in want)


@pytest.mark.parametrize("ranking", ["bm25", "ts_rank"])
def test_blocks_left_out_change_nothing(spark, data, monkeypatch, ranking):
    q, c = frames(spark, data)
    want = collected(match_rank(q, c, 3, ranking=ranking))
    for name, value in (("FIRST_ROWS", 2), ("BLOCK_ROWS", 1), ("LENGTH_CLASSES", 4)):
        monkeypatch.setattr(keyword, name, value)
    assert collected(match_rank(q, c, 3, ranking=ranking)) == want


def test_all_matches(spark, data):
    q, c = frames(spark, data)
    got = {(r.query_id, r.id) for r in match_rank(q, c, None).collect()}
    assert got == set(brute(*data, 10_000))


def test_index_gives_the_same(spark, data, tmp_path):
    q, c = frames(spark, data)
    path = str(tmp_path / "index")
    TextIndex.write(c, path, buckets=4)
    index = TextIndex.read(spark, path)
    assert collected(match_rank(q, index, 5)) == collected(match_rank(q, c, 5))
    assert match_rank(q, index, 5, table_name="other").count() == 0


@pytest.mark.parametrize("ranking", ["bm25", "ts_rank"])
def test_few_queries(spark, data, tmp_path, ranking):
    q, c = frames(spark, data)
    path = str(tmp_path / "index")
    TextIndex.write(c, path, buckets=4)
    want = collected(match_rank(q, c, 5, ranking=ranking))
    for source in (c, TextIndex.read(spark, path)):
        got = {}
        for ids in [(0, 1, 2, 3), (200, 201, 205), (202,), (203, 204)]:
            got.update(collected(match_rank(q.where(F.col("query_id").isin(*ids)), source, 5, ranking=ranking)))
        assert got == {key: hit for key, hit in want.items() if key[0] in (0, 1, 2, 3, 203, 204)}
    one = q.where("query_id = 0")
    assert match_rank(one, c, None).count() == sum(key[0] == 0 for key in brute(*data, 10_000))


def test_index_of_several_tables(spark, data, tmp_path):
    q, c = frames(spark, data)
    two = c.withColumn("table_name", F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    path = str(tmp_path / "index")
    TextIndex.write(two, path, buckets=4)
    index = TextIndex.read(spark, path)
    for name in ("even", "odd"):
        assert collected(match_rank(q, index, 5, table_name=name)) == collected(match_rank(q, two, 5, table_name=name))


def test_hot_rows_stay_one_row_each(spark):
    """Copies on both sides do not multiply: 300 equal queries on 300 equal rows."""
    q = spark.range(300).select(F.col("id").alias("query_id"), F.lit("same words here").alias("query_text"))
    c = spark.range(300).select("id", F.lit("here are the same words").alias("content"))
    got = match_rank(q, c, 3).groupBy("id").count().orderBy("id").collect()
    assert [(r.id, r["count"]) for r in got] == [(0, 300), (1, 300), (2, 300)]


def test_many_queries_on_one_common_lexeme(spark, monkeypatch):
    """The rows scored are bounded by the blocks, not by queries times rows; with blocks as small as the table is."""
    monkeypatch.setattr(keyword, "FIRST_ROWS", 32)
    monkeypatch.setattr(keyword, "BLOCK_ROWS", 16)
    rows = spark.range(3000).select(
        "id", F.concat_ws(" ", F.lit("common"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.concat(
            F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(40)).cast("string"))), " "),
            F.repeat(F.lit(" filler"), (F.col("id") % 90).cast("int"))).alias("content"),
    )
    queries = spark.range(1000).select(F.col("id").alias("query_id"), F.concat(
        F.lit("common w"), (F.col("id") % 40).cast("string"), F.lit(" w"), (F.floor(F.col("id") / 40)).cast("string")).alias("query_text"))
    sets = keyword._query_sets(queries, "query_id", "query_text", "simple").dropDuplicates(["set_id"])
    wanted = sets.select("set_id", F.size("lexemes").alias("n"), F.explode("lexemes").alias("lexeme"))
    posts, own = keyword._asked_of(rows, wanted.select("lexeme").distinct(), "id", "content", "simple", False)
    batch = keyword._Batch(wanted, posts, own, 5, False)
    blocks = keyword.stage(batch.blocks())
    every = batch.pairs(blocks).count()
    first = keyword.stage(batch.scored(batch.pairs(blocks.where("first"))))
    looked_at = batch.pairs(blocks.where("first")).count() + batch.pairs(batch.left(blocks, first)).count()
    assert looked_at < every / 2 and every < 3000 * batch.asked.count() / 5
    some = queries.where("query_id % 37 = 0")
    got = collected(match_rank(some, rows, 5))
    want = brute([tuple(r) for r in some.collect()], [tuple(r) for r in rows.collect()], 5)
    assert {key: rank for key, (_, rank) in got.items()} == {key: rank for key, (_, rank) in want.items()}


def test_index_follows_its_store(spark, data, tmp_path):
    q, c = frames(spark, data)
    path = str(tmp_path / "index")
    TextIndex.write(c, path, buckets=4, covers="1.0")
    with pytest.raises(ValueError, match="covers 1.0"):
        TextIndex.read(spark, path, covers="1.1")
    texts = dict(data[1])
    for step, change in enumerate([{3: "alpha beta", 1000: None, 5000: "gamma gamma delta"}, {3: "zeta", 5000: None, 5001: "eta alpha"}, {}], 1):
        texts.update(change)
        batch = spark.createDataFrame([(i, "t", t) for i, t in change.items()], "id long, table_name string, content string")
        index = TextIndex.read(spark, path).append(batch, covers=f"1.{step}")
        fresh = [(i, t) for i, t in texts.items()]
        want = brute(data[0], fresh, 5)
        for version in (index, index.merge()) if step == 2 else (index,):
            assert version.covers == f"1.{step}" and version.size(None)[0] == sum(t is not None for t in texts.values())
            got = collected(match_rank(q, TextIndex.read(spark, path, covers=f"1.{step}"), 5))
            assert {key: rank for key, (_, rank) in got.items()} == {key: rank for key, (_, rank) in want.items()}
            assert all(got[key][0] == pytest.approx(score, abs=2e-6) for key, (score, _) in want.items())
    assert len(index.segments) == 2  # the merged one and the one after it
    with pytest.raises(ValueError, match="no index"):
        TextIndex.read(spark, str(tmp_path / "none")).append(c)


def test_empty_corpus(spark, data):
    q, c = frames(spark, data)
    assert match_rank(q, c.where("false"), 5).count() == 0


def test_english_analysis(spark):
    rows = spark.createDataFrame([(0, "The running of the UNIVERSITIES, and their grants")], "id long, content string")
    words = rows.select(analyze(F.col("content"), "english").alias("w")).first().w
    assert words == ["run", "univers", "grant"]
    q = spark.createDataFrame([(1, "university grant"), (2, "the of"), (3, "ran")], "query_id long, query_text string")
    got = match_rank(q, rows, 5, language="english").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, 0)]


def test_terms_inside_the_row(spark):
    df = spark.createDataFrame([("b a b",), ("",), ("x",)], "t string").select(
        term_counts(analyze(F.col("t"))).alias("c"), term_positions(analyze_placed(F.col("t"))).alias("p")
    )
    got = [([tuple(x) for x in r.c], [(x.lexeme, x.positions) for x in r.p]) for r in df.collect()]
    assert got == [
        ([("a", 1), ("b", 2)], [("a", [2]), ("b", [1, 3])]), ([], []), ([("x", 1)], [("x", [1])]),
    ]


def test_stop_words_take_up_a_place(spark):
    df = spark.createDataFrame([("The grants of the universities",)], "t string")
    got = df.select(analyze_placed(F.col("t"), "english").alias("p")).first().p
    assert [(x.lexeme, x.pos) for x in got] == [("grant", 2), ("univers", 5)]


@pytest.mark.parametrize(
    ("content", "query", "score"),
    [
        # Known ranks of the text-search functions this stands in for.
        ("a", "a", 0.060793), ("a a", "a", 0.075991), ("a b", "a b", 0.099103), ("a x b", "a b", 0.098500),
    ],
)
def test_ts_rank(spark, content, query, score):
    c = spark.createDataFrame([(1, content)], "id long, content string")
    q = spark.createDataFrame([(1, query)], "query_id long, query_text string")
    assert match_rank(q, c, 5, ranking="ts_rank").first().score == pytest.approx(score, abs=2e-6)


def test_ts_rank_prefers_close_words(spark, tmp_path):
    texts = ["red one two three blue", "red blue", "blue red red", "red", "blue " + "x " * 200 + "red"]
    c = spark.createDataFrame([(i, "t", t) for i, t in enumerate(texts)], "id long, table_name string, content string")
    q = spark.createDataFrame([(1, "Red Blue")], "query_id long, query_text string")
    path = str(tmp_path / "index")
    TextIndex.write(c, path, buckets=2)
    for source in (c, TextIndex.read(spark, path)):
        hits = match_rank(q, source, 5, ranking="ts_rank").orderBy("rank").collect()
        assert [h.id for h in hits] == [2, 1, 0, 4]


def test_postings_and_frequencies(spark):
    c = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, "")], "id long, content string")
    got = {(r.lexeme, r.id): (r.tf, r.n_tokens, r.positions) for r in postings(c).collect()}
    assert got == {("a", 1): (2, 3, [1, 3]), ("b", 1): (1, 3, [2]), ("b", 2): (1, 1, [1])}
    df = {r.lexeme: (r.df, r.total_tf) for r in document_frequencies(c, "id", "content").collect()}
    assert df == {"a": (1, 2), "b": (2, 2)}


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("consigned", "consign"), ("consignment", "consign"), ("consistency", "consist"), ("consolatory", "consolatori"),
        ("knightly", "knight"), ("knives", "knive"), ("knocked", "knock"), ("kneeled", "kneel"),
        ("generously", "generous"), ("generate", "generat"), ("hopping", "hop"), ("hoping", "hope"),
        ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("gaps", "gap"), ("kiwis", "kiwi"), ("dying", "die"),
        ("by", "by"), ("say", "say"), ("cry", "cri"), ("happiness", "happi"), ("universities", "univers"),
        ("luxuriated", "luxuri"), ("news", "news"), ("proceed", "proceed"), ("relational", "relat"),
        ("electricity", "electr"), ("apologies", "apolog"), ("été", "été"), ("x1", "x1"),
    ],
)
def test_stem(word, want):
    assert stem(word) == want


# The sample vocabulary published with the stemming algorithm, and its stems.
SAMPLE = """
consign consigned consigning consignment consist consisted consistency consistent consistently consisting consists
consolation consolations consolatory console consoled consoles consolidate consolidated consolidating consoling
consolingly consols consonant consort consorted consorting conspicuous conspicuously conspiracy conspirator
conspirators conspire conspired conspiring constable constables constance constancy constant
knack knackeries knacks knag knave knaves knavish kneaded kneading knee kneel kneeled kneeling kneels knees knell
knelt knew knick knif knife knight knightly knights knit knits knitted knitting knives knob knobs knock knocked
knocker knockers knocking knocks knopp knot knots
"""
STEMS = """
consign consign consign consign consist consist consist consist consist consist consist
consol consol consolatori consol consol consol consolid consolid consolid consol
consol consol conson consort consort consort conspicu conspicu conspiraci conspir
conspir conspir conspir conspir constabl constabl constanc constanc constant
knack knackeri knack knag knave knave knavish knead knead knee kneel kneel kneel kneel knee knell
knelt knew knick knif knife knight knight knight knit knit knit knit knive knob knob knock knock
knocker knocker knock knock knopp knot knot
"""


def test_published_sample_stems():
    assert [stem(w) for w in SAMPLE.split()] == STEMS.split()
