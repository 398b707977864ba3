"""Hard negatives, BPE and ranked lexical search against brute force, a library and SQL."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import bpe, gnat, lexical, queries
from tests.llm.conftest import ODD_TEXTS

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(tuple(r) for r in got.select(*want.columns).collect())
    assert rows == sorted(want.fetchall()) and rows


# Hard negatives

def plain_negatives(rows, is_anchor, positives=5, negatives=3):
    seen = {(i, label, tuple(math.floor(256 * x) for x in v)) for i, label, v in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, label, v in seen:
        if not is_anchor(a):
            continue
        scores = sorted((-max(-gnat.LONG, min(gnat.LONG, sum(x * y for x, y in zip(v, w, strict=True)))), i, other == label)
                        for i, other, w in seen if i != a and len(w) == len(v))
        best = sorted({(s, i) for s, i, same in scores if same})[:positives]
        for p, p_id in best:
            window = sorted({(s, i) for s, i, same in scores if not same and 50 * -p <= 100 * -s <= 95 * -p})[:negatives]
            out += [(a, p_id, r, i, -p, -s) for r, (s, i) in enumerate(window, 1)]
    return sorted(out)


def negatives_of(spark, rows):
    df = spark.createDataFrame([(*r, "?", "?") for r in rows], "vec_id long, label int, embedding array<double>, mark string, region string")
    return sorted(tuple(r) for r in gnat.mine(df, F.col("vec_id") % 10 == 0).collect())


def test_hard_negatives_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(0, 3)), (rng.integers(-3, 4, 4) / 8).tolist()) for i in range(300)]
    rows += [(1000 + i, i % 2, [0.5, 0.5, 0.5, 0.5]) for i in range(40)] * 3  # equal vectors, repeated rows
    rows += [(None, 1, [1.0] * 4), (1, None, [1.0] * 4), (2, 1, None), (3, 1, [1.0, None, 1.0, 1.0]), (4, 1, [1.0, float("nan"), 1.0, 1.0]),
             (5, 1, [float("inf")] * 4), (10, 0, [0.1] * 4), (10, 2, [0.9] * 4), (20, 1, []), (21, 1, []), (22, 2, []),
             (30, 1, [0.5, 0.5]), (31, 1, [0.4, 0.5]), (32, 0, [0.5, 0.3])]
    got = negatives_of(spark, rows)
    assert got == plain_negatives(rows, lambda i: i % 10 == 0) and len(got) > 300
    assert negatives_of(spark, []) == []


def test_hard_negatives_of_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 3, (rng.normal(size=3) * 10.0 ** rng.integers(-1, 8)).tolist()) for i in range(60)]
    assert negatives_of(spark, rows) == plain_negatives(rows, lambda i: i % 10 == 0)
    rows += [(100, 0, [1e300, 0.0, 0.0]), (101, 0, [1e300, 1.0, 0.0]), (102, 1, [1e17, 0.0, 0.0])]
    assert negatives_of(spark, rows) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_hard_negatives_over_regions(spark, monkeypatch):
    for name, value in (("REGION_ROWS", 40), ("CHUNK_ROWS", 64), ("QUERY_ROWS", 16)):
        monkeypatch.setattr(gnat, name, value)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 6))
    rows = [(i, int(rng.integers(0, 4)), (centres[i % 12 if i % 3 else 0] + 0.1 * rng.normal(size=6)).tolist()) for i in range(1000)]
    got = negatives_of(spark, rows)
    assert got == plain_negatives(rows, lambda i: i % 10 == 0) and len(got) > 300


def test_ranges_rule_out_most_products_of_clustered_vectors():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(64, 16)) * 256
    data = np.floor(centres[rng.integers(0, 64, 6000)] + 12 * rng.normal(size=(6000, 16)))
    labels, ids = rng.integers(0, 5, 6000), np.arange(6000)
    at = np.arange(0, 6000, 50)
    products = data[at] @ data.T

    def search(same, least, most):
        queries = gnat.Queries(data[at], ids[at], labels[at], np.full(len(at), same), least, most, 3)
        gnat.tree_search(gnat.Tree(data), ids, labels, queries)
        for q, best in enumerate(queries.best):
            good = ((labels == labels[at[q]]) == same) & (ids != at[q]) & (products[q] >= low[q]) & (products[q] <= high[q])
            want = sorted((-int(products[q, i]), int(i)) for i in np.flatnonzero(good))[:3]
            assert best == want
        return queries.products / products.size

    low, high = np.full(len(at), -np.inf), np.full(len(at), np.inf)
    assert search(True, low.copy(), high) < 0.1
    low, high = products.max(axis=1) * 0.5, products.max(axis=1) * 0.95
    assert search(False, low.copy(), high) < 0.5


# BPE

@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.MODEL)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary.load())


def ids_of(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


def test_bpe_of_random_texts(library, encoder):
    rng = random.Random(1)
    parts = ["the", "ing", "'s", "'RE", "12", " ", "́", "e", "Σ", "ς", "İ", "Ⱥ", "<|endoftext|>", "<|startoftext|>", "<|", "|>",
             "\x85", "\xa0", "\x1c", "  ", "\n", "!?", "ﬁ", "각", "ᄀ", "ᅡ", "😀", "\U0001c89a", "天地"]
    kinds = (
        lambda: "".join(rng.choice("aab") for _ in range(rng.randint(0, 60))),
        lambda: "".join(rng.choice("etaoin shr") for _ in range(rng.randint(0, 200))),
        lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))),
        lambda: "".join(chr(rng.choice((rng.randint(0, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x1FFFF)))) for _ in range(40)),
    )
    for i in range(2000):
        text = kinds[i % len(kinds)]()
        ids = library.encode(text, add_special_tokens=False).ids
        assert ids_of(encoder, text) == ids
        assert encoder.decode(np.array(ids, np.int64)).decode() == library.decode(ids, skip_special_tokens=False)


def test_bpe_of_every_character(library, encoder):
    for a in range(0, 0x20000, 256):
        text = " ".join("a" + chr(c) for c in range(a, a + 256) if not 0xD800 <= c < 0xE000)
        assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids


def test_bpe_of_long_words_in_linear_time(library, encoder):
    rng = random.Random(2)
    for text in ("a" * 200_000, "天地" * 50_000, "".join(rng.choice("etaoinshr") for _ in range(200_000)), "ab" * 100_001):
        assert ids_of(encoder, text) == library.encode(text, add_special_tokens=False).ids
    encoder.known.clear()
    before = len(encoder.known)
    assert encoder.encode("") == b"" and len(encoder.known) == before


def test_bpe_pairs_agree_with_merging(encoder):
    """The table against merging pair by pair."""

    def merged(symbols):
        row = [encoder.token[s] for s in symbols]
        n = len(encoder.texts)
        while True:
            ranks = [encoder.pairs.get(a * n + b, n) for a, b in zip(row[:-1], row[1:], strict=True)]
            if not ranks or min(ranks) == n:
                return row
            i = ranks.index(min(ranks))
            row[i : i + 2] = [ranks[i]]

    rng = random.Random(3)
    tokens = sorted(t for t, s in enumerate(encoder.texts) if max(s) < chr(bpe.LAST))
    seen = Counter()
    for _ in range(3000):
        a, b = rng.choice(tokens[: 256 + 2000]), rng.choice(tokens[: 256 + 2000])
        fits = encoder.compatible(a, b)
        assert fits == (merged(encoder.texts[a] + encoder.texts[b]) == [a, b])
        seen[fits] += 1
    assert min(seen.values()) > 100


def test_bpe_table(spark, odd, library):
    rows = bpe.encode(odd)
    want = Counter()
    for i, text, _ in ODD_TEXTS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want[i, len(ids), tuple(ids), digest, hashlib.sha256(decoded.encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_tokens, tuple(r.tokens), r.ids_sha256, r.decoded_sha256) for r in rows.collect())
    assert got == want
    back = Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in bpe.decode(rows).collect())
    assert back == Counter({(k[0], k[4]): n for k, n in want.items()})
    bad = spark.createDataFrame([(1, None), (2, []), (3, [-1, 320, None, 10**9]), (4, [49407])], "doc_id long, tokens array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(bad).collect()} == {1: None, 2: "", 3: "a</w>", 4: "<|endoftext|>"}
    assert bpe.encode(odd.where("false")).collect() == [] and bpe.decode(bad.where("false")).collect() == []


# Ranked lexical search

def plain_rank(items, docs, k=20):
    counts = [(i, c) for i, t in docs if (c := lexical.terms(t))]
    n_docs, n_terms = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for i, c in counts:
            m = 100 - 25 + (25 * c.total() * n_docs) // n_terms
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
                for t, times in lexical.terms(text).items() if c[t]
            )
            scores.append((-score, i is None, i or 0, i))
        out += [(item, r, s[3], -s[0]) for r, s in enumerate(sorted(s for s in scores if s[0] < 0)[:k], 1)]
    return out


def ranked(spark, items, docs, **options):
    asked = spark.createDataFrame([(*i, "?") for i in items], "item_id long, text string, number string")
    if not hasattr(docs, "select"):
        docs = spark.createDataFrame([(*d, "?") for d in docs], "doc_id long, text string, shard string")
    return [(r.item_id, r.rank, r.doc_id, r.score) for r in lexical.rank(asked, docs, **options).collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


def test_terms():
    assert lexical.terms("Ab-aB é_É1\x7f\x00ÀB 9") == {b"ab": 2, "é".encode(): 1, "É1".encode(): 1, "Àb".encode(): 1, b"9": 1}
    assert lexical.terms(None) == lexical.terms("") == {}


def test_rank_of_odd_rows(spark, odd):
    items = [(1, "The quick the cat"), (2, None), (3, "nothing of the kind zzz"), (None, "w1 w2 w3 w1"), (4, ""), (5, "idiot and mail"),
             (5, "idiot and mail"), (5, "other fox"), (6, "x" * 20_000)]
    docs = [(i, t) for i, t, _ in ODD_TEXTS]
    got = ranked(spark, items, odd)
    assert order(got) == order(plain_rank(items, docs)) and got
    assert ranked(spark, items, odd.where("false")) == [] and ranked(spark, [], odd) == []


@pytest.mark.parametrize("asked_bytes", [lexical.ASKED_BYTES, 0])
def test_rank_over_shards(spark, monkeypatch, asked_bytes):
    for name, value in (("SHARD_DOCS", 100), ("BLOCK", 4), ("ITEM_ROWS", 7), ("CELLS", 64), ("ASKED_BYTES", asked_bytes)):
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(7)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(20_000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30)))) for i in range(600)]
    docs += [(2000 - i, "copy of w1 w2 rare") for i in range(300)] + [(7, "copy of w1 w2 rare")] * 30 + [(None, "w1 rare"), (None, "w1 rare")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(40)] + [(99, "rare w1"), (98, "w1 w1 w1")]
    got = ranked(spark, items, docs)
    assert order(got) == order(plain_rank(items, docs))


def test_summaries_skip_documents(small):
    """Blocks whose bound is too low are not scored, and nothing is lost by it."""
    rng = np.random.default_rng(8)
    topics = [rng.choice(400, 20, replace=False) for _ in range(30)]
    rows = [np.unique(np.append(rng.choice(topics[i % 30], 12), rng.choice(400, 3))) for i in range(3000)]
    ends = np.append(0, np.cumsum([len(r) for r in rows]))
    index = lexical.BlockedIndex(ends, np.concatenate(rows), rng.integers(1000, 9000, ends[-1]), 400)
    dense = np.zeros((3000, 400), np.int64)
    dense[index.docs, index.columns] = index.impacts
    matches = 0
    for t in range(30):
        asked, weights = topics[t][:8], rng.integers(1, 50, 8)
        scores = dense[:, asked] @ weights
        matches += int((scores > 0).sum())
        best = np.lexsort((np.arange(3000), -scores))[:10]
        got, docs = index.search(asked, weights, np.arange(3000), 10)
        assert got.tolist() == scores[best].tolist() and docs.tolist() == best.tolist()
    assert index.scored < matches / 2


def test_rank_of_whole_documents(spark, small):
    items = [(r.doc_id, r.text) for r in small.where("doc_id % 40 = 0").collect()]
    docs = [(r.doc_id, r.text) for r in small.collect()]
    got = defaultdict(list)
    for r in order(ranked(spark, items, small)):
        got[r[0]].append(r)
    assert dict(got) == {i: [r for r in order(plain_rank(items, docs)) if r[0] == i] for i, _ in items}
