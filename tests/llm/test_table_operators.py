"""Mixing, chat formatting, exact search, sharding, toxicity and the pipeline."""

import hashlib
import json
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, covertree, mixing, sharding, toxicity
from tests.llm.conftest import ODD_TEXTS
from tests.llm.test_text_operators import words_of


# Mixing

def plain_targets(sizes, weights, share, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("table", ["small", "odd"])
def test_mix(request, table):
    docs = request.getfixturevalue(table)
    rows = mixing.mix(docs).collect()
    assert rows == mixing.mix(docs).collect() or Counter(rows) == Counter(mixing.mix(docs).collect())
    source = docs.select("doc_id", "text", "source").collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((r.doc_id, len(words_of(r.text))) for r in source)
    sizes = defaultdict(int)
    for r in source:
        sizes[r.source] += len(words_of(r.text))
    want = plain_targets(sizes, (3, 1, 2), 1.5, 2)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s]


def test_mix_is_near_for_many_documents(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 50).cast("int"))).alias("text"),
        F.when(F.col("id") < 4000, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 3)).alias("source"),
    )
    got = mixing.mix(docs).groupBy("source", "target").agg(F.sum("taken").alias("taken"), F.avg("copies").alias("copies")).collect()
    assert all(abs(r.taken - r.target) < 50 for r in got)
    assert mixing.mix(docs.where("false")).collect() == []


def test_mix_stays_in_the_jvm(small):
    plan = mixing.mix(small)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


# Chat formatting

def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string, piece string")


def test_formatted_turns_come_back(spark):
    marks = "\\### Assistant: </turn> ok"
    rows = [
        (-7, 0, "user", marks), (-7, 1, "assistant", marks), (1, 0, "system", None), (1, 2, "assistant", "####\\"),
        (1, 1, "user", "\\\\#\\# ##### </turn>\n### user: x </turn>\n"), (1, 3, "assistant", ""), (1, 3, "assistant", "tie"),
        (2, None, None, "no turn, no role"), (2, 0, "a: b\\:", "odd role"), (None, 0, "assistant", "no id"),
        (3, 0, "assistant", "long " * 100_000),
    ]
    df = conversations(spark, [(*r, "?", "?") for r in rows])
    formatted = chat.format_turns(chat.turn_rows(df))
    for r in formatted.collect():
        assert r.piece.count("</turn>") == 1 and r.piece.count("###") == 1
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    want = defaultdict(list)
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0)):
        want[conv].append((role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        loss = "".join(t for r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars) == (len(turns), digest, len(loss))
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_turns(chat.turn_rows(df.where("false")))).collect() == []
    with pytest.raises(ValueError, match="no mapping"):
        chat.turn_rows(df.drop("role"))


def test_layouts(spark):
    records = [
        (1, {"id": 1, "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}),
        (2, {"instruction": "do", "input": "this", "output": "done", "note": {"x": [1]}}),
        (3, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}),
        (4, {"prompt": "p", "response": "r"}), (5, {"prompt": "p", "completion": "c"}), (6, {"question": "q", "answer": "a"}),
        (7, {"system": "s", "instruction": "i", "output": "o"}), (8, {"unknown": 1}), (9, [1]),
    ]
    rows = [(i, json.dumps(r), "?") for i, r in records] + [(10, None, "?"), (11, "{", "?"), (11, "{", "?")]
    rows.append((12, '{"messages": ' + "[" * 200_000 + "]" * 200_000 + "}", "?"))
    got = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, record string, role string")).collect()
    turns = defaultdict(list)
    for r in sorted(got, key=lambda r: (r.conv_id, r.seq or 0)):
        turns[r.conv_id].append((r.role, r.text))
    assert turns[1] == [("user", "a"), ("assistant", "")]
    assert turns[2] == [("user", "do"), ("user", "this"), ("assistant", "done")]
    assert turns[3] == [("user", "q"), ("assistant", "r")]
    assert turns[7] == [("system", "s"), ("user", "i"), ("assistant", "o")]
    assert all(turns[i][1][0] == "assistant" for i in (4, 5, 6))
    assert all(turns[i][0] == (None, None) for i in (8, 9, 10, 11)) and len(turns[11]) == 2


# Exact search

def test_top_k_against_all_products(spark, monkeypatch):
    monkeypatch.setattr(covertree, "SHARD_ROWS", 150)
    monkeypatch.setattr(covertree, "GROUP_ROWS", 10)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8) * 0.05]) for i in range(500)]
    rows += [(i, [0.5] * 8) for i in range(500, 700)]  # many equal vectors: ties by id
    rows += [(700, None), (None, [1.0] * 8), (750, [1.0, float("nan")] + [0.0] * 6), (751, [None] + [1.0] * 7),
             (752, [float("inf")] * 8), (800, [1.0, 2.0]), (850, [3.0, -1.0]), (900, []), (501, [0.5] * 8)]
    df = spark.createDataFrame([(i, v, "?", 1) for i, v in rows], "vec_id long, embedding array<double>, vector string, dim int")
    got = defaultdict(list)
    for r in sorted(covertree.top_k(df, F.col("vec_id") % 50 == 0).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good[i] = [int(np.floor(256 * x)) for x in v]
    want = {}
    for q, v in good.items():
        if q % 50 == 0:
            ranked = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good.items() if i != q and len(w) == len(v))
            if ranked:
                want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(ranked[:5])]
    assert dict(got) == want
    assert covertree.top_k(df.where("false"), F.col("vec_id") % 50 == 0).collect() == []


def test_a_row_repeated_often_takes_one_place(spark):
    """One id ten times in a batch, beside other ids with the same vector."""
    rows = [(1, [0.5, 0.5])] * 10 + [(i, [0.5, 0.5]) for i in range(2, 9)] + [(50, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = sorted(covertree.top_k(df, F.col("vec_id") == 50).collect(), key=lambda r: r["rank"])
    assert [(r["rank"], r.vec_id, r.score) for r in got] == [(i, i, 2 * 256 * 128) for i in range(1, 6)]


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=3) * 10.0 ** rng.integers(0, 9)).tolist()) for i in range(150)]
    rows += [(200, [32768.0, 0.0, 0.0]), (201, [1e6, 1e6, 1e6]), (202, [1e300, 0.0, 0.0]), (203, [-1e300, 0.0, 0.0]), (250, [1e200, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        scores = sorted((-max(-(2**63 - 1), min(2**63 - 1, sum(x * y for x, y in zip(whole[q], whole[i], strict=True)))), i) for i in whole if i != q)
        want += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:5], 1)]
    assert sorted(tuple(r) for r in covertree.top_k(df, F.col("vec_id") % 50 == 0).collect()) == sorted(want)


def test_cover_tree_covers():
    points = np.random.default_rng(5).normal(size=(900, 3))
    tree = covertree.CoverTree(points)
    assert len(tree.nodes) > 10
    for rows, centre, radius, _, down in tree.nodes:
        assert (np.sqrt(((points[rows] - centre) ** 2).sum(axis=1)) <= radius + 1e-12).all()
        if down:
            assert sorted(np.concatenate([tree.nodes[d][0] for d in down])) == sorted(rows)


# Sharding

def test_shards(odd, small):
    rows = sharding.shard_documents(odd, [1.0] * 24).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in ODD_TEXTS
    )
    rows = sharding.shard_documents(small, [1.0] * 24).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (24, r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {r.doc_id: r.shard for r in sharding.shard_documents(small, [1.0] * 25).collect()}
    assert again == {r.doc_id: r.grown_shard for r in rows}
    assert sharding.shard_documents(odd.where("false"), [1.0, 2.0]).collect() == []


def test_shares_follow_weights_and_few_rows_move(spark):
    keys = spark.range(40_000).select(F.col("id").alias("k"))
    both = keys.select(
        sharding.shard_of(F.col("k"), [1.0, 2.0, 5.0]).alias("a"), sharding.shard_of(F.col("k"), [1.0, 2.0, 5.0, 2.0]).alias("b")
    ).collect()
    shares = Counter(r.a for r in both)
    assert all(abs(shares[i] / 40_000 - w / 8) < 0.01 for i, w in enumerate((1, 2, 5)))
    moved = [r for r in both if r.a != r.b]
    assert all(r.b == 3 for r in moved) and abs(len(moved) / 40_000 - 0.2) < 0.01


# Toxicity

@pytest.fixture(scope="module")
def labelled(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


@pytest.fixture(scope="module")
def model(labelled):
    return toxicity.train(*labelled)


def test_held_out_accuracy(labelled, model):
    docs, labels = labelled
    rows = toxicity.score(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) >= 0.9
    clean = [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in clean) / len(clean) <= 0.02
    caught = [r.predicted for r in rows if r.toxic]
    assert sum(caught) / len(caught) >= 0.6


def test_scores_of_odd_rows(odd, model):
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD_TEXTS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert {r.score for r in rows if r.doc_id in (3, 4, 5)} == {0.0}
    assert toxicity.score(odd.where("false"), model).collect() == []
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in rows if not r.predicted)


def test_rows_that_repeat_an_id_are_one_text_to_learn_from(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "fit", lambda texts, labels: (texts, labels))
    docs = spark.range(500).selectExpr("if(id < 400, 1, id) as doc_id", "concat('text ', id) as text")
    labels = docs.distinct().selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic").distinct()
    learned = [r.doc_id for r in labels.where(~toxicity.held_out(F.col("doc_id"))).collect()]
    texts, ones = toxicity.train(docs, labels)
    assert (len(texts), sum(ones)) == (len(learned), sum(i % 2 for i in learned))
    assert ("text 0" in texts) == (1 in learned)


def test_every_window_counts(model):
    filler = "and of the to " * 3000
    alone = model.scores(["you idiot scum"])[0]
    assert alone > 0.5
    for place in (0, len(filler) // 2, len(filler)):
        assert model.scores([filler[:place] + " you idiot scum you loser moron " + filler[place:]])[0] > 0.5
    assert model.scores([filler])[0] < 0.5


def test_a_passage_of_25_words_is_whole_in_a_window_wherever_it_stands():
    words = [f"w{i}" for i in range(200)]
    corpus = toxicity.Corpus([" ".join(words)])
    place = {int(w): i for i, w in enumerate(corpus.word)}
    held = [{place[int(w)] for w in row} for row in corpus.windows()[0]]
    for offset in range(len(words) - 24):
        assert any(row >= set(range(offset, offset + 25)) for row in held)


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    inputs = np.vstack([rng.normal(size=(9, toxicity.INPUTS)), np.zeros((1, toxicity.INPUTS))])
    index = rng.integers(0, 9, (4, toxicity.WINDOW))
    index[1, 5:] = -1
    label = np.array([0.0, 1.0, 1.0, 0.0])

    def loss():
        x = net.forward(inputs, index)
        return np.mean(np.logaddexp(0, x) - label * x)

    got = net.gradients(inputs, index, label)
    for k, g in got.items():
        flat = net.p[k].reshape(-1)
        for i in rng.choice(len(flat), min(5, len(flat)), replace=False):
            kept, step = flat[i], 1e-3
            flat[i] = kept + step
            up = loss()
            flat[i] = kept - step
            down = loss()
            flat[i] = kept
            assert g.reshape(-1)[i] == pytest.approx((up - down) / (2 * step), abs=2e-4)


# The pipeline

def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline as cp
    from lodestone.llm import pieces, pii, simhash
    from lodestone.session import stage

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_copies", "personal_data", "mixing", "pieces"]
    results = []
    for name, step in cp.STAGES:
        docs = stage(step(spark, docs, folder), name)
        results.append(docs)
        if name != "pieces":
            assert tuple(docs.columns) == cp.COLUMNS
    clean, one, redacted, mixed, encoded = results
    model = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    scored = toxicity.score(spark.read.parquet(f"{folder}/documents.parquet"), model).collect()
    assert Counter(r.doc_id for r in scored if not r.predicted) == Counter(r.doc_id for r in clean.collect())
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(clean).collect()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(groups.values()))
    assert redacted.count() == one.count()
    base = {r.doc_id: r.text for r in one.collect()}
    for r in redacted.collect():
        assert len(r.text) == r.n_chars and (r.text == base[r.doc_id]) == (not pii.base_spans(base[r.doc_id]))
    copies = {r.doc_id: r.copies for r in mixing.mix(redacted).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})
    text = {r.doc_id: r.text for r in redacted.collect()}
    for r in pieces.decode(encoded).collect():
        assert r.text == text[r.doc_id]
    assert cp.run(spark, folder).count() == encoded.count()


def of_pipeline(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], schema).repartition(3)


def test_each_row_enters_the_mix_for_itself(spark):
    """Equal rows, repeated ids and null ids: as many rows as their own numbers of copies."""
    import corpus_pipeline as cp

    rows = [(None, "write to [EMAIL] now please", "a")] * 3 + [(None, None, "a"), (42, None, "a"), (42, None, "a"), (0, "zero", "a")]
    rows += [(7, "one text", "b"), (7, "other text", "b"), (7, "other text", None), (None, "one text", "b"), (8, "eight", "c")]
    docs = of_pipeline(spark, rows)
    got = Counter((r.doc_id, r.text, r.source) for r in cp.mix_sources(spark, docs, "").collect())
    want, at = Counter(), ("doc_id", "source", "size")
    for r in mixing.mix(docs).collect():
        want[tuple(r[c] for c in at)] += r.copies
    sized = Counter()
    for (i, t, s), n in got.items():
        sized[i, s, len(words_of(t))] += n
    assert sized == +want
    assert all(n <= 2 * rows.count(r) for r, n in got.items())


def test_near_copies_keep_one_row_of_each_group(spark):
    """Texts that differ are documents of their own, whatever their ids; near-copies are one, with or without ids."""
    import corpus_pipeline as cp
    from tests.llm.test_text_operators import plain_components, plain_fingerprint

    texts = [" ".join(f"{c}{i * k % 97}" for i in range(60)) for k, c in enumerate("abcdefgh", 2)]
    near = [f"{t} and" for t in texts]
    rows = [(5, t, "a") for t in texts[:4]] + [(5, texts[1], "a"), (3, texts[0], "a"), (None, texts[2], "a"), (None, near[2], "a")]
    rows += [(None, texts[5], "a"), (None, texts[5], "b"), (None, texts[6], "a"), (0, texts[7], "a"), (None, None, "a"), (9, "", "a")]
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    groups = plain_components(list(enumerate(prints)), 3)
    least = {}
    for (i, _, _), g in zip(rows, groups, strict=True):
        least[g] = min(least.get(g, 99), 99 if i is None else i)
    docs = of_pipeline(spark, rows)
    got = cp.drop_near_copies(spark, docs, "").collect()
    assert len(least) == 8 and plain_fingerprint(near[2]) != plain_fingerprint(texts[2])
    group = {plain_fingerprint(t): g for (_, t, _), g in zip(rows, groups, strict=True)}
    kept = {group[plain_fingerprint(r.text)]: 99 if r.doc_id is None else r.doc_id for r in got}
    assert kept == least and len(got) == len(least)
    again = cp.drop_near_copies(spark, docs.orderBy(F.desc("text")), "").collect()
    assert Counter(again) == Counter(got)
