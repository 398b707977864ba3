import numpy as np

from lodestone.functions import vectors
from lodestone.plans import PLANS, search


def tables(spark, folder):
    docs = [(i, f"word{i % 7} and word{i % 5} here", f"src{i % 4}") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    rows = [(i, np.random.default_rng(i).standard_normal(64).tolist()) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder)


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_batches_of_sketches_do_not_join_the_text_again(spark, tmp_path, monkeypatch):
    seen, keep = [], search.store_health.keep_sketches

    def kept(rows, path, batch):
        seen.append(plan_of(rows))
        keep(rows, path, batch)

    monkeypatch.setattr(search.store_health, "keep_sketches", kept)
    assert PLANS["embedding_health_sketched"](spark, tables(spark, tmp_path)).count() == 5
    assert len(seen) == 4 and not any("Join" in p for p in seen)


def test_a_hybrid_search_does_not_join_the_store_again(spark, tmp_path, monkeypatch):
    seen, found = [], search.hybrid.search

    def searched(queries, corpus, *args, **options):
        seen.extend([plan_of(queries), plan_of(corpus)])
        return found(queries, corpus, *args, **options)

    monkeypatch.setattr(search.hybrid, "search", searched)
    folder = tables(spark, tmp_path)
    for name in ("hybrid_search", "hybrid_search_table"):
        assert PLANS[name](spark, folder).count() > 0
    assert len(seen) == 4 and not any("Join" in p for p in seen)

def test_a_trigram_is_looked_up_once_a_text(monkeypatch):
    asked, plain = [], vectors._bucket
    monkeypatch.setattr(vectors, "_bucket", lambda gram: asked.append(gram) or plain(gram))
    texts = ["", "a", "né", "xyz", "xyxyx" * 50, "日本語テキスト", "😀😀😀y"]
    got = vectors.TrigramEmbedder(32)(texts)
    assert len(asked) <= sum(len({t[i : i + 3] for i in range(max(1, len(t) - 2))}) for t in texts)
    want = [np.bincount([plain(t[i : i + 3]) % 32 for i in range(max(1, len(t) - 2))], minlength=32) for t in texts]
    assert (got == np.array(want)).all()
