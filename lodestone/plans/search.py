"""Search, embedding, sampling and their evaluation over the test tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import ENGLISH_STOPWORDS, SPACE_PATTERN, TOKEN_PATTERN, analyze
from lodestone.functions.vectors import TrigramEmbedder
from lodestone.operators import embedding, evaluation, hybrid, keyword, knn, lexicon, sampling, store_health
from lodestone.operators.cells import CellIndex
from lodestone.plans.registry import Tables, plan
from lodestone.plans.standins import CORPUS_SQL, corpus
from lodestone.session import scratch_path, spread, stage

DIM = 64
make_embedder = partial(TrigramEmbedder, DIM)


def _tokens(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '{TOKEN_PATTERN}')"


def keyword_sql(queries: str, rows: str, k: int | None) -> str:
    """CTEs up to ``kw``: BM25 of the rows that hold all lexemes of a query."""
    last = (
        "kw AS (SELECT query_id, id, score FROM scored)" if k is None else
        f"""kw AS (SELECT query_id, id, score, r FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM scored
        ) WHERE r <= {k})"""
    )
    return f"""
    toks AS (SELECT id, {_tokens('content')} AS ws FROM {rows}),
    lens AS (SELECT id, len(ws) AS dl FROM toks),
    post AS (SELECT id, w, count(*) AS tf FROM (SELECT id, unnest(ws) AS w FROM toks) GROUP BY id, w),
    stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
    dfs AS (SELECT w, count(*) AS df FROM post GROUP BY w),
    qt AS (SELECT DISTINCT query_id, w FROM (SELECT query_id, unnest({_tokens('query_text')}) AS w FROM {queries})),
    qn AS (SELECT query_id, count(*) AS nw FROM qt GROUP BY query_id),
    scored AS (
        SELECT m.query_id, m.id,
               round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE
                         / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
        FROM (SELECT query_id, id, qt.w, tf FROM qt JOIN post ON qt.w = post.w) m
        JOIN dfs ON dfs.w = m.w JOIN lens ON lens.id = m.id CROSS JOIN stats
        GROUP BY m.query_id, m.id
        HAVING count(*) = (SELECT nw FROM qn WHERE qn.query_id = m.query_id)
    ),
    {last}"""


def vector_sql(queries: str, rows: str, k: int) -> str:
    """CTE ``vec``: the k nearest rows of each query."""
    return f"""
    vec AS (SELECT query_id, id, distance, r FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM (
            SELECT q.query_id, c.id,
                   round(1 - list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])
                         / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))
                            * sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))), 6) + 0.0::DOUBLE AS distance
            FROM {queries} q CROSS JOIN {rows} c
            WHERE q.embedding IS NOT NULL AND c.embedding IS NOT NULL
        )
    ) WHERE r <= {k})"""


def embed_sql(name: str, rows: str, key: str, text: str, dim: int = DIM) -> str:
    """CTE ``name`` (key, embedding): hashed trigram counts of the lowercased text."""
    return f"""
    {name}_grams AS (
        SELECT {key} AS k, ('0x' || substr(md5(substr(lower({text}), i, 3)), 1, 7))::BIGINT % {dim} AS bucket
        FROM (SELECT {key}, {text}, unnest(range(1, greatest(1, length(lower({text})) - 2) + 1)) AS i FROM {rows})
    ),
    {name} AS (
        SELECT g.k AS {key}, list(coalesce(c.n, 0)::DOUBLE ORDER BY g.bucket) AS embedding
        FROM (SELECT DISTINCT {key} AS k, b.range AS bucket FROM {rows} CROSS JOIN range({dim}) b) g
        LEFT JOIN (SELECT k, bucket, count(*) AS n FROM {name}_grams GROUP BY k, bucket) c USING (k, bucket)
        GROUP BY g.k
    )"""


@plan("analyze_tokens", f"""
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_tokens, CAST(len(list_distinct(ws)) AS BIGINT) AS n_distinct,
       array_to_string(ws, ' ') AS lexemes
FROM (SELECT doc_id, {_tokens('text')} AS ws FROM documents)
""")
def analyze_tokens(spark: SparkSession, folder: str) -> DataFrame:
    documents = Tables(spark, folder).documents
    return documents.select("doc_id", analyze(F.col("text")).alias("ws")).select(
        "doc_id",
        F.size("ws").cast("long").alias("n_tokens"),
        F.size(F.array_distinct("ws")).cast("long").alias("n_distinct"),
        F.array_join("ws", " ").alias("lexemes"),
    )


_STOPS = ", ".join(f"'{w}'" for w in ENGLISH_STOPWORDS)
_LEXICON_SQL = f"""
    lexicon AS (
        SELECT word, CASE
            WHEN word IN ({_STOPS}) THEN NULL
            WHEN word LIKE '%ies' THEN CASE WHEN word LIKE '%eies' OR word LIKE '%aies' THEN word ELSE word[:-4] || 'y' END
            WHEN word LIKE '%es' THEN CASE WHEN word LIKE '%aes' OR word LIKE '%ees' OR word LIKE '%oes' THEN word ELSE word[:-2] END
            WHEN word LIKE '%s' THEN CASE WHEN word LIKE '%us' OR word LIKE '%ss' THEN word ELSE word[:-2] END
            ELSE word END AS lexeme
        FROM (SELECT DISTINCT unnest({_tokens('text')}) AS word FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark))
    )"""


def _lexed_sql(name: str, key: str, content: str, rows: str) -> str:
    """CTE ``name``: the texts of ``rows`` as lexemes in reading order."""
    return f"""
    {name} AS (
        SELECT r.{key} AS {key}, coalesce(l.{content}, '') AS {content} FROM {rows} r LEFT JOIN (
            SELECT {key}, string_agg(lexeme, ' ' ORDER BY pos) AS {content}
            FROM (SELECT {key}, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
                  FROM (SELECT {key}, {_tokens(content)} AS ws FROM {rows})) JOIN lexicon USING (word)
            WHERE lexeme IS NOT NULL GROUP BY {key}
        ) l USING ({key})
    )"""


def _lexicon(t: Tables) -> DataFrame:
    """The words of the documents, then those that the passages add, each written once."""
    path = scratch_path(t.documents.sparkSession, "lexicon")
    lexicon.lexicon(t.documents, "text", rule="plural").write.parquet(f"{path}/batch=0")
    known = t.documents.sparkSession.read.parquet(f"{path}/batch=0")
    lexicon.extend(known, t.benchmark, "text", rule="plural").write.parquet(f"{path}/batch=1")
    return t.documents.sparkSession.read.parquet(path).select("word", "lexeme")


@plan("lexicon_postings", f"""
WITH {_LEXICON_SQL},
placed AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, {_tokens('text')} AS ws FROM documents))
SELECT doc_id, lexeme, CAST(count(*) AS BIGINT) AS tf, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
FROM placed JOIN lexicon USING (word) WHERE lexeme IS NOT NULL GROUP BY doc_id, lexeme
""")
def lexicon_postings(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    return lexicon.lexeme_postings(t.documents, _lexicon(t), "doc_id", "text").select(
        "doc_id", "lexeme", F.col("tf").cast("long").alias("tf"),
        F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"),
    )


@plan("lexicon_search", f"""
WITH {_LEXICON_SQL},
{_lexed_sql("asked", "query_id", "query_text", "(SELECT item_id AS query_id, text AS query_text FROM benchmark)")},
{_lexed_sql("rows_", "id", "content", "(SELECT doc_id AS id, text AS content FROM documents)")},
{keyword_sql("asked", "rows_", 10)}
SELECT query_id, id, score, CAST(r AS BIGINT) AS rank FROM kw
""")
def lexicon_search(spark: SparkSession, folder: str) -> DataFrame:
    """Passages against documents by lexeme: a word matches its plural, and stop words do not count."""
    t = Tables(spark, folder)
    words = _lexicon(t)
    passages = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return keyword.match_rank(passages, _texts(t), 10, lexemes=words)


@plan("build_postings", f"""
WITH toks AS (SELECT doc_id AS id, {_tokens('text')} AS ws FROM documents),
     placed AS (SELECT id, len(ws) AS n_tokens, unnest(ws) AS lexeme, generate_subscripts(ws, 1) AS pos FROM toks)
SELECT lexeme, id, CAST(count(*) AS BIGINT) AS tf, CAST(n_tokens AS BIGINT) AS n_tokens,
       string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions
FROM placed GROUP BY lexeme, id, n_tokens
""")
def build_postings(spark: SparkSession, folder: str) -> DataFrame:
    rows = keyword.postings(Tables(spark, folder).documents, "doc_id", "text")
    return rows.select(
        "lexeme", "id", F.col("tf").cast("long").alias("tf"), F.col("n_tokens").cast("long").alias("n_tokens"),
        F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"),
    )


PASSAGES = "(SELECT item_id AS query_id, text AS query_text FROM benchmark)"
_TEXTS = "(SELECT doc_id AS id, text AS content FROM documents)"


def _texts(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


@plan("match_all_terms", f"""
WITH {keyword_sql(PASSAGES, _TEXTS, None)}
SELECT query_id, id, score FROM kw
""")
def match_all_terms(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    passages = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return keyword.match_rank(passages, _texts(t), None)


@plan("keyword_topk", f"""
WITH {keyword_sql("(SELECT doc_id AS query_id, text AS query_text FROM documents)", _TEXTS, 10)}
SELECT query_id, id, score, CAST(r AS BIGINT) AS rank FROM kw
""")
def keyword_topk(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    texts = _texts(t)
    return keyword.match_rank(texts, texts, 10, query_key="id", query_text="content")


@plan("keyword_ts_rank", f"""
WITH toks AS (SELECT doc_id AS id, {_tokens('text')} AS ws FROM documents),
post AS (SELECT id, w, pos FROM (
    SELECT id, w, pos, row_number() OVER (PARTITION BY id, w ORDER BY pos) AS n FROM (
        SELECT DISTINCT id, w, least(pos, 16383) AS pos
        FROM (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM toks)
    )
) WHERE n <= 255),
qt AS (SELECT DISTINCT item_id AS query_id, w FROM (SELECT item_id, unnest({_tokens('text')}) AS w FROM benchmark)),
qn AS (SELECT query_id, count(*) AS nw FROM qt GROUP BY query_id),
matched AS (
    SELECT query_id, id FROM qt JOIN (SELECT DISTINCT id, w FROM post) USING (w) GROUP BY query_id, id
    HAVING count(*) = (SELECT nw FROM qn WHERE qn.query_id = qt.query_id)
),
placed AS (SELECT m.query_id, m.id, p.w, p.pos FROM matched m JOIN qt USING (query_id) JOIN post p ON p.id = m.id AND p.w = qt.w),
pairs AS (
    SELECT a.query_id, a.id, abs(a.pos - b.pos) AS d FROM placed a JOIN placed b
    ON a.query_id = b.query_id AND a.id = b.id AND a.w < b.w
),
scored AS (
    SELECT query_id, id, round(1 - exp(sum(ln(1 - 0.1::DOUBLE * sqrt(
        CASE WHEN d > 100 THEN 1e-30 ELSE 1 / (1.005::DOUBLE + 0.05::DOUBLE * exp(d / 1.5::DOUBLE - 2)) END)))), 6) AS score
    FROM pairs WHERE d > 0 GROUP BY query_id, id
    UNION ALL
    SELECT query_id, id, round(0.1::DOUBLE * sum(1.0::DOUBLE / (n * n)) / 1.64493406685::DOUBLE, 6)
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY pos) AS n FROM placed JOIN qn USING (query_id) WHERE nw = 1)
    GROUP BY query_id, id
)
SELECT query_id, id, score, CAST(r AS BIGINT) AS rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM scored
) WHERE r <= 10
""")
def keyword_ts_rank(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    passages = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return keyword.match_rank(passages, _texts(t), 10, ranking="ts_rank")


@plan("keyword_topk_indexed", f"""
WITH {keyword_sql(PASSAGES, _TEXTS, 10)}
SELECT query_id, id, score, CAST(r AS BIGINT) AS rank FROM kw
""")
def keyword_topk_indexed(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    path = f"{scratch_path(spark, 'index')}/text"
    keyword.TextIndex.write(corpus(t), path, buckets=16)
    passages = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return keyword.match_rank(passages, keyword.TextIndex.read(spark, path), 10)


_VECTORS = "(SELECT vec_id AS query_id, embedding FROM embeddings)"


@plan("knn_cosine", f"""
WITH {vector_sql(_VECTORS, "(SELECT vec_id AS id, embedding FROM embeddings)", 10)}
SELECT query_id, id, distance, CAST(r AS BIGINT) AS rank FROM vec
""")
def knn_cosine(spark: SparkSession, folder: str) -> DataFrame:
    vectors = Tables(spark, folder).embeddings
    return knn.knn(vectors, vectors, 10, query_key="vec_id", corpus_key="vec_id")


LSH_SQL = f"""
planes AS (
    SELECT b.range AS b, i.range AS i, CASE WHEN substr(md5('42:' || b.range || ':' || i.range), 1, 1) >= '8' THEN 1 ELSE -1 END AS s
    FROM range(8) b, range({DIM}) i
),
margins AS (
    SELECT vec_id, b, sum(s * embedding[i + 1]::DOUBLE) AS m FROM embeddings, planes GROUP BY vec_id, b
),
cells AS (SELECT vec_id, sum(CASE WHEN m > 0 THEN 1 << b ELSE 0 END) AS cell FROM margins GROUP BY vec_id),
probes AS (SELECT vec_id AS query_id, cell FROM (
    SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY cost, cell) AS r FROM (
        SELECT vec_id, c.range AS cell, sum(CASE WHEN (m > 0) <> ((c.range >> b) & 1 = 1) THEN m * m ELSE 0 END) AS cost
        FROM margins, range(256) c GROUP BY vec_id, c.range
    )
) WHERE r <= 192),
near AS (SELECT query_id, id, distance, r FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS r FROM (
        SELECT p.query_id, c.vec_id AS id,
               round(1 - list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])
                     / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))
                        * sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 6) + 0.0::DOUBLE AS distance
        FROM probes p JOIN cells c ON c.cell = p.cell
        JOIN embeddings q ON q.vec_id = p.query_id JOIN embeddings e ON e.vec_id = c.vec_id
    )
) WHERE r <= 10)"""


@plan("knn_lsh", f"""
WITH {LSH_SQL}
SELECT query_id, id, distance, CAST(r AS BIGINT) AS rank FROM near
""")
def knn_lsh(spark: SparkSession, folder: str) -> DataFrame:
    vectors = Tables(spark, folder).embeddings
    return knn.knn_lsh(vectors, vectors, 10, DIM, query_key="vec_id", corpus_key="vec_id")


@plan("knn_lsh_stored", f"""
WITH {LSH_SQL}
SELECT query_id, id, distance, CAST(r AS BIGINT) AS rank FROM near
""")
def knn_lsh_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The same search against a store partitioned by cell."""
    vectors = Tables(spark, folder).embeddings
    path = f"{scratch_path(spark, 'cells')}/vectors"
    knn.write_cells(vectors, path, DIM)
    return knn.knn_lsh(
        vectors, spark.read.parquet(path), 10, DIM, query_key="vec_id", corpus_key="vec_id", cell="cell"
    )


@plan("knn_lsh_recall", f"""
WITH {LSH_SQL}, {vector_sql(_VECTORS, "(SELECT vec_id AS id, embedding FROM embeddings)", 10)}
SELECT expected, found, round(found / greatest(expected, 1), 6) AS recall FROM (
    SELECT count(*) AS expected, count(n.id) AS found FROM vec v LEFT JOIN near n ON n.query_id = v.query_id AND n.id = v.id
)
""")
def knn_lsh_recall(spark: SparkSession, folder: str) -> DataFrame:
    vectors = Tables(spark, folder).embeddings
    exact = knn.knn(vectors, vectors, 10, query_key="vec_id", corpus_key="vec_id")
    return knn.neighbour_recall(exact, knn_lsh(spark, folder))


@plan("knn_pruned", f"""
WITH {vector_sql(_VECTORS, "(SELECT vec_id AS id, embedding FROM embeddings)", 10)}
SELECT query_id, id, distance, CAST(r AS BIGINT) AS rank FROM vec
""")
def knn_pruned(spark: SparkSession, folder: str) -> DataFrame:
    """The exact search by fitted cells: own cell first, then those within reach of the kth distance."""
    vectors = Tables(spark, folder).embeddings
    index = CellIndex.build(vectors, corpus_key="vec_id")
    return index.exact(vectors, 10, query_key="vec_id")


@plan("knn_cells_recall", """
SELECT n * least(n, 10) AS expected, true AS enough FROM (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL)
""")
def knn_cells_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbours of all documents from a stored index, from as many cells as a sample of them needs, against the exact ones."""
    store = stage(embedding.embed(spread(_texts(Tables(spark, folder)), "id"), "content", make_embedder).select("id", "embedding"))
    path = f"{scratch_path(spark, 'cell-index')}/index"
    CellIndex.write(store, path)
    index = CellIndex.read(spark, path)
    # Staged, so that what it shuffled is gone before the exact search.
    near = stage(index.search(store, 10, index.probes_for(store, 10, query_key="id"), query_key="id"), "near")
    found = knn.neighbour_recall(knn.knn(store, store, 10, query_key="id"), near)
    return found.select("expected", (F.col("recall") >= 0.9).alias("enough"))


# Every stored row asks for its own neighbours, by its vector and its whole text.
_STORED = "(SELECT id AS query_id, content AS query_text, embedding FROM corpus WHERE embedding IS NOT NULL)"


def _query_by_example(store: DataFrame) -> DataFrame:
    return store.where(F.col("embedding").isNotNull()).select(
        F.col("id").alias("query_id"), F.col("content").alias("query_text"), "embedding"
    )


def _fused_sql(rows: str) -> str:
    return f"""{CORPUS_SQL}, {vector_sql(_STORED, rows, 50)}, {keyword_sql(_STORED, rows, 50)},
fused AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
        SELECT v.query_id, v.id, v.r AS vector_rank, kw.r AS keyword_rank,
               1.0::DOUBLE / (60 + v.r) + coalesce(1.0::DOUBLE / (60 + kw.r), 0) AS score
        FROM vec v LEFT JOIN kw ON kw.query_id = v.query_id AND kw.id = v.id
    )
)"""


@plan("rrf_fuse", f"""
WITH {_fused_sql("corpus")}
SELECT query_id, id, CAST(vector_rank AS BIGINT) AS vector_rank, CAST(keyword_rank AS BIGINT) AS keyword_rank,
       round(score, 9) AS score, CAST(rank AS BIGINT) AS rank
FROM fused WHERE rank <= 10
""")
def rrf_fuse(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    same = F.col("doc_id") == F.col("vec_id")
    vectors = t.embeddings.join(t.documents, same, "left_semi")
    near = knn.knn(vectors, vectors, hybrid.DEPTH, query_key="vec_id", corpus_key="vec_id")
    asked = t.documents.join(t.embeddings, same, "left_semi")
    words = keyword.match_rank(asked, _texts(t), hybrid.DEPTH, query_key="doc_id", query_text="text")
    fused = knn.top_per_query(hybrid.fuse(near, words), 10, [F.col("score").desc(), F.col("id")])
    return fused.withColumn("score", F.round("score", 9))


def _hits_sql(rows: str) -> str:
    return f"""
WITH {_fused_sql(rows)}
SELECT f.query_id, CAST(f.rank AS BIGINT) AS rank, c.table_name, c.column_name, c.row_id, c.content,
       round(f.score, 9) AS score
FROM fused f JOIN corpus c ON c.id = f.id WHERE f.rank <= 10
"""


@plan("hybrid_search", _hits_sql("corpus"))
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    # Staged, so that the text is joined to the vectors once and not for every part of the search.
    store = stage(corpus(Tables(spark, folder)), "store")
    return hybrid.search(_query_by_example(store), store, 10).withColumn("score", F.round("score", 9))


_NAMES_SQL = """
names AS (
    SELECT p_partkey * 4 AS id, 'part' AS table_name, 'name' AS column_name, CAST(p_partkey AS VARCHAR) AS row_id, p_name AS content FROM part
    UNION ALL SELECT c_custkey * 4 + 1, 'customer', 'name', CAST(c_custkey AS VARCHAR), c_name FROM customer
),
asked AS (SELECT p_partkey AS query_id, split_part(p_name, ' ', 1) AS query_text FROM part WHERE p_partkey % 50 = 0)"""


@plan("search_text", f"""
WITH {_NAMES_SQL}, {embed_sql("name_vectors", "names", "id", "content")}, {embed_sql("asked_vectors", "asked", "query_id", "query_text")},
corpus AS (SELECT * FROM names JOIN name_vectors USING (id)),
parts AS (SELECT * FROM corpus WHERE table_name = 'part'),
given AS (SELECT * FROM asked JOIN asked_vectors USING (query_id)),
{vector_sql("given", "parts", 50)}, {keyword_sql("given", "parts", 50)},
fused AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
        SELECT v.query_id, v.id, 1.0::DOUBLE / (60 + v.r) + coalesce(1.0::DOUBLE / (60 + kw.r), 0) AS score
        FROM vec v LEFT JOIN kw ON kw.query_id = v.query_id AND kw.id = v.id
    )
)
SELECT f.query_id, CAST(f.rank AS BIGINT) AS rank, c.table_name, c.column_name, c.row_id, c.content, round(f.score, 9) AS score
FROM fused f JOIN corpus c ON c.id = f.id WHERE f.rank <= 10
""")
def search_text(spark: SparkSession, folder: str) -> DataFrame:
    """Queries given as text, against one table of an embedded store of names."""
    t = Tables(spark, folder)
    part = t.part.select(
        (F.col("p_partkey") * 4).alias("id"), F.lit("part").alias("table_name"), F.lit("name").alias("column_name"),
        F.col("p_partkey").cast("string").alias("row_id"), F.col("p_name").alias("content"),
    )
    customer = t.customer.select(
        (F.col("c_custkey") * 4 + 1).alias("id"), F.lit("customer").alias("table_name"), F.lit("name").alias("column_name"),
        F.col("c_custkey").cast("string").alias("row_id"), F.col("c_name").alias("content"),
    )
    store = stage(embedding.embed(spread(part.unionByName(customer), "id"), "content", make_embedder), "names")
    asked = t.part.where("p_partkey % 50 = 0").select(
        F.col("p_partkey").alias("query_id"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("query_text")
    )
    return hybrid.search_text(asked, store, make_embedder, 10, table_name="part").withColumn("score", F.round("score", 9))


@plan("hybrid_search_table", _hits_sql("(SELECT * FROM corpus WHERE table_name = 'src3')"))
def hybrid_search_table(spark: SparkSession, folder: str) -> DataFrame:
    store = stage(corpus(Tables(spark, folder)), "store")
    hits = hybrid.search(_query_by_example(store), store, 10, table_name="src3")
    return hits.withColumn("score", F.round("score", 9))


@plan("embedding_health", f"""
WITH {CORPUS_SQL}
SELECT table_name, column_name, count(*) AS rows_total, count(DISTINCT content) AS distinct_contents,
       count(DISTINCT embedding) AS distinct_embeddings,
       round(count(DISTINCT embedding) / nullif(count(*), 0), 4) AS distinct_ratio
FROM corpus GROUP BY table_name, column_name ORDER BY distinct_ratio, table_name
""")
def embedding_health(spark: SparkSession, folder: str) -> DataFrame:
    return store_health.embedding_health(corpus(Tables(spark, folder))).orderBy("distinct_ratio", "table_name")


@plan("embedding_health_approx")
def embedding_health_approx(spark: SparkSession, folder: str) -> DataFrame:
    return store_health.embedding_health_approx(corpus(Tables(spark, folder)))


@plan("embedding_health_sketched", f"""
WITH {CORPUS_SQL}
SELECT table_name, column_name, count(DISTINCT content) AS distinct_contents,
       count(DISTINCT embedding) AS distinct_embeddings, TRUE AS distinct_contents_within, TRUE AS distinct_embeddings_within
FROM (SELECT * FROM corpus UNION ALL SELECT * REPLACE ('all' AS table_name) FROM corpus)
GROUP BY table_name, column_name
""")
def embedding_health_sketched(spark: SparkSession, folder: str) -> DataFrame:
    """Sketches kept for each of four batches and merged on read, beside exact counts; the whole store as a table too."""
    # Staged, so that the text is joined to the vectors once and not for every batch.
    rows = stage(corpus(Tables(spark, folder)), "store")
    rows = rows.unionByName(rows.withColumn("table_name", F.lit("all")))
    kept = scratch_path(spark, "sketches")
    for batch in range(4):
        store_health.keep_sketches(rows.where(F.pmod("id", F.lit(4)) == batch), kept, batch)
    estimated = store_health.sketched_health(spark.read.parquet(kept))
    return store_health.check_sketches(estimated, store_health.embedding_health(rows)).drop(
        "distinct_contents_estimate", "distinct_embeddings_estimate"
    )


@plan("validate_store", f"""
WITH {CORPUS_SQL}
SELECT count(*) AS rows_total, count(*) FILTER (WHERE embedding IS NULL) AS null_vectors,
       count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_dimension,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT table_name, column_name, row_id FROM corpus)) AS duplicate_keys
FROM corpus
""")
def validate_store(spark: SparkSession, folder: str) -> DataFrame:
    return store_health.validate_store(corpus(Tables(spark, folder)), DIM)


@plan("collapsed_vectors", """
SELECT min(d.doc_id) AS first_id, count(*) AS rows_total, count(DISTINCT d.text) AS contents
FROM documents d JOIN embeddings e ON e.vec_id = (d.doc_id // 2) % (SELECT count(*) FROM embeddings)
GROUP BY e.embedding HAVING count(DISTINCT d.text) > 1
""")
def collapsed_vectors(spark: SparkSession, folder: str) -> DataFrame:
    t = Tables(spark, folder)
    # A store gone wrong in the way this looks for: neighbours by id share a vector, drawn from all of them.
    place = F.floor(F.col("doc_id") / 2) % t.embeddings.count()
    store = t.documents.join(t.embeddings, F.col("vec_id") == place).select(
        F.col("doc_id").alias("id"), F.col("text").alias("content"), "embedding"
    )
    return store_health.collapsed_vectors(store)


@plan("embed_column", f"""
WITH src AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND length(text) >= 8),
{embed_sql('vecs', 'src', 'doc_id', 'text')}
SELECT 'documents' AS table_name, 'text' AS column_name, CAST(doc_id AS VARCHAR) AS row_id, text AS content,
       array_to_string(embedding::BIGINT[], ',') AS embedding
FROM src JOIN vecs USING (doc_id)
""")
def embed_column(spark: SparkSession, folder: str) -> DataFrame:
    rows = embedding.embed_column(
        Tables(spark, folder).documents, "documents", "text", "doc_id", make_embedder, limit=None
    )
    return rows.withColumn("embedding", F.array_join(F.col("embedding").cast("array<bigint>").cast("array<string>"), ","))


@plan("embed_batches", """
WITH placed AS (
    SELECT length(text) AS c, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r FROM documents
)
SELECT CAST((r - 1) // 64 AS BIGINT) AS batch, count(*) AS n, CAST(sum(c) AS BIGINT) AS chars, max(r) AS done
FROM placed GROUP BY 1
""")
def embed_batches(spark: SparkSession, folder: str) -> DataFrame:
    return embedding.batch_statistics(Tables(spark, folder).documents, "doc_id", "text")


_WORDS = rf"""list_filter(string_split(trim(regexp_replace(content, '{SPACE_PATTERN}', ' ', 'g')), ' '), lambda x: x <> '')"""


def perturb_sql(rows: str, id_col: str = "id", content: str = "content") -> str:
    """CTE ``perturbed`` (id, perturbation, query_text, pno)."""
    return f"""
    pw AS (
        SELECT id, content, length(content) AS n, {_WORDS} AS w FROM (SELECT {id_col} AS id, {content} AS content FROM {rows})
    ),
    pi AS (
        SELECT *, CAST((id * 7919 + 42) % greatest(len(w) - 1, 1) AS BIGINT) AS i,
               CAST(1 + (id * 7919 + 42) % greatest(n - 2, 1) AS BIGINT) AS p FROM pw
    ),
    perturbed AS (
        SELECT id, 'identity' AS perturbation, content AS query_text, 0 AS pno FROM pi
        UNION ALL SELECT id, 'lower', lower(content), 1 FROM pi
        UNION ALL SELECT id, 'drop_first', array_to_string(w[2:], ' '), 2 FROM pi WHERE len(w) >= 2
        UNION ALL SELECT id, 'drop_last', array_to_string(w[1:len(w) - 1], ' '), 3 FROM pi WHERE len(w) >= 2
        UNION ALL SELECT id, 'swap_adjacent',
               array_to_string(list_concat(list_concat(w[1:i], [w[i + 2], w[i + 1]]), w[i + 3:]), ' '), 4
               FROM pi WHERE len(w) >= 2
        UNION ALL SELECT id, 'typo',
               substr(content, 1, p) || substr(content, p + 2, 1) || substr(content, p + 1, 1) || substr(content, p + 3), 5
               FROM pi WHERE n > 6
        UNION ALL SELECT id, 'truncate', substr(content, 1, CAST(greatest(4, n // 2) AS BIGINT)), 6 FROM pi WHERE n > 6
    )"""


@plan("perturb_queries", f"""
WITH {perturb_sql("documents", "doc_id", "text")}
SELECT id, perturbation, query_text FROM perturbed
""")
def perturb_queries(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.perturb_queries(spread(_texts(Tables(spark, folder)), "id"), "id", "content")


def _search_eval_sql(store: str, sample: int) -> str:
    return f"""
WITH store AS ({store}),
truth AS (SELECT * FROM store ORDER BY md5('42:' || id), id LIMIT {sample}),
{perturb_sql("truth")},
asked AS (SELECT id * 8 + pno AS query_id, id AS gold, perturbation, query_text FROM perturbed),
{embed_sql('cvecs', 'store', 'id', 'content')},
{embed_sql('qvecs', 'asked', 'query_id', 'query_text')},
{vector_sql('qvecs', 'cvecs', 50)},
{keyword_sql('asked', 'store', 50)},
fused AS (
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM (
        SELECT v.query_id, v.id, 1.0::DOUBLE / (60 + v.r) + coalesce(1.0::DOUBLE / (60 + kw.r), 0) AS score
        FROM vec v LEFT JOIN kw ON kw.query_id = v.query_id AND kw.id = v.id
    )
),
hits AS (
    SELECT 'vector' AS strategy, query_id, id FROM vec WHERE r <= 10
    UNION ALL SELECT 'bm25', query_id, id FROM kw WHERE r <= 10
    UNION ALL SELECT 'rrf', query_id, id FROM fused WHERE r <= 10
),
marked AS (
    SELECT s.strategy, a.perturbation, h.id IS NOT NULL AS hit
    FROM asked a CROSS JOIN (SELECT unnest(['vector', 'bm25', 'rrf']) AS strategy) s
    LEFT JOIN hits h ON h.strategy = s.strategy AND h.query_id = a.query_id AND h.id = a.gold
)
SELECT strategy, perturbation, hits, total, round(hits / greatest(total, 1), 6) AS recall FROM (
    SELECT strategy, perturbation, count(*) FILTER (WHERE hit) AS hits, count(*) AS total FROM marked GROUP BY 1, 2
    UNION ALL
    SELECT strategy, '__overall__', count(*) FILTER (WHERE hit), count(*) FROM marked GROUP BY 1
)
"""


def _search_eval(texts: DataFrame, sample: int) -> DataFrame:
    store = stage(embedding.embed(spread(texts, "id"), "content", make_embedder), "eval-store")
    return evaluation.search_eval(store, make_embedder, sample=sample)


@plan("search_eval", _search_eval_sql("SELECT doc_id AS id, text AS content FROM documents", 200))
def search_eval(spark: SparkSession, folder: str) -> DataFrame:
    return _search_eval(_texts(Tables(spark, folder)), 200)


@plan("search_eval_names", _search_eval_sql("""
    SELECT p_partkey * 4 AS id, p_name AS content FROM part
    UNION ALL SELECT c_custkey * 4 + 1, c_name FROM customer
    UNION ALL SELECT s_suppkey * 4 + 2, s_name FROM supplier
""", 100))
def search_eval_names(spark: SparkSession, folder: str) -> DataFrame:
    """The same over a store of short names."""
    t = Tables(spark, folder)
    names = (
        t.part.select((F.col("p_partkey") * 4).alias("id"), F.col("p_name").alias("content"))
        .unionByName(t.customer.select((F.col("c_custkey") * 4 + 1).alias("id"), F.col("c_name").alias("content")))
        .unionByName(t.supplier.select((F.col("s_suppkey") * 4 + 2).alias("id"), F.col("s_name").alias("content")))
    )
    return _search_eval(names, 100)


@plan("sample_pct", """
SELECT doc_id, source FROM documents
WHERE ('0x' || substr(md5('42:' || doc_id), 1, 8))::BIGINT < CAST(floor(0.1 * 4294967296) AS BIGINT)
""")
def sample_pct(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.sample_pct(Tables(spark, folder).documents, 10, "doc_id").select("doc_id", "source")


@plan("stratified_sample", """
SELECT doc_id, source, lang FROM (
    SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY md5('42:' || doc_id), doc_id) AS n
    FROM documents WHERE text IS NOT NULL AND length(text) >= 8
) WHERE n <= 5 ORDER BY md5('42:' || doc_id), doc_id LIMIT 10000
""")
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = sampling.eligible(Tables(spark, folder).documents, "text").select("doc_id", "source", "lang")
    return sampling.stratified(rows, ["source", "lang"], "doc_id", 5, 10_000)


@plan("random_n", "SELECT doc_id, text FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 200")
def random_n(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.random_n(Tables(spark, folder).documents.select("doc_id", "text"), "doc_id", 200)


@plan("first_n", """
SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND length(text) >= 8 ORDER BY doc_id LIMIT 200
""")
def first_n(spark: SparkSession, folder: str) -> DataFrame:
    rows = sampling.eligible(Tables(spark, folder).documents.select("doc_id", "text"), "text")
    return sampling.first_n(rows, "doc_id", 200)
