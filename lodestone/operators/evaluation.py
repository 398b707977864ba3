"""Search-quality and response-quality evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import PERTURBATIONS, perturbations
from lodestone.operators.embedding import embed
from lodestone.operators.hybrid import DEPTH, fuse, reciprocal
from lodestone.operators.keyword import match_rank
from lodestone.operators.knn import knn
from lodestone.operators.sampling import random_n
from lodestone.session import stage

OVERALL = "__overall__"
STRATEGIES = ("vector", "bm25", "rrf")


def perturb_queries(rows: DataFrame, id_col: str, content: str, seed: int = 42) -> DataFrame:
    """(id, perturbation, query_text), the variants of each row."""
    rows = rows.select(F.col(id_col).alias("id"), F.col(content).alias("content"))
    made = F.explode(perturbations(F.col("content"), F.col("id"), seed))
    return rows.select("id", made.alias("p")).select("id", "p.perturbation", "p.query_text")


def recall(hits: DataFrame, hit: str = "hit") -> DataFrame:
    """(strategy, perturbation, hits, total, recall) with an overall row per strategy."""
    return (
        hits.groupingSets([["strategy", "perturbation"], ["strategy"]], "strategy", "perturbation")
        .agg(
            F.count_if(F.col(hit)).alias("hits"),
            F.count("*").alias("total"),
            F.grouping("perturbation").alias("_all"),
        )
        .select(
            "strategy",
            F.when(F.col("_all") == 1, OVERALL).otherwise(F.col("perturbation")).alias("perturbation"),
            "hits", "total",
            F.round(F.col("hits") / F.greatest("total", F.lit(1)), 6).alias("recall"),
        )
    )


def search_eval(
    store: DataFrame,
    make_embedder: Callable,
    sample: int = 200,
    k: int = 10,
    seed: int = 42,
    language: str = "simple",
    vectors=knn,
) -> DataFrame:
    """Recall at ``k`` per strategy and perturbation over a drawn sample of the store.

    The three strategies come from one nearest-neighbour and one keyword pass over
    the store: the single lists are the first ``k`` of the lists that are fused.
    """
    truth = random_n(store.select("id", "content"), "id", sample, seed)
    cores = store.sparkSession.sparkContext.defaultParallelism
    asked = (
        perturb_queries(truth.repartition(min(cores, max(1, sample // 8)), "id"), "id", "content", seed)
        .withColumnRenamed("id", "gold")
        .withColumn("query_id", F.col("gold") * 8 + _perturbation_number("perturbation"))
    )
    asked = stage(embed(asked, "query_text", make_embedder), "eval-queries")
    depth = max(DEPTH, k)
    near = vectors(asked.select("query_id", "embedding"), store.select("id", "embedding"), depth)
    words = match_rank(asked, store.select("id", "content"), depth, language=language)
    lists = fuse(near, words, "full")

    # Fusion takes the first DEPTH of each list and drops rows that only the keyword list
    # has; those sort after all others here.
    by_vector, by_keyword = F.col("vector_rank"), F.col("keyword_rank")
    in_fusion = F.coalesce(by_vector <= DEPTH, F.lit(False))
    score = reciprocal(by_vector) + reciprocal(F.when(by_keyword <= DEPTH, by_keyword))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(~in_fusion, score.desc(), "id"))
    ranked = lists.select(
        "query_id", F.col("id").alias("gold"), by_vector, by_keyword, F.when(in_fusion, place).alias("rrf_rank")
    )
    gold = asked.select("query_id", "gold", "perturbation")
    found = gold.join(ranked, ["query_id", "gold"], "left")
    return recall(
        found.select(
            "perturbation",
            F.explode(
                F.array(
                    *[
                        F.struct(F.lit(s).alias("strategy"), F.coalesce(F.col(r) <= k, F.lit(False)).alias("hit"))
                        for s, r in zip(STRATEGIES, ("vector_rank", "keyword_rank", "rrf_rank"), strict=True)
                    ]
                )
            ).alias("s"),
        ).select("s.strategy", "s.hit", "perturbation")
    )


def _perturbation_number(column: str) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in PERTURBATIONS]), F.col(column)) - 1


EXPECT = T.StructType(
    [
        T.StructField("sql_starts_with", T.StringType()),
        T.StructField("row_count_eq", T.LongType()),
        T.StructField("row_count_min", T.LongType()),
        T.StructField("sql_contains_any", T.ArrayType(T.StringType())),
        T.StructField("sql_contains_any_2", T.ArrayType(T.StringType())),
        T.StructField("answer_contains_any", T.ArrayType(T.StringType())),
        T.StructField("answer_must_not_contain", T.ArrayType(T.StringType())),
        T.StructField("sql_must_be_select_or_null", T.BooleanType()),
    ]
)


def _any_in(needles: Column, text: Column) -> Column:
    return F.exists(needles, lambda n: F.contains(text, n))


def _listed(values: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(values, "', '"), F.lit("']"))


def score_responses(fixtures: DataFrame, responses: DataFrame) -> DataFrame:
    """(id, status, ok, notes): each fixture's rules checked against the response with its id.

    ``fixtures`` holds id and ``expect`` (see ``EXPECT``); ``responses`` id, sql, answer
    and row_count. A rule that is absent is not checked. A fixture without a response
    has status ``error``.
    """
    answers = responses.select(
        "id",
        F.trim(F.coalesce("sql", F.lit(""))).alias("sql"),
        F.trim(F.coalesce("answer", F.lit(""))).alias("answer"),
        F.col("row_count").cast("long").alias("row_count"),
        F.lit(True).alias("answered"),
    )
    e, sql, answer, rows = (F.col(c) for c in ("expect", "sql", "answer", "row_count"))
    shown = F.coalesce(rows.cast("string"), F.lit("None"))
    rules = [
        F.when(
            e["sql_starts_with"].isNotNull() & ~F.startswith(F.upper(sql), F.upper(e["sql_starts_with"])),
            F.concat(F.lit("sql does not start with '"), e["sql_starts_with"], F.lit("'")),
        ),
        F.when(
            e["row_count_eq"].isNotNull() & ~rows.eqNullSafe(e["row_count_eq"]),
            F.concat(F.lit("row_count="), shown, F.lit(", expected "), e["row_count_eq"].cast("string")),
        ),
        F.when(
            e["row_count_min"].isNotNull() & (rows.isNull() | (rows < e["row_count_min"])),
            F.concat(F.lit("row_count="), shown, F.lit(", expected >= "), e["row_count_min"].cast("string")),
        ),
        *[
            F.when(
                e[name].isNotNull() & ~_any_in(e[name], sql),
                F.concat(F.lit("sql missing any of "), _listed(e[name])),
            )
            for name in ("sql_contains_any", "sql_contains_any_2")
        ],
        F.when(
            e["answer_contains_any"].isNotNull()
            & ~_any_in(F.transform(e["answer_contains_any"], F.lower), F.lower(answer)),
            F.concat(F.lit("answer missing any of "), _listed(e["answer_contains_any"])),
        ),
    ]
    both = F.lower(F.concat(answer, F.lit(" "), sql))
    forbidden = F.transform(
        F.filter(
            F.coalesce(e["answer_must_not_contain"], F.expr("CAST(array() AS array<string>)")),
            lambda n: F.contains(both, F.lower(n)),
        ),
        lambda n: F.concat(F.lit("forbidden token in output: "), n),
    )
    opening = F.ltrim(F.upper(sql), F.lit("("))
    not_select = F.when(
        F.coalesce(e["sql_must_be_select_or_null"], F.lit(False))
        & (sql != "") & ~F.startswith(opening, F.lit("SELECT")) & ~F.startswith(opening, F.lit("WITH")),
        F.concat(F.lit("non-SELECT sql executed: '"), F.substring(sql, 1, 60), F.lit("'")),
    )
    notes = F.array_compact(F.concat(F.array(*rules), forbidden, F.array(not_select)))
    none = F.expr("CAST(array() AS array<string>)")
    return (
        fixtures.select("id", "expect")
        .join(answers, "id", "left")
        .withColumn("notes", F.when(F.col("answered"), notes).otherwise(none))
        .withColumn("ok", F.coalesce(F.col("answered"), F.lit(False)) & (F.size("notes") == 0))
        .select(
            "id",
            F.when(F.col("answered").isNull(), "error").when(F.col("ok"), "pass").otherwise("fail").alias("status"),
            "ok", "notes",
        )
    )


def tally(scored: DataFrame) -> DataFrame:
    """One row: pass, fail, error."""
    return scored.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("pass", "fail", "error")])
