"""A training corpus from ``documents``: five stages, each working on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import mixing, pieces, pii, simhash, toxicity
from lodestone.session import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows that agree in both are equal in all columns.
ROW = ("_id", "_name")


def name_rows(docs: DataFrame) -> DataFrame:
    """The columns and two that tell rows apart, neither ever null: the id, 0 if there is none, and a hash of the row."""
    # A hash skips nulls, so it also takes where they are.
    name = F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS))
    return docs.select(*COLUMNS, F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("_id"), name.alias("_name"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, fitted on the labels, does not call toxic."""
    read = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(read, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs.select(*COLUMNS), model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies, that with the smallest id.

    Rows that repeat an id are documents of their own if their texts differ, and so are rows without an id, which come
    after all others. Of rows with one id in one group, that with the least hash stays.
    """
    rows = name_rows(docs)
    least = simhash.least_of_components(rows, "_name")
    kept = least.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("_id"), F.col("name").alias("_name"))
    # Both steps deal the texts out by the same columns, which takes one shuffle.
    return rows.dropDuplicates(ROW).join(kept, [*ROW], "left_semi").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with the personal data in its text replaced by what it is."""
    return pii.redact(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Ids can repeat or be missing, and redaction can make rows equal. One of equal rows meets the numbers of copies of
    all of them.
    """
    rows = name_rows(docs)
    mixed = mixing.mix(rows, name="_name").where("copies > 0")
    copies = mixed.select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("_id"), F.col("name").alias("_name"), "copies")
    joined = rows.dropDuplicates(ROW).join(copies, [*ROW])
    return joined.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_n")).drop("_n")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of every document of the mix."""
    return pieces.encode(docs.select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: Trained models, graphs and random draws are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, so a lost executor costs one stage at most."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
