import pytest

#: Columns of other tables and of the operators themselves, which rows may carry.
CLASHING = ("size", "fp", "row_key", "_range", "_key", "shard", "slot", "seq", "score", "target", "source_size", "_n", "spans")

ODD_TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and the cat is on the mat", "a"),
    (2, "the quick brown fox jumps over the lazy dog and the cat is on the mat", "a"),
    (3, "", "a"),
    (4, None, "b"),
    (5, " \t\n ", None),
    (6, "Ünïcode ▁ \x0b words joined 😀 idiot", "b"),
    (6, "Ünïcode ▁ \x0b words joined 😀 idiot", "b"),
    (None, "no id of mine at all, mail me at a.b@c.de or 10.0.0.256 10.0.0.1", None),
    (8, "x" * 20_000, "b"),
    (9, " ".join(f"w{i % 700}" for i in range(4_000)), "c"),
    (-10, "+12 345 678 901 and 4111 1111 1111 1111", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, clashing columns."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    schema += "".join(f", `{c}` string" for c in CLASHING)
    return spark.createDataFrame(
        [(i, t, "en", s, len(t or ""), *("?" for _ in CLASHING)) for i, t, s in ODD_TEXTS], schema
    )


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(small):
    return {r.doc_id: r.text for r in small.select("doc_id", "text").collect()}
