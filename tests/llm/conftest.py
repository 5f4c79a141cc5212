import pytest


@pytest.fixture()
def edge_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and extra columns of clashing names."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "src0", 43),
        (1, "the quick brown fox jumps over the lazy dog", "en", "src0", 43),
        (2, "", "en", "src0", 0),
        (3, None, None, None, None),
        (None, "a text without a number of its own", "en", "src1", 34),
        (4, "word " * 9000, "en", "src0", 45000),
        (5, "ünï çödé 12\t34\n\n x", "de", "src1", 18),
        (6, "the quick brown fox jumps over the lazy dog", "en", "src2", 43),
    ]
    base = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    extra = ["score", "block", "shard", "rank", "n", "k", "length", "start", "value", "id"]
    return base.selectExpr("*", *[f"'clash' AS {c}" for c in extra])


@pytest.fixture()
def no_docs(edge_docs):
    return edge_docs.where("false")
