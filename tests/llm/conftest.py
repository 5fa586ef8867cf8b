import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pandas()


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null keys, texts, languages and sources, empty and blank texts, repeats, a long text, and clashing column names."""
    rows = [
        (1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (None, "a b c d", "en", "s", 7), (None, "zz yy xx ww", None, None, None),
        (None, "zz yy xx ww", None, None, None), (2, None, None, None, None), (3, "", "en", "s", 0), (4, " \n\t ", "fr", None, 4),
        (None, None, None, None, None), (5, "word " * 60_000, "en", "s", 300_000), (6, "x" * 200_000, "en", "t", 200_000), (7, "1 2 3 4", "xx", "t", 7),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return frame.selectExpr("*", "1 as score", "2 as label", "'k' as fingerprint", "3 as size", "4 as mark", "5 as bucket", "6 as node", "7 as token", "8 as place")


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.filter("false")
