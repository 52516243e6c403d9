import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """The smallest documents table and hostile rows: null, empty, repeated, tied and long texts."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = [
        (900001, None, None, None, None), (900002, "", "en", "s", 0), (900003, "   \n\t ", "en", "s", 6),
        (900004, "one  two▁three <|endoftext|> don't 漢字 é é ﬁ\x00 x", "en", "s", 1), (900005, "a b c d e f g h " * 3000, "en", "s", 48000),
        (900006, "same text here", "en", "s", 14), (900006, "same text here", "en", "s", 14), (900007, "SAME text here", None, "t", 14),
        (None, "no id " * 30, "en", "s", 180), (900008, "x" * 70000, "en", "s", 70000),
    ]
    return docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumns({"n_tokens": F.lit("clash"), "n_words": F.lit("clash")}).persist()
