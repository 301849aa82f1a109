import pytest

EXTRA = "size int, h string, fp int, node int, shard string, slot int, cut int, times int, source string, lang string, score double, bucket int, guest int, words int, hot int, key int"


def odd(spark, rows):
    """Rows of (doc_id, text) with extra columns whose names the operators use themselves."""
    full = [(i, t, 1, "x", 2, 3, "y", 4, 5, 6, f"s{i % 3}" if i is not None and i % 4 else None, "en" if i is not None and i % 2 else "de", 0.5, 7, 8, 9, 10, 11) for i, t in rows]
    return spark.createDataFrame(full, f"doc_id bigint, text string, {EXTRA}")


LONG = " ".join(f"word{i % 997}" for i in range(30_000))
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, LONG), (6, "same text in two rows here"), (7, "same text in two rows here"), (7, "same text in two rows here"), (8, "é ü 漢字 <|im_end|> 😀"), (9, "!!! ??? 123")]


@pytest.fixture
def odd_docs(spark):
    return odd(spark, ROWS)


@pytest.fixture
def no_docs(spark):
    return odd(spark, [])


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
