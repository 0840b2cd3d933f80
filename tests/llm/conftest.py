import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{FOLDER}/labels.parquet")


@pytest.fixture(scope="session")
def pages(spark):
    return spark.read.parquet(f"{FOLDER}/pages.parquet")


#: Nulls in every column, empty, blank and odd texts, repeated rows, ids that share a text and a text per id.
ODD = [
    (1, None, "en", "a", 0),
    (2, "", "en", "a", 0),
    (3, " \n\t ", None, None, None),
    (4, "one", "en", "b", 3),
    (5, "\x1f   é́ 日本語 \U0001f600 <|endoftext|>", "xx", "b", 1),
    (6, "the cat sat on the mat and looked at the dog for a while today", "en", "a", 60),
    (7, "the cat sat on the mat and looked at the dog for a while today", "en", "a", 60),
    (7, "the cat sat on the mat and looked at the dog for a while today", "en", "a", 60),
    (None, "the cat sat on the mat and looked at the dog for a while today", "en", None, 60),
    (None, "a text without an id that nobody else has at all", None, "c", 10),
    (9, "first of two texts with one id", "en", "c", 1),
    (9, "second of two texts with one id", "en", "c", 1),
    (-10, "x" * 5000, "en", "d", 5000),
    (2**60, "word " * 30_000, "en", "d", 150_000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASH = ("key", "bucket", "weight", "size", "rank", "row", "picks", "mark", "id", "label", "score", "_size", "_row", "_keep", "_source", "class_id")


def with_clashes(frame):
    return frame.withColumns({name: F.lit("clash") for name in CLASH})


@pytest.fixture(scope="session")
def odd(spark):
    return with_clashes(spark.createDataFrame(ODD, SCHEMA).repartition(3))


@pytest.fixture(scope="session")
def nothing(spark):
    return with_clashes(spark.createDataFrame([], SCHEMA))
