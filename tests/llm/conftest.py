import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, keep string, fp string, key int, row int, bucket string, src string, id int, copies string, shard string, component int"
EXTRA = ("x", "y", "z", 1, 2, "b", "s", 3, "c", "h", 4)


def words(rng, n, pool=2000):
    return " ".join(f"w{rng.randrange(pool)}x" for _ in range(n))


@pytest.fixture(scope="session")
def awkward_rows():
    """Nulls, empty and blank texts, a very long one, repeated rows, ties, null ids."""
    rng = random.Random(1)
    long = words(rng, 60_000, 50_000)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "  \n\t ", "en", None, 5), (4, long, "en", "a", len(long)),
        (5, "!!! $$$ ???", "de", "b", 11), (6, "one", None, "b", 3), (7, words(rng, 300), "en", "b", 0), (7, None, "en", "b", 0),
        (None, words(rng, 40), "fr", "c", 0), (None, None, None, None, None), (9, "né à Zürich 漢字 😀", "fr", "c", 17), (10, "x" * 100_000, "en", "c", 1),
    ]
    same = words(rng, 200)
    rows += [(20 + i, same, "en", "a", len(same)) for i in range(4)]
    rows += [(30, same, "en", "a", len(same))] * 3
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in awkward_rows], DOCS).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
