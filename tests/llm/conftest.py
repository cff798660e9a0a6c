import pytest
from pyspark.sql import types as T

#: Columns that every operator must leave alone, named like columns it uses itself.
CLASHING = ["row", "run", "n", "v", "chunk", "bucket", "shard", "own", "id", "best", "label", "sha_", "own_", "gone"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) tuples, over several partitions."""

    def make(rows, parts=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, *["x"] * len(CLASHING)) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts) if full else spark.createDataFrame([], SCHEMA)

    return make


def prose(seed, words, vocabulary=400):
    """Repeatable words separated by single spaces."""
    import random

    pick = random.Random(seed)
    return " ".join("w" + format(pick.randrange(vocabulary), "x") for _ in range(words))
