import pytest
from pyspark.sql import functions as F

#: Extra columns with the names that operators use inside.
CLASHES = ("id", "th", "row", "words", "spans", "score", "fp", "key", "at", "window", "item", "host_")


@pytest.fixture(scope="session")
def documents(spark):
    """Rows of (doc_id, text) as a table with clashing extra columns, some of them null."""

    def make(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.withColumns({name: F.lit(None).cast("string") if i % 2 else F.lit(7)
                               for i, name in enumerate(CLASHES)})

    return make


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words from a small generator."""
    import random

    def make(seed, n, syllables=("an", "ther", "on", "ou", "ing", "é", "ß", "sh")):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))

    return make
