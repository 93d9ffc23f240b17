"""Model arms on awkward splits and wide categories."""

import pytest
from pyspark.sql import functions as F

from stampline.operators import arms as g
from stampline.operators.cohort import first_of_episode_counts


@pytest.fixture(scope="module")
def matrix(spark):
    return spark.range(240).select(
        F.col("id"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 7 + F.col("id") % 2).cast("double").alias("x"),
        F.concat(F.lit("c"), (F.col("id") % 80).cast("string")).alias("kind"),
        F.when(F.col("id") % 4 == 0, "test").otherwise("train").alias("split"))


def test_without_a_validation_split(spark, matrix):
    model = g.fit_gbt_arm(matrix, "y", ["x"], ["kind"], "split", max_iter=2)
    out = g.predict(model, matrix.where("split = 'test'"), "y", ["x"], ["kind"], ["id"])
    assert out.where("score between 0 and 1").count() == 60
    search = g.random_search(matrix, "y", ["x"], [], "split", 1, max_iter=1).collect()
    assert [(r.val_auroc, r.best) for r in search] == [(None, False)]


def test_no_rows_no_first_episodes(spark):
    none = spark.createDataFrame([], "episode long, seq long")
    assert tuple(first_of_episode_counts(none, "seq", "episode").first()) == (0, 0, 0, 0)
