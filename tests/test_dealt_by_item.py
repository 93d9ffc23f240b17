"""Rows derived from an item are pooled, joined and folded where they are; predictions are not written out per seed."""

import importlib

import pytest
from pyspark.sql import functions as F

from stampline.operators import inference as inf
from stampline.plans import views as v
from stampline.plans.catalog import QUERIES
from stampline.plans.discrimination_queries import pooled


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pooling_and_joining_arms_shuffle_once(spark, sf):
    """Pooling five seeds and three arms shuffled every pooled row, and joining the arms did so again."""
    rows = inf.common_rows(pooled(spark, sf), ["ctx", "sig"], ["label"], "item_id", ["entity_id", "y"])
    dealt = [x for x in plan(rows).split("\n") if " Exchange " in x and "item_id" in x]
    assert len(dealt) == 1 and "REPARTITION_BY_NUM" in dealt[0]


def test_crops_meet_first_items_where_they_are(spark, monkeypatch):
    """Crops and records were put together and all shuffled to meet the first items."""
    seen = []

    def caught(rows, *_):
        seen.append(rows)
        raise StopIteration

    monkeypatch.setattr(inf, "entity_histogram", caught)
    crops = spark.range(40).selectExpr("id as item_id", "id % 5 as entity_id", "'a' as label", "int(id % 2) as y", "id / 40D as score") \
        .repartition(8, "item_id").withColumn("crop", F.explode(F.array(F.lit(0), F.lit(1))))
    first = spark.range(0, 40, 3).withColumnRenamed("id", "item_id")
    with pytest.raises(StopIteration):
        inf.unit_restriction_sensitivity(crops, first, "label", "item_id", "entity_id", 3)
    text = plan(seen[0])
    for line in text.split("\n"):
        assert not (" Exchange " in line and "score" in line)
    assert "ENSURE_REQUIREMENTS" not in text[:text.index("REPARTITION_BY_NUM")].split("Union")[-1]
    got = {(r.unit, r.restriction): r.n for r in seen[0].groupBy("unit", "restriction").agg(F.count("*").alias("n")).collect()}
    assert got == {("crop", "all"): 80, ("record", "all"): 40, ("crop", "first_of_episode"): 28, ("record", "first_of_episode"): 14}


@pytest.mark.parametrize("module,name", [
    ("inference_queries", "e25_noise_floor"), ("calibration_queries", "f12_net_benefit_at"),
    ("calibration_queries", "f5_ece_seed_spread"), ("arm_queries", "i2_cell_index"), ("arm_queries", "i1_contrast_panel")])
def test_predictions_of_all_seeds_are_not_written(spark, sf, monkeypatch, module, name):
    """45 rows per item went to the checkpoint folder."""
    written, home = [], importlib.import_module(f"stampline.plans.{module}")
    whole = home.pinned
    monkeypatch.setattr(home, "pinned", lambda df: written.append(df.columns) or whole(df))
    if name == "i1_contrast_panel":
        monkeypatch.setattr(home, "contrast_table", lambda pool: spark.createDataFrame(
            [], "arm_a string, arm_b string, label string, difference double, p_value double"))
    QUERIES[name](spark, sf)
    assert not [c for c in written if "item_id" in c]


def test_labels_by_item_are_the_labels(spark, sf):
    long = v.horizon_labels(spark, sf)
    assert long.columns == ["item_id", "entity_id", "label", "y"]
    assert long.groupBy("item_id").count().where("count != 3").count() == 0


def test_seed_spread_needs_no_row_per_entity(spark, sf):
    """The spread over seeds first grouped 45 rows per item by entity, and shuffled them."""
    text = plan(QUERIES["f12_net_benefit_at"](spark, sf))
    assert not [x for x in text.split("\n") if " Exchange " in x and "seed#" in x and "entity_id#" in x]
