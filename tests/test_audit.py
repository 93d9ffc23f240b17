"""The audit goes by block, whatever rule a feature declares."""

from datetime import datetime, timedelta

from stampline.operators import features as f

NOW = datetime(2024, 1, 1, 12)


def table(spark):
    late = NOW + timedelta(minutes=90)
    rows = [(i, NOW if i else None, 1.0, NOW, 2.0, late, 3.0 if i % 2 else None) for i in range(10)]
    return spark.createDataFrame(rows, "id long, index_time timestamp_ntz, early double, available_at__early timestamp_ntz, "
                                 "tardy double, available_at__tardy timestamp_ntz, bare double")


def audit(spark, registry):
    return {r.feature: r for r in f.leakage_audit(table(spark), registry, "index_time").collect()}


def test_a_late_rule_in_an_audited_block_is_reported(spark):
    got = audit(spark, [f.Feature("early", "acq_pre", "index"), f.Feature("tardy", "acq_pre", "window_close")])
    assert (got["tardy"].status, got["tardy"].late_rows, got["tardy"].max_late_minutes) == ("violation", 9, 90.0)
    assert (got["early"].status, got["early"].rows_checked) == ("ok", 9)


def test_values_without_a_stamp_column_count(spark):
    got = audit(spark, [f.Feature("bare", "acq_pre", "index")])
    assert (got["bare"].status, got["bare"].unstamped_values, got["bare"].rows_checked) == ("unstamped", 5, 0)


def test_a_dropped_feature_passes(spark):
    registry = [f.Feature("early", "acq_pre", "index"), f.Feature("gone", "acq_pre", "index", droppable=True)]
    out = f.leakage_audit(table(spark), registry, "index_time")
    assert {r.feature: r.status for r in out.collect()} == {"early": "ok", "gone": "dropped"}
    assert f.audit_summary(out).first().result == "PASS"
    leaky = f.leakage_audit(table(spark), [*registry, f.Feature("tardy", "acq_pre", "index")], "index_time")
    assert f.audit_summary(leaky).first().result == "FAIL"


def test_other_blocks_are_reported_apart(spark):
    registry = [f.Feature("early", "acq_pre", "window_close"), f.Feature("tardy", "acq_window", "index")]
    got = f.window_block_report(table(spark), registry, "index_time").collect()
    assert [(r.feature, r.late_rows, r.status) for r in got] == [("tardy", 9, "AFTER-INDEX")]
