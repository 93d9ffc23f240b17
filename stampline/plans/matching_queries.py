"""Queries for matching and balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from stampline.functions.expr import minutes_between
from stampline.operators import matching as m
from stampline.operators.cohort import superset_with_membership
from stampline.operators.features import calendar_parts, elapsed_minutes
from stampline.plans import views as v
from stampline.plans.discrimination_queries import r
from stampline.plans.registry import query
from stampline.session import pinned

LABELS = ["h6", "h24", "h72"]
KEY = ["delay_bucket", "hour_bucket", "is_weekend", "acuity_level"]


def coarse_records(spark, sf):
    rec = calendar_parts(elapsed_minutes(v.records(spark, sf), "index_time", "intime"), "index_time")
    return m.stratum_key(m.coarsen(rec), KEY)


def matched_rows(spark, sf):
    """Coarsened records with their labels, as the written table the matching stage reads."""
    return pinned(coarse_records(spark, sf).join(v.wide_labels(spark, sf), "item_id"))


COARSE = """
cr0 as (select *, (epoch_us(index_time) - epoch_us(intime)) / 6e7::double as delay_minutes,
              hour(index_time) as hour_of_day, isodow(index_time) as day_of_week from records),
cr as (select *, delay_bucket || '|' || hour_bucket || '|' || is_weekend || '|' || acuity_level as stratum from (
  select *, case when delay_minutes <= 15 then '<=15' when delay_minutes <= 30 then '15-30'
                 when delay_minutes <= 60 then '30-60' else '>60' end as delay_bucket,
         case when hour_of_day < 6 then 'night' when hour_of_day < 12 then 'morning'
              when hour_of_day < 18 then 'afternoon' else 'evening' end as hour_bucket,
         (day_of_week >= 6)::int as is_weekend, coalesce(acuity::varchar, '-1') as acuity_level from cr0))"""
ML = COARSE + """,
ml as (select cr.item_id, cr.entity_id, stratum, delay_bucket, hour_bucket, is_weekend, acuity_level,
              delay_minutes, hour_of_day, value, label, y from cr join horizon_labels l using (item_id))"""
SL = ML + """,
sl as (select stratum, label, count(*) filter (y = 1) as n_pos, count(*) filter (y = 0) as n_neg
       from ml group by stratum, label)"""


@query("d1_coarsen", v.with_views("records", """
select item_id, delay_bucket, hour_bucket, is_weekend, acuity_level from cr""", COARSE))
def d1(spark, sf):
    return coarse_records(spark, sf).select("item_id", "delay_bucket", "hour_bucket", "is_weekend", "acuity_level")


@query("d2_stratum_key", v.with_views("records", """
select item_id, stratum, hour_bucket || '|' || is_weekend as stratum_calendar from cr""", COARSE))
def d2(spark, sf):
    out = m.stratum_key(coarse_records(spark, sf), ["hour_bucket", "is_weekend"], "stratum_calendar")
    return out.select("item_id", "stratum", "stratum_calendar")


@query("d3_strata_table", v.with_views("horizon_labels", """
select stratum, n_records, n_entities, """ + ", ".join(
    f"max(n_pos) filter (label = '{c}') as n_pos__{c}, max(n_neg) filter (label = '{c}') as n_neg__{c}, "
    f"max(n_pos::double * n_neg) filter (label = '{c}') as n_pairs__{c}" for c in LABELS) + """
from sl join (select stratum, count(*) as n_records, count(distinct entity_id) as n_entities from cr group by stratum)
using (stratum) group by stratum, n_records, n_entities""", SL))
def d3(spark, sf):
    return m.strata_table(matched_rows(spark, sf), LABELS, "stratum", "entity_id")


@query("d4_strata_size_summary", v.with_views("records", """
select count(*) as n_strata, quantile_cont(n, 0.5)::double as median_size, max(n) as max_size,
       sum(n) filter (n >= 10)::bigint as rows_in_large
from (select stratum, count(*) as n from cr group by stratum)""", COARSE))
def d4(spark, sf):
    return m.strata_size_summary(coarse_records(spark, sf), "stratum")


@query("d5_effective_sample", v.with_views("horizon_labels", """
select label, (select count(distinct stratum) from cr) as n_strata_total, n_strata_informative, n_records_defined,
       n_records_informative, n_entities_defined, n_entities_effective, n_within_pairs, n_all_pairs,
       round(n_within_pairs::double / n_all_pairs, 6) as pair_retention
from (select label, count(*) filter (n_pos > 0 and n_neg > 0) as n_strata_informative,
             sum(n_pos::double * n_neg) as n_within_pairs, sum(n_pos)::double * sum(n_neg)::double as n_all_pairs
      from sl group by label)
join (select ml.label, count(*) as n_records_defined, count(*) filter (n_pos > 0 and n_neg > 0) as n_records_informative,
             count(distinct entity_id) as n_entities_defined,
             count(distinct entity_id) filter (n_pos > 0 and n_neg > 0) as n_entities_effective
      from ml join sl on sl.stratum = ml.stratum and sl.label = ml.label where y <> -999 group by ml.label) using (label)""", SL))
def d5(spark, sf):
    return m.effective_sample(matched_rows(spark, sf), LABELS, "stratum", "entity_id") \
        .withColumn("pair_retention", F.round("pair_retention", 6))


@query("d6_pair_weights", v.with_views("horizon_labels", """
select item_id, stratum, y, case when y = 1 then count(*) filter (y = 0) over w
                                 when y = 0 then count(*) filter (y = 1) over w end as pair_weight
from ml where label = 'h24' and y <> -999 window w as (partition by stratum)""", ML))
def d6(spark, sf):
    rows = matched_rows(spark, sf).where(F.col("h24") != -999).withColumnRenamed("h24", "y")
    return m.pair_weights(rows, "y", "stratum").select("item_id", "stratum", "y", "pair_weight")


PW = ML + """,
pw as (select *, case when y = 1 then count(*) filter (y = 0) over w else count(*) filter (y = 1) over w end as pwt
       from ml where y <> -999 window w as (partition by label, stratum))"""
SMD = """case when sqrt((v1 + v0) / 2) > 0 then (m1 - m0) / sqrt((v1 + v0) / 2) when abs(m1 - m0) < 1e-12 then 0.0
         when m1 - m0 is not null then 'inf'::double end"""


def smd_sql(source: str, keys: str, w: str) -> str:
    mu = "sum({w} * x) filter (y = {c}) / nullif(sum({w}) filter (y = {c}), 0)"
    return f"""(select {keys}, m1, m0,
  sum({w} * (x - m1) * (x - m1)) filter (y = 1) / nullif(sum({w}) filter (y = 1), 0) as v1,
  sum({w} * (x - m0) * (x - m0)) filter (y = 0) / nullif(sum({w}) filter (y = 0), 0) as v0
from {source} join (select {keys}, {mu.format(w=w, c=1)} as m1, {mu.format(w=w, c=0)} as m0
                    from {source} group by {keys}) using ({keys}) group by {keys}, m1, m0)"""


@query("d7_weighted_smd", v.with_views("horizon_labels", f"""
select label, round(a.before, 6) as smd_before, round(b.after, 6) as smd_after
from (select label, {SMD} as before from {smd_sql('xs', 'label', '1.0')}) a
join (select label, {SMD} as after from {smd_sql('xs', 'label', 'pwt')}) b using (label)""",
       PW + ", xs as (select label, y, pwt::double as pwt, value as x from pw)"))
def d7(spark, sf):
    long = matched_rows(spark, sf).unpivot(["item_id", "stratum", "value"], LABELS, "label", "y") \
        .where(F.col("y") != -999)
    rows = m.pair_weights(long, "y", "stratum", ["label"])
    out = m.weighted_smd(rows, "value", "y", {"smd_before": None, "smd_after": "pair_weight"}, ["label"])
    return out.select("label", r("smd_before"), r("smd_after"))


_LEVELS = " union all ".join(
    f"select label, y, pwt::double as pwt, '{c}' as variable, lv.level as level, 'coarsened' as scale, true as held_fixed, "
    f"({c}::varchar = lv.level)::int::double as x from pw, (select distinct {c}::varchar as level from pw) lv"
    for c in KEY)
_RAW = " union all ".join(
    f"select label, y, pwt::double, '{c}', '(continuous)', 'underlying', {h}, {c}::double from pw"
    for c, h in (("delay_minutes", "true"), ("hour_of_day", "true"), ("value", "false")))
_BK = "label, variable, level, scale, held_fixed"


@query("d8_balance_table", v.with_views("horizon_labels", f"""
select {_BK}, round(b1, 6) as smd_before, case when abs(b2) < 1e-9 then 0.0::double else round(b2, 6) end as smd_after
from (select {_BK}, {SMD} as b1 from {smd_sql('xs', _BK, '1.0')})
join (select {_BK}, {SMD} as b2 from {smd_sql('xs', _BK, 'pwt')}) using ({_BK})""",
       PW + f", xs as ({_LEVELS} union all {_RAW})"))
def d8(spark, sf):
    out = m.balance_table(
        matched_rows(spark, sf), LABELS,
        {"delay_minutes": "delay_bucket", "hour_of_day": "hour_bucket", "day_of_week": "is_weekend",
         "acuity": "acuity_level"}, ["delay_minutes", "hour_of_day", "value"], "stratum")
    after = F.when(F.abs("smd_after") < 1e-9, 0.0).otherwise(F.round("smd_after", 6))
    return out.select("label", "variable", "level", "scale", "held_fixed", r("smd_before"), after.alias("smd_after"))


@query("d9_availability_propensity", """
with sup as (
  select o_orderkey in (select l_orderkey from lineitem join orders on o_orderkey = l_orderkey
                        where epoch_us(l_shipdate) - epoch_us(o_orderdate) between 0 and 90 * 86400000000) as in_cohort,
         o_custkey, 20 + c_nationkey + year(o_orderdate) - 1992 as age
  from orders join customer on c_custkey = o_custkey)
select true as auroc_in_range, round(avg(in_cohort::int), 6) as base_rate, count(*)::bigint as n_held_out
from sup where age >= 18 and ('0x' || substr(md5('0|holdout|' || o_custkey), 1, 8))::bigint / 4294967296.0::double < 0.2""")
def d9(spark, sf):
    """Which orders ship early, told from order context alone.

    SQL knows the hold-out and its rate; of the AUROC it knows the range.
    """
    orders = v.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    people = v.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), (F.lit(20) + F.col("c_nationkey")).alias("anchor_age"),
        F.lit(1992).alias("anchor_year"))
    ships = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    days = minutes_between("l_shipdate", "o_orderdate")
    member = ships.join(orders, "o_orderkey").where((days >= 0) & (days <= 90 * 1440))
    sup = superset_with_membership(orders, people, member, "o_custkey", "o_orderkey", "o_orderdate",
                                   "anchor_age", "anchor_year", 90, 18)
    sup = calendar_parts(sup, "o_orderdate")
    out = m.availability_propensity(sup, "in_cohort", ["age", "hour_of_day", "day_of_week", "month"],
                                    ["o_orderpriority"], "o_custkey")
    return out.select(F.coalesce(F.col("auroc").between(0, 1), F.lit(False)).alias("auroc_in_range"),
                      F.round("base_rate", 6).alias("base_rate"), F.col("n_held_out").cast("bigint").alias("n_held_out"))
