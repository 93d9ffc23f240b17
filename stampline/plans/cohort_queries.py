"""Queries for cohort construction and its reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from stampline.functions.expr import micros, minutes_between
from stampline.functions.ordered import position
from stampline.operators import cohort as c
from stampline.plans import views as v
from stampline.plans.discrimination_queries import r
from stampline.plans.registry import query
from stampline.session import pinned

LABELS = ["h6", "h24", "h72"]


def labelled(spark, sf, seq=False):
    """Records with their wide labels; the cohort is a written table, which reports read often."""
    return pinned(v.records(spark, sf, seq).join(v.wide_labels(spark, sf), "item_id"))


@query("b1_canonicalise", """
select c_custkey as entity_id, c_name as name, try_cast(c_mktsegment as bigint) as segment_code,
       try_cast(c_nationkey as bigint) as nation, try_cast(c_acctbal as double) as balance from customer""")
def b1(spark, sf):
    out = c.canonicalise(
        v.table(spark, sf, "customer"),
        {"c_custkey": "entity_id", "c_name": "name", "c_mktsegment": "segment_code",
         "c_nationkey": "nation", "c_acctbal": "balance"},
        {"segment_code": "bigint", "nation": "bigint", "balance": "double"})
    return out.select("entity_id", "name", "segment_code", "nation", "balance")


@query("b2_assign_split", v.with_views("records", "select item_id, fold, split from records"))
def b2(spark, sf):
    return v.base_records(spark, sf).select("item_id", "fold", "split")


@query("b3_assert_range", v.with_views("records", """
select round(min(d), 6) as min_value, round(max(d), 6) as max_value,
       count(*) filter (d < 0 or d > 90) as violations
from (select (epoch_us(index_time) - epoch_us(intime)) / 6e7::double as d from records)"""))
def b3(spark, sf):
    out = c.assert_range(v.records(spark, sf), minutes_between("index_time", "intime"), 0, 90)
    return out.select(r("min_value"), r("max_value"), "violations")


@query("b4_superset_with_membership", """
select o_orderkey, o_custkey, o_orderdate, age::bigint as age, o_orderdate + interval 90 minute as window_close,
       o_orderkey in (select l_orderkey from lineitem join orders on o_orderkey = l_orderkey
                      where epoch_us(l_shipdate) - epoch_us(o_orderdate) between 0 and 90 * 86400000000) as in_cohort
from (select o_orderkey, o_custkey, o_orderdate,
             20 + c_nationkey + year(o_orderdate) - 1992 as age from orders join customer on c_custkey = o_custkey)
where age >= 30""")
def b4(spark, sf):
    orders = v.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    people = v.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), (F.lit(20) + F.col("c_nationkey")).alias("anchor_age"),
        F.lit(1992).alias("anchor_year"))
    ships = v.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    days = minutes_between("l_shipdate", "o_orderdate")
    member = ships.join(orders, "o_orderkey").where((days >= 0) & (days <= 90 * 1440))
    return c.superset_with_membership(orders, people, member, "o_custkey", "o_orderkey", "o_orderdate",
                                      "anchor_age", "anchor_year", 90, 30) \
        .select("o_orderkey", "o_custkey", "o_orderdate", "age", "window_close", "in_cohort")


@query("b5_label_prevalence", v.with_views("horizon_labels", """
select label, count(*) filter (y <> -999) as n_valid, count(*) filter (y = -999) as n_missing,
       count(*) filter (y = 1) as n_positive, round(avg(y) filter (y <> -999), 5) as prevalence,
       count(distinct entity_id) filter (y <> -999) as n_entities
from horizon_labels group by label"""))
def b5(spark, sf):
    return c.label_prevalence(labelled(spark, sf), LABELS, "entity_id")


@query("b6_split_disjointness", v.with_views("records", """
select k, count(distinct split) as n_splits from records group by k having count(distinct split) > 1"""))
def b6(spark, sf):
    """The k column crosses splits on purpose; entity_id never does (see the tests)."""
    return c.split_disjointness(v.base_records(spark, sf), "k", "split")


@query("b7_split_counts", v.with_views("records", "select split, count(*) as n_rows from records group by split"))
def b7(spark, sf):
    return c.split_counts(v.base_records(spark, sf), "split")


#: Declared counts to reconcile against (fixed values).
PUBLISHED = [("n_samples", 10020), ("n_entities", 150), ("n_episodes", 0), ("positives[h24]", 3400)]


@query("b8_reconcile_counts", v.with_views("wide_labels", """
select quantity, local, published, local - published as gap,
       case when published <> 0 then round(100.0::double * (local - published) / published, 4) end as pct
from l left join (values ('n_samples', 10020::bigint), ('n_entities', 150), ('n_episodes', 0),
                  ('positives[h24]', 3400)) p(quantity, published) using (quantity)""", """
l as (select 'n_samples' as quantity, count(*) as local from records
      union all select 'n_entities', count(distinct entity_id) from records
      union all select 'n_episodes', count(distinct episode_id) from records
      union all select 'positives[h6]', count(*) filter (h6 = 1) from wide_labels
      union all select 'positives[h24]', count(*) filter (h24 = 1) from wide_labels
      union all select 'positives[h72]', count(*) filter (h72 = 1) from wide_labels)"""))
def b8(spark, sf):
    local = c.local_counts(labelled(spark, sf), "entity_id", "episode_id", LABELS)
    return c.reconcile_counts(local, spark.createDataFrame(PUBLISHED, "quantity string, published bigint"))


@query("b9_cohort_reconciliation", v.with_views("wide_labels", """
select section, quantity, local, published, local - published as gap from l
left join (values ('cohort', 'records', 10020::bigint), ('positives', 'h24', 3400)) p(section, quantity, published)
using (section, quantity)""", """
t as (select * from records where split = 'test'),
l as (select 'cohort' as section, 'records' as quantity, count(*) as local from records
  union all select 'cohort', 'entities', count(distinct entity_id) from records
  union all select 'cohort', 'episodes', count(distinct episode_id) from records
  union all select 'positives', 'h6', count(*) filter (h6 = 1) from wide_labels
  union all select 'positives', 'h24', count(*) filter (h24 = 1) from wide_labels
  union all select 'positives', 'h72', count(*) filter (h72 = 1) from wide_labels
  union all select 'exclusions', 'h6', count(*) filter (h6 = -999) from wide_labels
  union all select 'exclusions', 'h24', count(*) filter (h24 = -999) from wide_labels
  union all select 'exclusions', 'h72', count(*) filter (h72 = -999) from wide_labels
  union all select 'split', split, count(*) from records group by split
  union all select 'test fold', 'records', count(*) from t
  union all select 'test fold', 'entities', count(distinct entity_id) from t
  union all select 'test fold', 'episodes', count(distinct episode_id) from t
  union all select 'first of episode', 'first records', count(*) filter (seq = 0) from t
  union all select 'first of episode', 'episodes among them', count(distinct episode_id) filter (seq = 0) from t
  union all select 'first of episode', 'tied episodes', count(*) from
    (select episode_id from t where seq = 0 group by episode_id having count(*) > 1)
  union all select 'first of episode', 'later records', count(*) filter (seq > 0) from t
  union all select 'sequence', 'numbered ' || seq, count(*) from t group by seq)"""))
def b9(spark, sf):
    published = spark.createDataFrame(
        [("cohort", "records", 10020), ("positives", "h24", 3400)],
        "section string, quantity string, published bigint")
    return c.cohort_reconciliation(labelled(spark, sf, True), published, "entity_id", "episode_id",
                                   "seq", "split", LABELS)


@query("b10_first_of_episode", v.with_views("records", """
select item_id, episode_id, seq, kept_rows, dropped_rows, episodes, tied_episodes
from s, (select count(*) filter (seq = 0) as kept_rows, count(*) filter (seq > 0) as dropped_rows,
                count(distinct episode_id) filter (seq = 0) as episodes from s),
        (select count(*) as tied_episodes from (select episode_id from s where seq = 0
                group by episode_id having count(*) > 1))
where seq = 0""", """
s as (select item_id, episode_id, rank() over (partition by episode_id order by date_trunc('hour', index_time)) - 1 as seq
      from records)"""))
def b10(spark, sf):
    """Sequence numbers by the hour, so some episodes tie at zero."""
    rec = v.base_records(spark, sf).select("item_id", "episode_id", "index_time")
    rec = pinned(position(rec, ["episode_id"], micros(F.date_trunc("hour", "index_time").cast("timestamp_ntz")),
                          name="seq"))
    counts = c.first_of_episode_counts(rec, "seq", "episode_id")
    return c.first_of_episode(rec, "seq").select("item_id", "episode_id", "seq").crossJoin(F.broadcast(counts))
