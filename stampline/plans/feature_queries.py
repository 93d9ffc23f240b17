"""Queries for point-in-time features, stamps, the audit and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from stampline.operators import features as f
from stampline.plans import views as v
from stampline.plans.discrimination_queries import r
from stampline.plans.registry import query

REGISTRY = [
    f.Feature("delay_minutes", "acq_pre", "index"),
    f.Feature("hour_of_day", "acq_pre", "index"),
    f.Feature("day_of_week", "acq_pre", "index"),
    f.Feature("prior_exists", "acq_pre", "index"),
    f.Feature("days_since_prior", "acq_pre", "index"),
    f.Feature("acuity", "demographics", "arrival"),
    f.Feature("paced", "acq_pre", "index", droppable=True),
    f.Feature("episode_rows", "acq_window", "window_close"),
    f.Feature("mean_gap_minutes", "acq_window", "window_close"),
    f.Feature("acuity_late", "acq_window", "index"),
    f.Feature("late_marker", "acq_window", "window_close", droppable=True),
]
RULES = {"index": "index_time", "arrival": "intime", "window_close": "window_close"}
DROPPED = ["paced", "late_marker", "acuity_late"]


def purchases(spark, sf):
    ev = v.base_records(spark, sf)
    return ev.where(F.col("event_type") == "purchase").select("entity_id", F.col("index_time").alias("buy_time"))


def featured(spark, sf):
    """Records with every declared feature that exists, and its stamp."""
    rec = v.records(spark, sf)
    rec = f.calendar_parts(f.elapsed_minutes(rec, "index_time", "intime"), "index_time")
    rec = f.asof_prior(rec, purchases(spark, sf), ["entity_id"], "index_time", "buy_time")
    rec = f.episode_window_stats(rec, "episode_id", "index_time")
    return f.stamp_availability(rec, REGISTRY, RULES, DROPPED)


FEATURED = """
prior as (select r.item_id, max(p.index_time) as prior_time from records r
          left join records p on p.entity_id = r.entity_id and p.event_type = 'purchase'
               and p.index_time < r.index_time group by r.item_id),
gaps as (select episode_id, avg(g) as mean_gap, count(*) as episode_rows from (
           select episode_id, (epoch_us(index_time) - epoch_us(lag(index_time) over
             (partition by episode_id order by index_time))) / 6e7::double as g from records)
         group by episode_id),
feat as (select r.*, (epoch_us(index_time) - epoch_us(intime)) / 6e7::double as delay_minutes,
                prior_time, prior_time is not null as prior_exists,
                (epoch_us(index_time) - epoch_us(prior_time)) / 8.64e10::double as days_since_prior,
                episode_rows, mean_gap
         from records r join prior using (item_id) join gaps using (episode_id))"""


@query("c1_elapsed_minutes", v.with_views("records", """
select item_id, round((epoch_us(index_time) - epoch_us(intime)) / 6e7::double, 9) as delay_minutes from records"""))
def c1(spark, sf):
    return f.elapsed_minutes(v.records(spark, sf), "index_time", "intime").select("item_id", F.round("delay_minutes", 9).alias("delay_minutes"))


@query("c2_calendar_parts", v.with_views("records", """
select item_id, hour(index_time)::int as hour_of_day, isodow(index_time)::int as day_of_week,
       month(index_time)::int as month from records"""))
def c2(spark, sf):
    return f.calendar_parts(v.base_records(spark, sf), "index_time") \
        .select("item_id", "hour_of_day", "day_of_week", "month")


@query("c3_asof_prior", v.with_views("records", """
select r.item_id, p.index_time as prior_time, p.index_time is not null as prior_exists,
       round((epoch_us(r.index_time) - epoch_us(p.index_time)) / 8.64e10::double, 6) as days_since_prior
from records r asof left join (select * from records where event_type = 'purchase') p
on r.entity_id = p.entity_id and r.index_time > p.index_time"""))
def c3(spark, sf):
    out = f.asof_prior(v.base_records(spark, sf), purchases(spark, sf), ["entity_id"], "index_time", "buy_time")
    return out.select("item_id", "prior_time", "prior_exists", r("days_since_prior"))


@query("c4_prior_event_count", """
select o_orderkey, rank() over (partition by o_custkey order by o_orderdate) - 1 as prior_count from orders""")
def c4(spark, sf):
    orders = v.table(spark, sf, "orders")
    return f.prior_event_count(orders, "o_custkey", "o_orderdate").select("o_orderkey", "prior_count")


@query("c4_prior_event_count_cumcount", """
select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as prior_count
from orders""")
def c4_cumcount(spark, sf):
    orders = v.table(spark, sf, "orders")
    return f.prior_event_count(orders, "o_custkey", "o_orderdate", "cumcount", ["o_orderkey"]) \
        .select("o_orderkey", "prior_count")


@query("c5_episode_window_stats", v.with_views("records", """
select item_id, episode_rows, round(mean_gap, 3) as mean_gap_minutes from feat""", FEATURED))
def c5(spark, sf):
    return f.episode_window_stats(v.base_records(spark, sf), "episode_id", "index_time") \
        .select("item_id", "episode_rows", F.round("mean_gap_minutes", 3).alias("mean_gap_minutes"))


def line_starts(spark, sf):
    return v.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("start"),
        F.col("l_returnflag").alias("ward"),
        (F.col("l_shipdate") + F.expr("INTERVAL 10 DAYS")).alias("stop"))


@query("c6_covering_latest", """
select o_orderkey, coalesce(arg_max(l_returnflag, struct_pack(t := l_shipdate, f := l_returnflag)), 'none') as unit
from orders left join lineitem on l_orderkey = o_orderkey and l_shipdate <= o_orderdate group by o_orderkey""")
def c6(spark, sf):
    orders = v.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return f.covering_latest(orders, line_starts(spark, sf), ["o_orderkey"], "o_orderdate", "start", "ward", "none") \
        .select("o_orderkey", "unit")


@query("c6_covering_latest_with_end", """
select o_orderkey, case when max(l_shipdate) + interval 10 day >= any_value(o_orderdate)
         then arg_max(l_returnflag, struct_pack(t := l_shipdate, f := l_returnflag)) else 'none' end as unit
from orders left join lineitem on l_orderkey = o_orderkey and l_shipdate <= o_orderdate group by o_orderkey""")
def c6_end(spark, sf):
    orders = v.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return f.covering_latest(orders, line_starts(spark, sf), ["o_orderkey"], "o_orderdate", "start", "ward", "none",
                             end="stop").select("o_orderkey", "unit")


MARKERS = ["license", "copyright", "password", "@example", "lorem"]
_MARK = " or ".join(f"contains(lower(coalesce({{0}}, '')), '{m}')" for m in MARKERS)


@query("c7_marker_probe", v.with_views("", """
select "column", round(rate, 6) as rate, rate between 0.01 and 0.99 as usable,
       coalesce(i = min(case when rate between 0.01 and 0.99 then i end) over (), false) as chosen,
       case when rate between 0.01 and 0.99 then 'usable' else 'degenerate' end as status
from p""", f"""
p as (select 'lang' as "column", 0 as i, avg(case when {_MARK.format('lang')} then 1.0 else 0.0 end) as rate from documents
      union all select 'source', 1, avg(case when {_MARK.format('source')} then 1.0 else 0.0 end) from documents
      union all select 'text', 2, avg(case when {_MARK.format('text')} then 1.0 else 0.0 end) from documents)"""))
def c7(spark, sf):
    docs = v.table(spark, sf, "documents")
    return f.marker_probe(docs, ["lang", "source", "text", "report_17"], MARKERS) \
        .select("column", r("rate"), "usable", "chosen", "status")


@query("c8_marker_flag", f"""
select k.doc_id, coalesce({_MARK.format('d.text')}, false) as marker
from documents k left join (select * from documents where doc_id in (select doc_id from labels)) d using (doc_id)""")
def c8(spark, sf):
    """The text side holds labelled documents only, so the default shows."""
    docs = v.table(spark, sf, "documents")
    labelled = docs.join(v.table(spark, sf, "labels"), "doc_id", "left_semi")
    return f.marker_flag(docs.select("doc_id"), labelled, "doc_id", "text", MARKERS) \
        .select("doc_id", "marker")


@query("c9_stamp_availability", v.with_views("records", """
select item_id, index_time as available_at__delay_minutes, index_time as available_at__prior_exists,
       intime as available_at__acuity, window_close as available_at__episode_rows from records"""))
def c9(spark, sf):
    return featured(spark, sf).select("item_id", "available_at__delay_minutes", "available_at__prior_exists",
                                      "available_at__acuity", "available_at__episode_rows")


AUDIT_SAFE = "('delay_minutes','acq_pre'),('hour_of_day','acq_pre'),('day_of_week','acq_pre'),('prior_exists','acq_pre'),('days_since_prior','acq_pre'),('acuity','demographics')"


@query("c10_leakage_audit", v.with_views("records", f"""
select x.feature, x.block, (select count(*) from records) as rows_checked, 0::bigint as unstamped_values,
       case when x.feature = 'days_since_prior' then (select count(*) from records where window_close > index_time)
            else 0 end::bigint as late_rows,
       case when x.feature = 'days_since_prior' then (select round(max((epoch_us(window_close) - epoch_us(index_time))
            / 6e7::double), 6) from records where window_close > index_time) end as max_late_minutes,
       case when x.feature = 'days_since_prior' then 'violation' else 'ok' end as status
from (values {AUDIT_SAFE}) x(feature, block)
union all select 'paced', 'acq_pre', 0, 0, 0, null, 'dropped'"""))
def c10(spark, sf):
    """One feature is stamped at the window close on purpose; the audit must find it."""
    leaked = featured(spark, sf).withColumn("available_at__days_since_prior", F.col("window_close"))
    return f.leakage_audit(leaked, REGISTRY, "index_time").select(
        "feature", "block", "rows_checked", "unstamped_values", "late_rows", r("max_late_minutes"), "status")


@query("c11_window_block_report", v.with_views("records", """
select feature, (select count(*) from records) as rows_checked,
       case when feature in ('late_marker', 'acuity_late') then null
            else (select count(*) from records where window_close > index_time) end as late_rows,
       case when feature in ('late_marker', 'acuity_late') then 'dropped' else 'AFTER-INDEX' end as status
from (values ('episode_rows'), ('mean_gap_minutes'), ('late_marker'), ('acuity_late')) x(feature)"""))
def c11(spark, sf):
    return f.window_block_report(featured(spark, sf), REGISTRY, "index_time")


@query("c12_inject_leak", v.with_views("records", """
select item_id, case when n % greatest(1, (select count(*) from records) // 20) = 0 then window_close else index_time end
       as available_at__delay_minutes
from (select *, row_number() over (order by item_id) - 1 as n from records)"""))
def c12(spark, sf):
    rec = f.elapsed_minutes(v.records(spark, sf), "index_time", "intime")
    rec = f.stamp_availability(rec, REGISTRY[:1], RULES)
    return f.inject_leak(rec, "delay_minutes", "window_close", "item_id").select("item_id", "available_at__delay_minutes")


PROFILED = [f.Feature("hour_of_day", "acq_pre", "index"), f.Feature("day_of_week", "acq_pre", "index"),
            f.Feature("acuity", "demographics", "arrival"), f.Feature("constant", "acq_pre", "index"),
            f.Feature("paced", "acq_pre", "index")]


@query("c13_feature_profile", v.with_views("records", """
select x.feature, x.block, x.feature <> 'paced' as fitted, coalesce(n_levels, 0) as n_levels,
       round(modal, 6) as modal_share, round(undef, 6) as undefined_share, coalesce(n_levels, 0) > 1 as carries_information,
       case when x.feature = 'paced' then 'dropped' when n_levels > 1 then 'varies' else 'constant' end as status
from (values ('hour_of_day','acq_pre'),('day_of_week','acq_pre'),('acuity','demographics'),('constant','acq_pre'),
             ('paced','acq_pre')) x(feature, block)
left join (select feature, count(val) as n_levels, max(n) filter (val is not null) / sum(n) filter (val is not null) as modal,
                  coalesce(sum(n) filter (val is null), 0) / sum(n) as undef
           from (select feature, val, count(*)::double as n from (
             select 'hour_of_day' as feature, hour(index_time)::varchar as val from records
             union all select 'day_of_week', isodow(index_time)::varchar from records
             union all select 'acuity', acuity::varchar from records
             union all select 'constant', '1' from records) group by feature, val) group by feature) using (feature)"""))
def c13(spark, sf):
    rec = f.calendar_parts(v.base_records(spark, sf), "index_time").withColumn("constant", F.lit(1))
    return f.feature_profile(rec, PROFILED).select(
        "feature", "block", "fitted", "n_levels", r("modal_share"), r("undefined_share"),
        "carries_information", "status")


@query("c14_missingness", v.with_views("records", """
select round(avg(s), 6) as mean_share, round(quantile_cont(s, 0.5), 6) as median_share, round(max(s), 6) as max_share,
       count(*) filter (s > 0.9) as nearly_empty, count(*) filter (s = 1) as fully_empty,
       (select count(*) from feat) as n_rows,
       (select count(*) from feat where acuity is null and prior_time is null and mean_gap is null) as rows_without_data
from (select avg((acuity is null)::int) as s from feat union all select avg((prior_time is null)::int) from feat
      union all select avg((mean_gap is null)::int) from feat)""", FEATURED))
def c14(spark, sf):
    out = f.missingness(featured(spark, sf), ["acuity", "days_since_prior", "mean_gap_minutes"])
    return out.select(r("mean_share"), r("median_share"), r("max_share"), "nearly_empty", "fully_empty",
                      "n_rows", "rows_without_data")


@query("c15_assemble_matrix", v.with_views("wide_labels", """
select item_id, split, h24, round(delay_minutes, 9) as delay_minutes, prior_exists, acuity
from feat join wide_labels using (item_id) where h24 <> -999""", FEATURED))
def c15(spark, sf):
    cohort = v.base_records(spark, sf).select("item_id", "split").join(v.wide_labels(spark, sf), "item_id")
    feats = featured(spark, sf)
    demo = feats.select("item_id", "acuity")
    acq = feats.select("item_id", "delay_minutes", "prior_exists")
    out = f.assemble_matrix(cohort, [demo, acq], "item_id", "h24", ["delay_minutes", "prior_exists", "acuity"], ["split"])
    return out.withColumn("delay_minutes", F.round("delay_minutes", 9))


@query("c16_standardise_train_only", v.with_views("records", """
select item_id, (acuity is null)::int as acuity__missing,
       round((coalesce(acuity, ma) - ma) / sa, 6) as acuity__z, round((value - mv) / sv, 6) as value__z,
       (dense_rank() over (order by event_type) - 1)::int as event_type__code
from records, (select avg(acuity) as ma, stddev_pop(acuity) as sa, avg(value) as mv, stddev_pop(value) as sv
               from records where split = 'train')"""))
def c16(spark, sf):
    out = f.standardise_train_only(v.base_records(spark, sf), ["acuity", "value"], "split", ["event_type"])
    return out.select("item_id", "acuity__missing", r("acuity__z"), r("value__z"), "event_type__code")
