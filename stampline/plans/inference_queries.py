"""Queries for entity-clustered inference."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stampline.operators import cohort, inference as inf
from stampline.operators import discrimination as d
from stampline.operators.resampling import Mergeable, clustered_callback_ci, clustered_stat_ci, cluster_weights
from stampline.operators import report as rep
from stampline.plans import views as v
from stampline.plans.discrimination_queries import pooled, r
from stampline.plans.registry import query
from stampline.session import pinned

#: Replicates: of most registered queries, whose SQL twins bound them; of the one timed against other implementations; of a
#: contrast, so that several passes run; the declared number of a full report; and of tables that list the weights.
B, TIMED, CONTRAST, DECLARED, LISTED = 1_000, 500, 1_100, 10_000, 200
HOURS = {f"h{h}": h for h in v.HORIZONS}
POOLED_UNIVERSE = "select entity_id as entity from pooled"
CI = "round(estimate, 6) as {0}, round(ci_lo, 6) as ci_lo, round(ci_hi, 6) as ci_hi"


def pooled_table(spark, sf):
    """Pooled predictions as a written table, which is how scored arms arrive."""
    return pinned(pooled(spark, sf))


def arms_ctes(arms: str = "'ctx','sig'", n_boot: int = B) -> str:
    """reps as (rep, label, arm, auroc) and cnt as (label, n_items, n_positives, n_groups)."""
    return (v.draws_sql(POOLED_UNIVERSE, n_boot) + f""",
j as (select d.rep, d.w, p.arm, p.label, p.y, p.score from pooled p join draws d
      on d.entity = p.entity_id where p.arm in ({arms})),""" + v.auroc_sql("j", "rep, label, arm", "a") + """,
cnt as (select label, count(*) as n_items, sum(y)::bigint as n_positives,
        count(distinct entity_id) as n_groups from pooled where arm = 'ctx' group by label),
wide as (select rep, label, max(auroc) filter (arm = 'ctx') as ctx, max(auroc) filter (arm = 'sig') as sig,
         max(auroc) filter (arm = 'prev') as prev from a group by rep, label)""")


def ci_cols(name="estimate", p=True):
    cols = [r("estimate", name), r("ci_lo"), r("ci_hi")]
    return cols + [r("p_value")] if p else cols


for _mode in ("multinomial", "poisson"):
    def _weights(spark, sf, mode=_mode):
        li = v.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("cluster"))
        return cluster_weights(li, "cluster", LISTED, 7, mode)

    query(f"e10_cluster_weights_{_mode}",
          v.with_views("", "select rep, entity as cluster, w::bigint as w from draws where rep >= 0",
                       v.draws_sql("select l_suppkey as entity from lineitem", LISTED, 7, _mode)))(_weights)


@query("e11_clustered_auroc_ci", v.with_views("pooled", f"""
select s.arm, s.label, {CI.format('auroc')}, n_boot, n_finite, n_items, n_positives, n_groups
from ({v.summary_sql('a', 'arm, label', B, 'auroc')}) s join cnt using (label)""",
       arms_ctes("'ctx','sig','prev'")))
def e11(spark, sf):
    out = inf.clustered_auroc_ci(pooled(spark, sf), "y", "score", "entity_id", ["arm", "label"], B)
    return out.select("arm", "label", r("auroc"), r("ci_lo"), r("ci_hi"), "n_boot", "n_finite", "n_items",
                      "n_positives", "n_groups")


for _name, _n in (("e11_clustered_auroc_ci_poisson", TIMED), ("e11_clustered_auroc_ci_declared", DECLARED)):
    def _interval(spark, sf, n=_n):
        out = inf.clustered_auroc_ci(v.lines(spark, sf), "y", "score", "cluster", [], n, mode="poisson")
        return out.select(r("auroc"), r("ci_lo"), r("ci_hi"), "n_boot", "n_finite", "n_items", "n_groups")

    query(_name, v.with_views("lines", f"""
select {CI.format('auroc')}, n_boot, n_finite,
       (select count(*) from lines) as n_items, (select count(distinct cluster) from lines) as n_groups
from ({v.summary_sql('a', '', _n, 'auroc')})""",
          v.draws_sql("select cluster as entity from lines", _n, 0, "poisson") + """,
j as (select d.rep, c.y, c.score, sum(d.w * c.n) as w from
      (select cluster, y, score, count(*) as n from lines group by all) c
      join draws d on d.entity = c.cluster group by all),""" + v.auroc_sql("j", "rep", "a")))(_interval)


@query("e12_paired_auroc_diff", v.with_views("pooled", f"""
select s.label, {CI.format('difference')}, round(p_value, 6) as p_value, round(w.ctx, 6) as auroc_a,
       round(w.sig, 6) as auroc_b, n_boot, n_finite, n_items, n_groups
from ({v.summary_sql('(select *, sig - ctx as value from wide)', 'label', CONTRAST)}) s
join wide w on w.label = s.label and w.rep = -1 join cnt on cnt.label = s.label""", arms_ctes(n_boot=CONTRAST)))
def e12(spark, sf):
    out = inf.paired_auroc_diff(pooled(spark, sf), "ctx", "sig", ["label"], "item_id", "entity_id", CONTRAST)
    return out.select("label", r("difference"), r("ci_lo"), r("ci_hi"), r("p_value"), r("auroc_a"),
                      r("auroc_b"), "n_boot", "n_finite", "n_items", "n_groups")


CROP_CTES = (v.draws_sql("select entity_id as entity from crops", B) + """,
j as (select d.rep, d.w, c.label, c.y, c.score from crops c join draws d on d.entity = c.entity_id),"""
             + v.auroc_sql("j", "rep, label", "a") + """,
both_t as (select rep, label, auroc as value from a
           union all select rep, 'macro', avg(auroc) from a group by rep)""")


@query("e13_clustered_macro_ci", v.with_views("crops", f"""
select label, {CI.format('auroc')}, n_boot, n_boot - n_finite as n_undefined
from ({v.summary_sql('both_t', 'label', B)})""", CROP_CTES))
def e13(spark, sf):
    out = inf.clustered_macro_ci(v.crop_predictions(spark, sf), "label", "entity_id", [], B)
    return out.select("label", *ci_cols("auroc", False), "n_boot", "n_undefined")


LINES_CTES = v.draws_sql("select cluster as entity from lines", B) + """,
j as (select d.rep, c.y, c.score, c.stratum, sum(d.w * c.n) as w from
      (select cluster, y, score, stratum, count(*) as n from lines group by all) c
      join draws d on d.entity = c.cluster group by all)"""


def concordance_sql(source: str, keys: str, name: str) -> str:
    return f"""
{name}_h as (select {keys}, stratum, score, sum(case when y = 1 then w else 0 end)::double as p,
             sum(case when y = 0 then w else 0 end)::double as n from {source} group by {keys}, stratum, score),
{name}_b as (select *, coalesce(sum(n) over (partition by {keys}, stratum order by score
             rows between unbounded preceding and 1 preceding), 0) as below from {name}_h),
{name}_s as (select {keys}, stratum, sum(p * (below + 0.5::double * n)) as wins, sum(p) * sum(n) as pairs
             from {name}_b group by {keys}, stratum),
{name} as (select {keys}, case when sum(pairs) > 0 then sum(wins) / sum(pairs) end as value
           from {name}_s group by {keys})"""


@query("e14_clustered_concordance_ci", v.with_views("lines", f"""
select {CI.format('concordance')}, n_boot, n_finite, (select count(distinct cluster) from lines) as n_groups
from ({v.summary_sql('a', '', B)})""", LINES_CTES + "," + concordance_sql("j", "rep", "a")))
def e14(spark, sf):
    out = inf.clustered_concordance_ci(v.lines(spark, sf), "y", "score", "stratum", "cluster", [], B)
    return out.select(*ci_cols("concordance", False), "n_boot", "n_finite", "n_groups")


@query("e15_clustered_stat_ci", v.with_views("records", f"""
select event_type, {CI.format('estimate')}, round(p_value, 6) as p_value, n_boot, n_finite, n_groups
from ({v.summary_sql('s', 'event_type', B)}),
     (select count(distinct entity_id) as n_groups from records)""",
       v.draws_sql("select entity_id as entity from records", B) + """,
s as (select d.rep, event_type, sum(w * sv) / sum(w * n) - 50 as value from
      (select entity_id, event_type, sum(value) as sv, count(*) as n from records group by all) x
      join draws d on d.entity = x.entity_id group by all)"""))
def e15(spark, sf):
    """Interval for a caller's own statistic: mean value minus fifty, per event type."""
    rec = v.base_records(spark, sf)
    per = pinned(rec.groupBy("entity_id", "event_type").agg(
        F.sum("value").alias("sv"), F.count("value").alias("n")))

    def statistic(rows, keys):
        mean = F.sum(F.col("w") * F.col("sv")) / F.sum(F.col("w") * F.col("n"))
        return rows.groupBy(*keys).agg((mean - 50).alias("value"))

    out = clustered_stat_ci(per, "entity_id", statistic, ["event_type"], B)
    return out.select("event_type", *ci_cols(), "n_boot", "n_finite", "n_groups")


def deviation() -> Mergeable:
    """Standard deviation of `value` from its weighted moments, as a caller would write it in plain Python."""
    def add(state, rows, weights):
        return state + np.stack([rows["n"], rows["sv"], rows["sq"]]) @ weights

    def finish(state):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.sqrt(np.maximum(state[2] / state[0] - (state[1] / state[0]) ** 2, 0.0))

    return Mergeable(lambda width: np.zeros((3, width)), add, lambda a, b: a + b, finish)


@query("e15_clustered_callback_ci", v.with_views("records", f"""
select event_type, {CI.format('estimate')}, n_boot, n_finite, (select count(distinct entity_id) from records) as n_groups
from ({v.summary_sql('s', 'event_type', DECLARED)})""",
       v.draws_sql("select entity_id as entity from records", DECLARED) + """,
s as (select d.rep, event_type, sqrt(greatest(sum(w * sq) / sum(w * n) - pow(sum(w * sv) / sum(w * n), 2), 0)) as value from
      (select entity_id, event_type, sum(value) as sv, sum(value * value) as sq, count(value)::double as n from records group by all) x
      join draws d on d.entity = x.entity_id group by all)"""))
def e15_callback(spark, sf):
    per = pinned(v.base_records(spark, sf).groupBy("entity_id", "event_type").agg(
        F.sum("value").alias("sv"), F.sum(F.col("value") * F.col("value")).alias("sq"),
        F.count("value").cast("double").alias("n")))
    out = clustered_callback_ci(per, "entity_id", deviation(), ["n", "sv", "sq"], ["event_type"], DECLARED)
    return out.select("event_type", *ci_cols("estimate", False), "n_boot", "n_finite", "n_groups")


RATIO = "case when abs({1} - 0.5::double) >= 1e-12 then ({0} - 0.5::double) / ({1} - 0.5::double) end"


@query("e16_recovery_ratio", v.with_views("pooled", f"""
select s.arm, s.label, {CI.format('estimate')}, n_boot, n_finite, n_items, n_groups,
       round(o.num, 6) as numerator_auroc, round(o.sig, 6) as denominator_auroc,
       estimate >= 0.7 as meets_target, (s.arm = 'ctx' and s.label = 'h72') as is_primary
from ({v.summary_sql('q', 'arm, label', B)}) s
join q o on o.arm = s.arm and o.label = s.label and o.rep = -1 join cnt on cnt.label = s.label""",
       arms_ctes("'ctx','sig','prev'") + f""",
q as (select rep, 'ctx' as arm, label, ctx as num, sig, {RATIO.format('ctx', 'sig')} as value from wide
      union all select rep, 'prev', label, prev, sig, {RATIO.format('prev', 'sig')} from wide)"""))
def e16(spark, sf):
    out = inf.recovery_ratio_ci(pooled_table(spark, sf), ["ctx", "prev"], "sig", ["label"], "item_id",
                                "entity_id", B, 0.7, ("ctx", "h72"))
    return out.select("arm", "label", *ci_cols("estimate", False), "n_boot", "n_finite", "n_items",
                      "n_groups", r("numerator_auroc"), r("denominator_auroc"), "meets_target", "is_primary")


#: Declared constant denominators (fixed values).
DENOMINATORS = [("published", 0.8565), ("preprint", 0.8292), ("chance", 0.5)]


@query("e17_recovery_ratio_fixed_denominator", v.with_views("pooled", f"""
select s.name, {CI.format('estimate')}, n_boot, n_finite, round(o.auroc, 6) as numerator_auroc,
       coalesce(estimate >= 0.7, false) as meets_target, false as denominator_resampled
from ({v.summary_sql('q', 'name', B)}) s join q o on o.name = s.name and o.rep = -1""",
       v.draws_sql("select entity_id as entity from pooled where label = 'h72'", B) + """,
j as (select d.rep, d.w, p.y, p.score from pooled p join draws d on d.entity = p.entity_id
      where arm = 'ctx' and label = 'h72'),""" + v.auroc_sql("j", "rep", "a") + f""",
q as (select rep, name, auroc, {RATIO.format('auroc', 'den')} as value
      from a, (values ('published', 0.8565::double), ('preprint', 0.8292::double),
               ('chance', 0.5::double)) x(name, den))"""))
def e17(spark, sf):
    rows = pinned(pooled(spark, sf).where(F.col("label") == "h72"))
    table = spark.createDataFrame(DENOMINATORS, "name string, denominator double")
    out = inf.recovery_ratio_fixed_denominator(rows.where(F.col("arm") == "ctx"), table, "entity_id", B, 0.7,
                                               reference=rows.where(F.col("arm") == "sig"))
    return out.select("name", *ci_cols("estimate", False), "n_boot", "n_finite", r("numerator_auroc"),
                      "meets_target", "denominator_resampled")


def matched_ctes(arms: str, n_boot: int = B) -> str:
    return f"""
m0 as (select p.arm, p.label, p.item_id, p.entity_id, p.y, p.score, s.stratum
       from pooled p join strata s using (item_id) where p.arm in ({arms})),
m as (select * from m0 where (label, stratum) in (
        select (label, stratum) from m0 group by label, stratum having min(y) = 0 and max(y) = 1)),
""" + v.draws_sql("select entity_id as entity from m", n_boot) + """,
j as (select d.rep, d.w, arm, label, stratum, y, score from m join draws d on d.entity = m.entity_id),
""" + concordance_sql("j", "rep, label, arm", "c") + "," + v.auroc_sql("j", "rep, label, arm", "a") + """,
mw as (select rep, label, max(value) filter (arm = 'sig') as w_in, max(value) filter (arm = 'ctx') as b_in,
       max(auroc) filter (arm = 'sig') as w_all, max(auroc) filter (arm = 'ctx') as b_all
       from c join a using (rep, label, arm) group by rep, label),
mc as (select label, count(*) as n_items, count(distinct entity_id) as n_groups from m
       where arm = 'sig' group by label)"""


@query("e18_gain_retained", v.with_views("pooled strata", f"""
select s.label, {CI.format('estimate')}, n_finite, round(t.estimate2, 6) as retained_plain_baseline,
       round(lo2, 6) as retained_plain_baseline_lo, round(hi2, 6) as retained_plain_baseline_hi,
       round(o.w_in - o.b_in, 6) as gain_matched, round(o.w_all - o.b_all, 6) as gain_unmatched_same_rows,
       round(f.g, 6) as gain_unmatched_full_cohort, n_items, n_groups,
       estimate <= 0.5 as meets_target, estimate2 <= 0.5 as meets_target_plain_baseline
from ({v.summary_sql('q1', 'label', B)}) s
join (select label, estimate as estimate2, ci_lo as lo2, ci_hi as hi2
      from ({v.summary_sql('q2', 'label', B)})) t on t.label = s.label
join mw o on o.label = s.label and o.rep = -1
join (select label, max(auroc) filter (arm = 'sig') - max(auroc) filter (arm = 'ctx') as g
      from fa group by label) f on f.label = s.label
join mc on mc.label = s.label""",
       matched_ctes("'ctx','sig'") + """,
q1 as (select rep, label, case when abs(w_all - b_all) >= 1e-12 then (w_in - b_in) / (w_all - b_all) end as value from mw),
q2 as (select rep, label, case when abs(w_all - b_all) >= 1e-12 then (w_in - b_all) / (w_all - b_all) end as value from mw),
""" + v.auroc_sql("(select 1 as w, * from m0)", "label, arm", "fa")))
def e18(spark, sf):
    out = inf.gain_retained(pooled(spark, sf), v.strata(spark, sf), "ctx", "sig", ["label"],
                            "item_id", "entity_id", B, 0.5)
    return out.select("label", *ci_cols("estimate", False), "n_finite", r("retained_plain_baseline"),
                      r("retained_plain_baseline_lo"), r("retained_plain_baseline_hi"),
                      r("gain_matched"), r("gain_unmatched_same_rows"), r("gain_unmatched_full_cohort"),
                      "n_items", "n_groups", "meets_target", "meets_target_plain_baseline")


def retained_sql(spec: str, strata: str) -> str:
    """Retained gain under one choice of strata, as a subquery with CTEs of its own."""
    ctes = matched_ctes("'ctx','sig'").replace("join strata s using", f"join ({strata}) s using")
    return f"""select * from (with {ctes},
q1 as (select rep, label, case when abs(w_all - b_all) >= 1e-12 then (w_in - b_in) / (w_all - b_all) end as value from mw)
select '{spec}' as spec, s.label, {CI.format('estimate')}, n_finite, round(o.w_in - o.b_in, 6) as gain_matched,
       round(o.w_all - o.b_all, 6) as gain_unmatched_same_rows, n_items, n_groups
from ({v.summary_sql('q1', 'label', B)}) s join mw o on o.label = s.label and o.rep = -1 join mc on mc.label = s.label)"""


@query("i1_matching_sensitivity", v.with_views("pooled strata",
       retained_sql("declared", "select * from strata") + " union all "
       + retained_sql("acuity only", "select item_id, split_part(stratum, '|', 1) as stratum from strata")))
def i1_matching(spark, sf):
    """The retained gain beside the same rows matched on a coarser key."""
    pool, strata = pooled_table(spark, sf), v.strata(spark, sf)
    coarse = strata.withColumn("stratum", F.split("stratum", r"\|")[0])
    cols = ["label", "estimate", "ci_lo", "ci_hi", "n_finite", "gain_matched", "gain_unmatched_same_rows", "n_items", "n_groups"]

    def gain(keys):
        return inf.gain_retained(pool, keys, "ctx", "sig", ["label"], "item_id", "entity_id", B, 0.5)

    out = rep.declared_and_sensitivity(gain(strata), {"acuity only": gain(coarse)}, cols)
    return out.select("spec", "label", *ci_cols("estimate", False), "n_finite", r("gain_matched"),
                      r("gain_unmatched_same_rows"), "n_items", "n_groups")


@query("e19_restricted_vs_plain_diff", v.with_views("pooled strata", f"""
select s.label, {CI.format('difference')}, round(p_value, 6) as p_value, round(w_in, 6) as within,
       round(w_all, 6) as plain, n_items, n_groups
from ({v.summary_sql('(select *, w_in - w_all as value from mw)', 'label', B)}) s
join mw o on o.label = s.label and o.rep = -1 join mc on mc.label = s.label""", matched_ctes("'sig'")))
def e19(spark, sf):
    out = inf.restricted_vs_plain_diff(pooled(spark, sf), v.strata(spark, sf), "sig", ["label"],
                                       "item_id", "entity_id", B)
    return out.select("label", r("difference"), r("ci_lo"), r("ci_hi"), r("p_value"), r("within"),
                      r("plain"), "n_items", "n_groups")


@query("e21_horizon_trend", v.with_views("pooled", f"""
select quantity, {CI.format('estimate')}, round(p_value, 6) as p_value, n_boot, n_finite,
       3::bigint as n_labels, coalesce(estimate < 0 and ci_hi < 0, false) as supported
from ({v.summary_sql('sp', 'quantity', B)})""",
       arms_ctes() + f""",
q as (select rep, label, 'delta' as quantity, sig - ctx as q from wide
      union all select rep, label, 'ratio', {RATIO.format('ctx', 'sig')} from wide),
rk as (select rep, quantity, q,
       rank() over (partition by rep, quantity order by cast(substr(label, 2) as int)) as rx,
       rank() over (partition by rep, quantity order by q)
         + (count(*) over (partition by rep, quantity, q) - 1) / 2.0::double as ry from q where q is not null),
sp as (select rep, quantity, case when count(*) = 3 and min(ry) < max(ry) then corr(rx, ry) end as value
       from rk group by rep, quantity)"""))
def e21(spark, sf):
    out = inf.horizon_trend(pooled(spark, sf), HOURS, "ctx", "sig", ["delta", "ratio"], "item_id", "entity_id", B)
    return out.select("quantity", *ci_cols(), "n_boot", "n_finite", "n_labels", "supported")


@query("e22_horizon_ladder", v.with_views("pooled", f"""
select s.label, cast(substr(s.label, 2) as bigint) as horizon, {CI.format('difference')},
       round(p_value, 6) as p_value, case when s.label in ('h24', 'h72') then 'primary' else 'generating' end as role,
       s.label in ('h24', 'h72') as counts_as_confirmation, n_items
from ({v.summary_sql('(select *, sig - ctx as value from wide)', 'label', B)}) s join cnt on cnt.label = s.label""",
       arms_ctes()))
def e22(spark, sf):
    out = inf.horizon_ladder(pooled(spark, sf), HOURS, ["h24", "h72"], "ctx", "sig", "item_id", "entity_id", B)
    return out.select("label", "horizon", r("difference"), r("ci_lo"), r("ci_hi"), r("p_value"), "role",
                      "counts_as_confirmation", "n_items")


#: Contrasts of the declared family as (a, b); the difference is b - a.
CONTRASTS = [("ctx", "sig"), ("prev", "ctx"), ("prev", "sig")]
FAMILY = 12


def contrast_table(pool):
    """(arm_a, arm_b, label, difference, p_value) of every declared contrast on one draw."""
    wide, _ = inf.arm_replicates(pool, ["ctx", "sig", "prev"], ["label"], "item_id", "entity_id", B)
    parts = F.array(*[F.struct(F.lit(a).alias("arm_a"), F.lit(b).alias("arm_b"),
                               (F.col(b) - F.col(a)).alias("value")) for a, b in CONTRASTS])
    long = wide.select("rep", "label", F.explode(parts).alias("c")).select("rep", "label", "c.*")
    return inf.summarise(long, ["arm_a", "arm_b", "label"], B).withColumnRenamed("estimate", "difference")


CONTRAST_CTES = arms_ctes("'ctx','sig','prev'") + f""",
cl as (select rep, label, 'ctx' as arm_a, 'sig' as arm_b, sig - ctx as value from wide
       union all select rep, label, 'prev', 'ctx', ctx - prev from wide
       union all select rep, label, 'prev', 'sig', sig - prev from wide),
ct as ({v.summary_sql('cl', 'arm_a, arm_b, label', B)})"""

HOLM_SQL = """
hr as (select *, row_number() over (order by p_value, {order}) - 1 as i from {source}),
hm as (select *, max(least(1.0::double, ({m} - i) * p_value)) over (order by i) as p_holm,
       count(*) over () as present from hr)"""
HOLM_OUT = """round(p_holm, 6) as p_holm, {m}::bigint as holm_family_size, present as holm_tests_present,
       {m} - present as holm_tests_pending, p_value < {floor} as at_floor,
       case when p_value < {floor} then '<{floor}' else printf('%.4f', p_value) end as p_text"""


@query("e23_holm", v.with_views("pooled", f"""
select arm_a, arm_b, label, round(p_value, 6) as p_value, {HOLM_OUT.format(m=FAMILY, floor=2 / B)} from hm""",
       CONTRAST_CTES + "," + HOLM_SQL.format(order="arm_a, arm_b, label", source="ct", m=FAMILY)))
def e23(spark, sf):
    out = inf.holm(contrast_table(pooled(spark, sf)), "p_value", FAMILY, B, order=["arm_a", "arm_b", "label"])
    return out.select("arm_a", "arm_b", "label", r("p_value"), r("p_holm"), "holm_family_size",
                      "holm_tests_present", "holm_tests_pending", "at_floor", "p_text")


@query("e24_family_union", v.with_views("pooled strata", f"""
select contrast, label, phase, round(p_value, 6) as p_value, {HOLM_OUT.format(m=FAMILY, floor=2 / B)},
       present = {FAMILY} as family_complete from hm""",
       CONTRAST_CTES + ",\n" + matched_ctes("'sig'", B).replace("draws", "mdraws").replace(" j as", " mj as")
       .replace("\nj as", "\nmj as").replace("from j ", "from mj ").replace("a_h", "ma_h").replace("a_b ", "ma_b ")
       .replace("\na as (", "\nma as (").replace("c join a using", "c join ma using") + f""",
md as ({v.summary_sql('(select *, w_in - w_all as value from mw)', 'label', B)}),
fu as (select arm_b || ' - ' || arm_a as contrast, label, 'first' as phase, p_value from ct
       union all select 'matched - sig', label, 'second', p_value from md),"""
       + HOLM_SQL.format(order="contrast, label", source="fu", m=FAMILY)))
def e24(spark, sf):
    pool = pooled_table(spark, sf)
    first = contrast_table(pool).withColumn("contrast", F.concat("arm_b", F.lit(" - "), "arm_a"))
    second = inf.restricted_vs_plain_diff(pool, v.strata(spark, sf), "sig", ["label"], "item_id",
                                          "entity_id", B).withColumn("contrast", F.lit("matched - sig"))
    out = inf.family_union({"first": first, "second": second}, "p_value", FAMILY, B, ["contrast", "label"])
    return out.select("contrast", "label", "phase", r("p_value"), r("p_holm"), "holm_family_size",
                      "holm_tests_present", "holm_tests_pending", "at_floor", "p_text", "family_complete")


@query("e25_noise_floor", v.with_views("pooled", """
select arm_a, arm_b, d.label, round(difference, 6) as difference,
       round(greatest(x.sp, z.sp), 6) as noise_floor, abs(difference) > greatest(x.sp, z.sp) as clears_noise_floor
from (select 'ctx' as arm_a, 'sig' as arm_b, label,
             max(auroc) filter (arm = 'sig') - max(auroc) filter (arm = 'ctx') as difference
      from pa group by label) d
join sp x on x.arm = d.arm_a and x.label = d.label join sp z on z.arm = d.arm_b and z.label = d.label""",
       v.auroc_sql("(select 1 as w, * from predictions)", "arm, label, seed", "sa") + ","
       + v.auroc_sql("(select 1 as w, * from pooled)", "arm, label", "pa") + """,
sp as (select arm, label, max(auroc) - min(auroc) as sp from sa group by arm, label)"""))
def e25(spark, sf):
    preds = v.predictions(spark, sf)
    spread = d.seed_spread(preds, list(v.SEEDS), ["arm", "label"])
    pool = d.seed_pool(preds, list(v.SEEDS), ["arm", "label"], carry=["y"], digits=9)
    point = d.auroc(pool, "y", "score", ["arm", "label"])
    diff = point.groupBy("label").agg(
        (F.max(F.when(F.col("arm") == "sig", F.col("auroc")))
         - F.max(F.when(F.col("arm") == "ctx", F.col("auroc")))).alias("difference")) \
        .withColumns({"arm_a": F.lit("ctx"), "arm_b": F.lit("sig")})
    return inf.noise_floor(spread, diff, ["label"]).select(
        "arm_a", "arm_b", "label", r("difference"), r("noise_floor"), "clears_noise_floor")


@query("e27_stat_controls", v.with_views("lines", """
select control, round(u.auroc, 6) as unstratified, round(c.value, 6) as within_stratum, n_items, n_strata
from ua u join c using (control) join (select control, count(*) as n_items,
  count(distinct stratum) as n_strata from t group by control) n using (control)""", """
t as (select 'single_stratum' as control, y, score, 'all' as stratum, 1 as w from lines
      union all select 'constant_within_stratum', y, avg(y) over (partition by stratum), stratum, 1 from lines
      union all select 'duplicated_rows', y, score, 'all', 1 from lines, range(2)),""" +
       v.auroc_sql("t", "control", "ua") + "," + concordance_sql("t", "control", "c")))
def e27(spark, sf):
    return inf.stat_controls(v.lines(spark, sf), "y", "score", "stratum").select(
        "control", r("unstratified"), r("within_stratum"), "n_items", "n_strata")


@query("e28_unit_restriction_sensitivity", v.with_views("crops", f"""
select unit, restriction, {CI.format('macro_auroc')}, n_boot, n_finite, n_scored, n_targets, n_groups
from ({v.summary_sql('mr', 'unit, restriction', B)}) join (
  select unit, restriction, count(*) as n_scored, count(distinct label) as n_targets,
         count(distinct entity_id) as n_groups from rs group by unit, restriction) using (unit, restriction)""", """
un as (select label, item_id, entity_id, y, score, 'crop' as unit from crops
       union all select label, item_id, any_value(entity_id), any_value(y), round(avg(score), 9), 'record'
       from crops group by label, item_id),
rs as (select *, 'all' as restriction from un
       union all select *, 'first_of_episode' from un
       where item_id in (select item_id from records where seq = 0)),""" +
       v.draws_sql("select entity_id as entity from rs", B) + """,
j as (select d.rep, d.w, unit, restriction, label, y, score from rs join draws d on d.entity = rs.entity_id),"""
       + v.auroc_sql("j", "rep, unit, restriction, label", "a") + """,
mr as (select rep, unit, restriction, avg(auroc) as value from a group by rep, unit, restriction)"""))
def e28(spark, sf):
    first = cohort.first_of_episode(v.records(spark, sf, seq=True), "seq")
    out = inf.unit_restriction_sensitivity(v.crop_predictions(spark, sf), first, "label", "item_id", "entity_id", B)
    return out.select("unit", "restriction", r("macro_auroc"), r("ci_lo"), r("ci_hi"), "n_boot", "n_finite",
                      "n_scored", "n_targets", "n_groups")


@query("e29_arm_sensitivity", v.with_views("pooled", f"""
select s.label, s.quantity, s.arm, {CI.format('estimate')}, round(p_value, 6) as p_value, n_finite, n_items,
       'shared_configuration' as question, 'ctx' as declared_arm
from ({v.summary_sql('q', 'label, quantity, arm', B)}) s join cnt on cnt.label = s.label""",
       arms_ctes("'ctx','sig','prev'") + f""",
q as (select rep, label, 'auroc' as quantity, 'prev' as arm, prev as value from wide
      union all select rep, label, 'auroc', 'ctx', ctx from wide
      union all select rep, label, 'recovery_ratio', 'prev', {RATIO.format('prev', 'sig')} from wide
      union all select rep, label, 'recovery_ratio', 'ctx', {RATIO.format('ctx', 'sig')} from wide
      union all select rep, label, 'paired_difference', 'ctx - prev', ctx - prev from wide)"""))
def e29(spark, sf):
    out = inf.arm_sensitivity(pooled(spark, sf), [("prev", "ctx", "shared_configuration")], "sig", ["label"],
                              "item_id", "entity_id", B)
    return out.select("label", "quantity", "arm", *ci_cols(), "n_finite", "n_items", "question", "declared_arm")
