"""Queries for the discrimination statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from stampline.operators import discrimination as d
from stampline.plans import views as v
from stampline.plans.registry import query
from stampline.session import pinned

R6 = 6


def r(name: str, alias: str | None = None):
    return F.round(F.col(name), R6).alias(alias or name)


def pooled(spark, sf):
    return d.seed_pool(v.predictions(spark, sf), list(v.SEEDS), ["arm", "label"],
                       carry=["entity_id", "y"], digits=9)


@query("e1_auroc", v.with_views("lines", """
select round(auroc, 6) as auroc, n_pos, n_neg
from a, (select sum(y)::bigint as n_pos, sum(1 - y)::bigint as n_neg from lines)""",
       v.auroc_sql("(select 1 as g, 1 as w, * from lines)", "g", "a")))
def e1(spark, sf):
    return d.auroc(v.lines(spark, sf), "y", "score").select(r("auroc"), "n_pos", "n_neg")


@query("e1_auroc_by_cell", v.with_views("pooled", """
select a.arm, a.label, round(auroc, 6) as auroc from a""",
       v.auroc_sql("(select 1 as w, * from pooled)", "arm, label", "a")))
def e1_cells(spark, sf):
    return d.auroc(pooled(spark, sf), "y", "score", ["arm", "label"]).select("arm", "label", r("auroc"))


@query("e2_auprc", v.with_views("pooled", """
select arm, label, round(sum(p * (cp / cn)) / sum(p), 6) as auprc from (
  select arm, label, p, sum(p) over w as cp, sum(n) over w as cn from (
    select arm, label, score, sum(y)::double as p, count(*)::double as n
    from pooled group by arm, label, score)
  window w as (partition by arm, label order by score desc))
group by arm, label"""))
def e2(spark, sf):
    return d.auprc(pooled(spark, sf), "y", "score", ["arm", "label"]).select("arm", "label", r("auprc"))


@query("e3_brier", v.with_views("docs", """
select label, round(avg((p - y) * (p - y)), 6) as brier, count(*) as n_items from docs group by label"""))
def e3(spark, sf):
    return d.brier(v.scored_documents(spark, sf), "y", "p", ["label"]).select("label", r("brier"), "n_items")


@query("e4_seed_pool", v.with_views("pooled", """
select arm, label, round(seed_mean, 6) as seed_mean, round(seed_min, 6) as seed_min,
       round(seed_max, 6) as seed_max, round(seed_spread, 6) as seed_spread,
       round(seed_sd, 6) as seed_sd, n_seeds, n_items, round(pooled_mean, 6) as pooled_mean
from (select arm, label, avg(auroc) as seed_mean, min(auroc) as seed_min, max(auroc) as seed_max,
             max(auroc) - min(auroc) as seed_spread, stddev_samp(auroc) as seed_sd,
             count(distinct seed) as n_seeds from a group by arm, label)
join (select arm, label, count(*) as n_items, avg(score) as pooled_mean from pooled
      group by arm, label) using (arm, label)""",
       v.auroc_sql("(select 1 as w, * from predictions)", "arm, label, seed", "a")))
def e4(spark, sf):
    preds = v.predictions(spark, sf)
    pool = d.seed_pool(preds, list(v.SEEDS), ["arm", "label"], digits=9).groupBy("arm", "label") \
        .agg(F.count(F.lit(1)).alias("n_items"), F.avg("score").alias("pooled_mean"))
    out = d.seed_spread(preds, list(v.SEEDS), ["arm", "label"]).join(pool, ["arm", "label"])
    return out.select("arm", "label", r("seed_mean"), r("seed_min"), r("seed_max"), r("seed_spread"),
                      r("seed_sd"), "n_seeds", "n_items", r("pooled_mean"))


@query("e5_join_arms", v.with_views("pooled", """
select c.label, c.item_id, c.entity_id, c.y, round(c.score, 6) as ctx, round(s.score, 6) as sig
from pooled c join pooled s on s.label = c.label and s.item_id = c.item_id
where c.arm = 'ctx' and s.arm = 'sig'"""))
def e5(spark, sf):
    return d.join_arms(pooled(spark, sf), ["ctx", "sig"], ["label", "item_id"], ["entity_id", "y"]) \
        .select("label", "item_id", "entity_id", "y", r("ctx"), r("sig"))


@query("e6_fold_crops", v.with_views("crops", """
select label, item_id, any_value(entity_id) as entity_id, any_value(y) as y,
       round(avg(score), 6) as score, count(*) as n_crops
from crops group by label, item_id"""))
def e6(spark, sf):
    return d.fold_crops(v.crop_predictions(spark, sf), ["label", "item_id"], ["entity_id", "y"]) \
        .select("label", "item_id", "entity_id", "y", r("score"), "n_crops")


@query("e7_macro_auroc", v.with_views("predictions", """
select arm, seed, round(avg(auroc), 6) as macro_auroc, count(auroc) as n_targets_scored
from a group by arm, seed""",
       v.auroc_sql("(select 1 as w, * from predictions)", "arm, seed, label", "a")))
def e7(spark, sf):
    return d.macro_auroc(v.predictions(spark, sf), "label", ["arm", "seed"]) \
        .select("arm", "seed", r("macro_auroc"), "n_targets_scored")


@query("e8_within_stratum_concordance", v.with_views("lines", """
select round(sum(p * (below + 0.5::double * n)) / sum(pn), 6) as concordance, sum(pn)::double as n_pairs
from (select *, 0 as pn from b union all
      select stratum, null, 0, 0, 0, sum(p) * sum(n) from b group by stratum)""", """
h as (select stratum, score, sum(y)::double as p, sum(1 - y)::double as n from lines group by stratum, score),
b as (select *, coalesce(sum(n) over (partition by stratum order by score
      rows between unbounded preceding and 1 preceding), 0) as below from h)"""))
def e8(spark, sf):
    return d.within_stratum_concordance(v.lines(spark, sf), "y", "score", "stratum") \
        .select(r("concordance"), "n_pairs")


@query("e9_informative_strata", v.with_views("horizon_labels strata", """
select t.label, count(*) as n_strata, sum(pos::double * neg) as n_pairs,
       sum(pos + neg)::bigint as n_items,
       (select count(distinct entity_id) from horizon_labels h join strata s using (item_id)
        where h.label = t.label and y >= 0 and stratum in
          (select stratum from t t2 where t2.label = h.label and pos > 0 and neg > 0)) as n_entities
from t where pos > 0 and neg > 0 group by t.label""", """
t as (select label, stratum, sum(y) as pos, sum(1 - y) as neg
      from horizon_labels join strata using (item_id) where y >= 0 group by label, stratum)"""))
def e9(spark, sf):
    rows = pinned(v.horizon_labels(spark, sf).join(v.strata(spark, sf), "item_id"))
    return d.informative_strata(rows, "y", "stratum", "entity_id", ["label"])


@query("e20_spearman", v.with_views("", """
select l_returnflag, round(corr(rx, ry), 6) as spearman, count(*) as n
from (select l_returnflag,
        rank() over (partition by l_returnflag order by l_discount)
          + (count(*) over (partition by l_returnflag, l_discount) - 1) / 2.0::double as rx,
        rank() over (partition by l_returnflag order by l_quantity)
          + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0::double as ry
      from lineitem) group by l_returnflag"""))
def e20(spark, sf):
    li = v.table(spark, sf, "lineitem")
    return d.midrank_spearman(li, "l_discount", "l_quantity", ["l_returnflag"]) \
        .select("l_returnflag", r("spearman"), "n")


@query("e30_masked_focal_bce", v.with_views("crops", """
select round(sum(loss), 6) as focal_loss, count(*) as n_targets from (
  select label, avg(pow(1 - pt, 2) * -ln(pt)) as loss from (
    select label, case when y = 1 then p else 1 - p end as pt from (
      select label, y, least(0.9999999::double, greatest(0.0000001::double, score)) as p from crops))
  group by label)"""))
def e30(spark, sf):
    return d.masked_focal_bce(v.crop_predictions(spark, sf), 2.0, "label").select(r("focal_loss"), "n_targets")
