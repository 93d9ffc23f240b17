"""Queries for arms, declarations, verdicts and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stampline.operators import arms as g
from stampline.operators import discrimination as d
from stampline.operators import inference as inf
from stampline.operators import report as rep
from stampline.plans import views as v
from stampline.plans.discrimination_queries import pooled, r
from stampline.plans.feature_queries import featured
from stampline.plans.inference_queries import B, CONTRAST_CTES, FAMILY, HOLM_SQL, arms_ctes, contrast_table
from stampline.plans.registry import query
from stampline.session import pinned

NUMERIC = ["delay_minutes", "hour_of_day", "day_of_week", "days_since_prior", "acuity"]
CATEGORICAL = ["event_type"]


def matrix(spark, sf, label):
    """Feature matrix of one label, written once because every boosting round reads it."""
    feats = featured(spark, sf).select("item_id", "entity_id", "split", *NUMERIC, *CATEGORICAL)
    rows = feats.join(v.wide_labels(spark, sf).select("item_id", label), "item_id")
    return pinned(rows.where(F.col(label) != -999))


@query("g1_prevalence_arm", v.with_views("horizon_labels", """
select label, item_id, y, round(score, 6) as score from (select * from horizon_labels where y >= 0)
join (select h.label, avg(y) as score from horizon_labels h join records using (item_id)
      where split = 'train' and y >= 0 group by h.label) using (label)
join records using (item_id) where split = 'test'"""))
def g1(spark, sf):
    rows = v.horizon_labels(spark, sf).where(F.col("y") >= 0) \
        .join(v.base_records(spark, sf).select("item_id", "split"), "item_id")
    return g.prevalence_arm(rows, "y", "split", ["label"]).where(F.col("split") == "test") \
        .select("label", "item_id", "y", r("score"))


@query("g2_fit_gbt_arm", v.with_views("wide_labels", """
select item_id, h24::int as y, true as score_in_range
from wide_labels join records using (item_id) where split = 'test' and h24 <> -999"""))
def g2(spark, sf):
    """Test rows, outcomes and whether each has a probability; the probabilities themselves no SQL can give."""
    data = matrix(spark, sf, "h24")
    model = g.fit_gbt_arm(data, "h24", NUMERIC, CATEGORICAL, "split", {"num_leaves": 15}, max_iter=ROUNDS)
    out = g.predict(model, data.where(F.col("split") == "test"), "h24", NUMERIC, CATEGORICAL, ["item_id"])
    return out.select("item_id", "y", F.coalesce(F.col("score").between(0, 1), F.lit(False)).alias("score_in_range"))


#: Rounds of the single fit, and trials and rounds of the searches: declared, far below a full search, which is
#: a matter of parameters (`random_search(..., budget=50, max_iter=...)`).
ROUNDS, TRIALS, TRIAL_ROUNDS = 10, 2, 3


def search_sql(labels: list[str]) -> str:
    """The drawn trials, labels with both classes in the validation split, and that exactly one trial is best."""
    drawn = ", ".join("(" + ", ".join([str(i), *(f"{float(t[k])!r}::double" for k in g.SEARCH_SPACE)]) + ")"
                      for i, t in enumerate(g.trials(TRIALS)))
    both = " + ".join(f"(select (count(distinct {h}) = 2)::int from wide_labels join records using (item_id) "
                      f"where split = 'val' and {h} <> -999)" for h in labels)
    return v.with_views("wide_labels", f"""
select t.*, s.n_labels, s.n_labels > 0 as scored, case when s.n_labels > 0 then 1 else 0 end::bigint as n_best
from (values {drawn}) t(trial, {", ".join(g.SEARCH_SPACE)}), (select ({both})::bigint as n_labels) s""")


def search_facts(out):
    n_best = F.sum(F.col("best").cast("bigint")).over(Window.partitionBy(F.lit(0)))  # one row per trial
    return out.select("trial", *g.SEARCH_SPACE, "n_labels",
                      F.coalesce(F.col("val_auroc").between(0, 1), F.lit(False)).alias("scored"), n_best.alias("n_best"))


@query("g3_random_search", search_sql(["h24"]))
def g3(spark, sf):
    return search_facts(g.random_search(matrix(spark, sf, "h24"), "h24", NUMERIC, CATEGORICAL, "split", TRIALS,
                                        max_iter=TRIAL_ROUNDS))


@query("g4_random_search_shared", search_sql(["h6", "h24", "h72"]))
def g4(spark, sf):
    every = {h: matrix(spark, sf, h) for h in ("h6", "h24", "h72")}
    return search_facts(g.search_shared(every, NUMERIC, CATEGORICAL, "split", TRIALS, max_iter=TRIAL_ROUNDS))


@query("g5_score_arm", v.with_views("pooled", """
select arm, label, round(auroc, 6) as auroc, round(auprc, 6) as auprc, round(brier, 6) as brier, n_items, n_positives,
       round(n_positives / n_items, 6) as prevalence
from a join (select arm, label, sum(p * (cp / cn)) / sum(p) as auprc from (
  select arm, label, p, sum(p) over w as cp, sum(n) over w as cn from (
    select arm, label, score, sum(y)::double as p, count(*)::double as n from pooled group by arm, label, score)
  window w as (partition by arm, label order by score desc)) group by arm, label) using (arm, label)
join (select arm, label, avg((score - y) * (score - y)) as brier, count(*) as n_items, sum(y)::bigint as n_positives
      from pooled group by arm, label) using (arm, label)""",
       v.auroc_sql("(select 1 as w, * from pooled)", "arm, label", "a")))
def g5(spark, sf):
    out = g.score_arm(pinned(pooled(spark, sf)), ["arm", "label"])
    return out.select("arm", "label", r("auroc"), r("auprc"), r("brier"), "n_items", "n_positives", r("prevalence"))


#: Declared cells of the run check: role and turn (fixed values).
DECLARED = [(role, turn) for role in ("user", "assistant") for turn in range(6)]


@query("g6_declared_membership", """
select conv_id, role as arm, turn as label from conversations
where not (role in ('user', 'assistant') and turn < 6)""")
def g6(spark, sf):
    runs = v.table(spark, sf, "conversations").select("conv_id", F.col("role").alias("arm"), F.col("turn").alias("label"))
    return g.declared_membership(runs, spark.createDataFrame(DECLARED, "arm string, label bigint"), ["arm", "label"])


def required_cells(spark):
    arms = [(a, h) for a in ("prev", "ctx", "sig", "wide") for h in ("h6", "h24", "h72")]
    return spark.createDataFrame(arms, "arm string, label string")


def seed_cells(preds):
    """Cells and their seed counts; one cell is short of a seed on purpose."""
    return preds.where(~((F.col("arm") == "ctx") & (F.col("label") == "h6") & (F.col("seed") == 4))) \
        .groupBy("arm", "label").agg(F.countDistinct("seed").alias("n_seeds"))


_REQ = ", ".join(f"('{a}', '{h}')" for a in ("prev", "ctx", "sig", "wide") for h in ("h6", "h24", "h72"))
GATE = f"""
cells as (select arm, label, count(distinct seed) as n_seeds from predictions
          where not (arm = 'ctx' and label = 'h6' and seed = 4) group by arm, label),
req as (select * from (values {_REQ}) x(arm, label)),
prob as (select arm, label, 'missing' as problem, 0::bigint as n_seeds from req
         where (arm, label) not in (select (arm, label) from cells)
         union all select arm, label, 'seeds short', n_seeds from cells where n_seeds < 5)"""


@query("g7_completeness_gate", v.with_views("predictions", "select arm, label, problem, n_seeds from prob", GATE))
def g7(spark, sf):
    return g.completeness_gate(seed_cells(v.predictions(spark, sf)), required_cells(spark))


@query("g7_gate_verdict", v.with_views("predictions", """
select (select count(*) from req) as n_required, count(*) filter (problem = 'missing') as n_missing,
       count(*) filter (problem = 'seeds short') as n_short, true as floors_measured, 'INCOMPLETE' as result
from prob""", GATE))
def g7_verdict(spark, sf):
    preds = v.predictions(spark, sf)
    required = required_cells(spark)
    problems = g.completeness_gate(seed_cells(preds), required)
    return g.gate_verdict(problems, required, d.seed_spread(preds, list(v.SEEDS), ["arm", "label"]))


@query("g8_tolerance_branch", v.with_views("pooled", """
select label, round(c, 6) as arm_auroc, round(s, 6) as reference_auroc, round(s - c, 6) as gap, s - c <= 0.2 as within_tolerance
from (select label, max(auroc) filter (arm = 'ctx') as c, max(auroc) filter (arm = 'sig') as s from a group by label)""",
       v.auroc_sql("(select 1 as w, * from pooled)", "arm, label", "a")))
def g8(spark, sf):
    out = g.tolerance_branch(d.auroc(pooled(spark, sf), "y", "score", ["arm", "label"]), "ctx", "sig", 0.2)
    return out.select("label", r("arm_auroc"), r("reference_auroc"), r("gap"), "within_tolerance")


#: Published anchors of the reproduction check (fixed values).
ANCHORS = [("version of record", "primary", 0.8565, 0.8475, 0.8655), ("wide", "secondary", 0.8, 0.5, 0.9)]


@query("g9_reproduction_gap", v.with_views("predictions", """
select arm, anchor, role, round(local_mean, 6) as local_mean, round(local_min, 6) as local_min,
       round(local_max, 6) as local_max, round(local_max - local_min, 6) as seed_spread, n_seeds,
       round(local_mean - published, 6) as gap, local_mean between lo and hi as inside_published
from (select arm, avg(macro) as local_mean, min(macro) as local_min, max(macro) as local_max, count(*) as n_seeds
      from (select arm, seed, avg(auroc) as macro from a group by arm, seed) group by arm),
     (values ('version of record', 'primary', 0.8565::double, 0.8475::double, 0.8655::double),
             ('wide', 'secondary', 0.8::double, 0.5::double, 0.9::double)) x(anchor, role, published, lo, hi)""",
       v.auroc_sql("(select 1 as w, * from predictions)", "arm, seed, label", "a")))
def g9(spark, sf):
    macro = d.macro_auroc(v.predictions(spark, sf), "label", ["arm", "seed"])
    anchors = spark.createDataFrame(ANCHORS, "anchor string, role string, published double, lo double, hi double")
    out = g.reproduction_gap(macro, anchors, ["arm"])
    return out.select("arm", "anchor", "role", r("local_mean"), r("local_min"), r("local_max"), r("seed_spread"),
                      "n_seeds", r("gap"), "inside_published")


@query("g10_sparse_targets", """
select source as target, min(n)::bigint as min_positives from (
  select source, lang, count(*) filter (toxic = 1) as n from documents join labels using (doc_id) group by source, lang)
group by source having min(n) < 2""")
def g10(spark, sf):
    """Sources as targets, languages as runs: where toxic documents are rare."""
    docs = v.table(spark, sf, "documents").select("doc_id", F.col("source").alias("target"), "lang") \
        .join(v.table(spark, sf, "labels"), "doc_id")
    per = docs.groupBy("target", "lang").agg(F.count_if(F.col("toxic") == 1).alias("n_pos"))
    return g.sparse_targets(per, "target", 2)


PANEL = ", ".join(f"max(case when label = '{h}' then round({c}, 6) end) as {n}__{h}"
                  for h in ("h6", "h24", "h72") for n, c in (("auroc", "estimate"), ("lo", "ci_lo"), ("hi", "ci_hi")))


@query("i1_result_panels", v.with_views("pooled", f"""
select arm, {PANEL} from ({v.summary_sql('a', 'arm, label', B, 'auroc')}) group by arm""", arms_ctes("'ctx','sig','prev'")))
def i1(spark, sf):
    ci = inf.clustered_auroc_ci(pooled(spark, sf), "y", "score", "entity_id", ["arm", "label"], B) \
        .select("arm", "label", r("auroc"), r("ci_lo"), r("ci_hi"))
    return rep.arm_panel(ci, ["h6", "h24", "h72"], {"auroc": "auroc", "lo": "ci_lo", "hi": "ci_hi"})


@query("i1_contrast_panel", v.with_views("pooled", """
select hm.arm_a, hm.arm_b, hm.label, round(difference, 6) as difference, round(p_value, 6) as p_value,
       round(p_holm, 6) as p_holm, round(greatest(x.sp, z.sp), 6) as noise_floor,
       abs(difference) > greatest(x.sp, z.sp) as clears_noise_floor
from (select *, estimate as difference from hm) hm join sp x on x.arm = hm.arm_a and x.label = hm.label
join sp z on z.arm = hm.arm_b and z.label = hm.label""",
       CONTRAST_CTES + "," + HOLM_SQL.format(order="arm_a, arm_b, label", source="ct", m=FAMILY) + ","
       + v.auroc_sql("(select 1 as w, * from predictions)", "arm, label, seed", "sa") + """,
sp as (select arm, label, max(auroc) - min(auroc) as sp from sa group by arm, label)"""))
def i1_contrasts(spark, sf):
    preds = v.predictions(spark, sf)
    pool = d.seed_pool(preds, list(v.SEEDS), ["arm", "label"], carry=["entity_id", "y"], digits=9)
    keys = ["arm_a", "arm_b", "label"]
    contrasts = pinned(contrast_table(pool))
    floors = inf.noise_floor(d.seed_spread(preds, list(v.SEEDS), ["arm", "label"]), contrasts.select(*keys, "difference"),
                             ["label"]).select(*keys, "noise_floor", "clears_noise_floor")
    holm = inf.holm(contrasts.select(*keys, "p_value"), "p_value", FAMILY, B, order=keys).select(*keys, "p_holm")
    out = rep.contrast_panel(contrasts, floors, holm, keys)
    return out.select(*keys, r("difference"), r("p_value"), r("p_holm"), r("noise_floor"), "clears_noise_floor")


@query("i1_declared_and_sensitivity", v.with_views("pooled strata", """
select label, arm, round(auroc, 6) as auroc, spec from (
  select label, arm, auroc, 'declared' as spec from a union all select label, arm, auroc, 'weekday rows' from b)""",
       v.auroc_sql("(select 1 as w, * from pooled)", "label, arm", "a") + ","
       + v.auroc_sql("(select 1 as w, p.* from pooled p join strata s using (item_id) where right(s.stratum, 1) = '0')",
                     "label, arm", "b")))
def i1_sensitivity(spark, sf):
    pool = pinned(pooled(spark, sf))
    weekday = pool.join(v.strata(spark, sf).where(F.col("stratum").endswith("0")), "item_id", "left_semi")
    by = ["label", "arm"]
    out = rep.declared_and_sensitivity(d.auroc(pool, "y", "score", by),
                                       {"weekday rows": d.auroc(weekday, "y", "score", by)}, [*by, "auroc"])
    return out.select(*by, r("auroc"), "spec")


SPECS = [
    rep.CellSpec("main", "sig h24", "arms", (("arm", "sig"), ("label", "h24")), "auroc"),
    rep.CellSpec("main", "ctx mean", "arms", (("arm", "ctx"),), "auroc", "mean"),
    rep.CellSpec("noise", "sig range", "seeds", (("arm", "sig"), ("label", "h24")), "auroc", "range"),
    rep.CellSpec("noise", "largest", "seeds", (), "auroc", "absmax"),
]


@query("i2_cell_index", v.with_views("pooled", """
select "table", row_key, source, selector, 'auroc' as "column", aggregate, round(value, 6) as value, n_rows, true as matches from (
  select 'main' as "table", 'sig h24' as row_key, 'arms' as source, 'arm=sig;label=h24' as selector, 'none' as aggregate,
         max(auroc) as value, count(*) as n_rows from a where arm = 'sig' and label = 'h24'
  union all select 'main', 'ctx mean', 'arms', 'arm=ctx', 'mean', avg(auroc), count(*) from a where arm = 'ctx'
  union all select 'noise', 'sig range', 'seeds', 'arm=sig;label=h24', 'range', max(auroc) - min(auroc), count(*)
            from sa where arm = 'sig' and label = 'h24'
  union all select 'noise', 'largest', 'seeds', '', 'absmax', max(abs(auroc)), count(*) from sa)""",
       v.auroc_sql("(select 1 as w, * from pooled)", "arm, label", "a") + ","
       + v.auroc_sql("(select 1 as w, * from predictions)", "arm, label, seed", "sa")))
def i2(spark, sf):
    preds = v.predictions(spark, sf)
    pool = d.seed_pool(preds, list(v.SEEDS), ["arm", "label"], carry=["entity_id", "y"], digits=9)
    sources = {"arms": pinned(d.auroc(pool, "y", "score", ["arm", "label"])),
               "seeds": pinned(d.auroc(preds, "y", "score", ["arm", "label", "seed"]))}
    out = rep.rederive(rep.cell_index(sources, SPECS), sources, SPECS)
    return out.withColumn("value", F.round("value", 6))
