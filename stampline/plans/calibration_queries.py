"""Queries for calibration and decision analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from stampline.operators import calibration as cal
from stampline.operators import decision as dec
from stampline.plans import views as v
from stampline.plans.discrimination_queries import pooled, r
from stampline.plans.registry import query
from stampline.session import pinned

#: Bins and replicates as declared.
K = 15
B = 10_000
DRAWS = 400
WIDTH = f"least({K - 1}, greatest(0, floor(p * {K})))::int"
MASS = f"(ceil({K} * (rank() over (partition by {{k}} order by p))::double / count(*) over (partition by {{k}})) - 1)::int"
BINNED = f"""
binned as (select 'equal_width' as scheme, label, doc_id, source, y, p, {WIDTH} as bin from docs
           union all select 'equal_mass', label, doc_id, source, y, p, {MASS.format(k='label')} from docs)"""
CURVE = BINNED + """,
curve as (select scheme, label, bin, count(*) as n, avg(p) as mean_predicted, avg(y) as observed_rate,
                 avg(y) - avg(p) as gap from binned group by scheme, label, bin),
ece as (select scheme, label, sum(n * abs(gap)) / sum(n) as ece from curve group by scheme, label)"""


def both_schemes(fn):
    """Run fn(scheme) for each binning scheme and tag the rows."""
    out = None
    for scheme in cal.SCHEMES:
        one = fn(scheme).withColumn("scheme", F.lit(scheme))
        out = one if out is None else out.unionByName(one)
    return out


@query("f1_equal_width_bin", v.with_views("docs", f"select label, doc_id, {WIDTH} as bin from docs"))
def f1(spark, sf):
    return cal.equal_width_bin(v.scored_documents(spark, sf), "p", K).select("label", "doc_id", "bin")


@query("f2_equal_mass_bin", v.with_views("docs", f"select label, doc_id, {MASS.format(k='label')} as bin from docs"))
def f2(spark, sf):
    return cal.equal_mass_bin(v.scored_documents(spark, sf), "p", K, ["label"]).select("label", "doc_id", "bin")


@query("f3_reliability", v.with_views("docs", """
select scheme, label, bin, n, round(mean_predicted, 10) as mean_predicted, round(observed_rate, 10) as observed_rate,
       round(gap, 10) as gap from curve""", CURVE))
def f3(spark, sf):
    docs = v.scored_documents(spark, sf)
    return both_schemes(lambda s: cal.reliability(docs, "y", "p", K, s, ["label"])).select(
        "scheme", "label", "bin", "n", *[F.round(c, 10).alias(c) for c in ("mean_predicted", "observed_rate", "gap")])


@query("f4_ece", v.with_views("docs", "select scheme, label, round(ece, 6) as ece from ece", CURVE))
def f4(spark, sf):
    docs = v.scored_documents(spark, sf)
    return both_schemes(lambda s: cal.ece(docs, "y", "p", K, s, ["label"])).select("scheme", "label", r("ece"))


REBIN = v.draws_sql("select source as entity from docs", B) + """,
j as (select d.rep, c.label, c.p, sum(d.w * c.n)::double as n, sum(d.w * c.pos)::double as pos
      from (select label, source, p, count(*) as n, sum(y) as pos from docs group by all) c
      join draws d on d.entity = c.source group by all),
jb as (select *, 'equal_width' as scheme, """ + WIDTH + """ as bin from j
       union all select *, 'equal_mass', (ceil(""" + str(K) + """ * (coalesce(sum(n) over (partition by rep, label order by p
         rows between unbounded preceding and 1 preceding), 0) + 1) / sum(n) over (partition by rep, label)) - 1)::int from j),
re as (select rep, scheme, label, sum(n * abs(g)) / sum(n) as value from (
         select rep, scheme, label, bin, sum(n) as n, sum(pos) / sum(n) - sum(n * p) / sum(n) as g
         from jb group by rep, scheme, label, bin) group by rep, scheme, label)"""


@query("f5_ece_ci", v.with_views("docs", f"""
select scheme, label, round(estimate, 6) as ece, round(ci_lo, 6) as ci_lo, round(ci_hi, 6) as ci_hi, n_boot, n_finite,
       estimate < ci_lo as point_below_ci_lo, (select count(distinct source) from docs) as n_groups
from ({v.summary_sql('re', 'scheme, label', B)})""", REBIN))
def f5(spark, sf):
    docs = v.scored_documents(spark, sf)
    return both_schemes(lambda s: cal.ece_ci(docs, "y", "p", "source", K, s, ["label"], B)).select(
        "scheme", "label", r("estimate", "ece"), r("ci_lo"), r("ci_hi"), "n_boot", "n_finite",
        "point_below_ci_lo", "n_groups")


@query("f5_ece_seed_spread", v.with_views("predictions", f"""
select arm, label, count(*) as n_seeds, round(avg(ece), 6) as seed_ece_mean, round(min(ece), 6) as seed_ece_min,
       round(max(ece), 6) as seed_ece_max, round(max(ece) - min(ece), 6) as seed_ece_spread,
       round(max(mp), 6) as mean_predicted, round(max(ob), 6) as observed_rate
from (select arm, label, seed, sum(n * abs(gap)) / sum(n) as ece from (
        select arm, label, seed, {WIDTH.replace('p *', 'score *')} as bin, count(*) as n,
               avg(y) - avg(score) as gap from predictions where y in (0, 1) group by all) group by all)
join (select arm, label, avg(score) as mp, avg(y) as ob from predictions where y in (0, 1) group by all) using (arm, label)
group by arm, label"""))
def f5_seeds(spark, sf):
    out = cal.ece_seed_spread(v.predictions(spark, sf), "y", "score", K, "equal_width", ["arm", "label"])
    return out.select("arm", "label", "n_seeds", *[r(c) for c in ("seed_ece_mean", "seed_ece_min", "seed_ece_max",
                                                                 "seed_ece_spread", "mean_predicted", "observed_rate")])


NULLS = CURVE + f""",
nd as (select scheme, label, draw, sum(n * abs(yy - pp)) / sum(n) as value from (
         select scheme, label, b.range as draw, bin, count(*) as n, avg(p) as pp,
                avg((('0x' || substr(md5('1|' || b.range || '|' || doc_id), 1, 8))::bigint / 4294967296.0::double < p)::int) as yy
         from binned, range({DRAWS}) b group by all) group by all),
nb as (select scheme, label, quantile_cont(value, 0.025) as null_lo, quantile_cont(value, 0.975) as null_hi
       from nd group by scheme, label)"""


@query("f6_ece_null_band", v.with_views("docs", """
select scheme, label, round(ece, 6) as ece, round(null_lo, 6) as null_lo, round(null_hi, 6) as null_hi,
       ece between null_lo and null_hi as inside_null_band from ece join nb using (scheme, label)""", NULLS))
def f6(spark, sf):
    docs = v.scored_documents(spark, sf)
    return both_schemes(lambda s: cal.ece_null_band(docs, "y", "p", "doc_id", K, s, ["label"], DRAWS, 1)).select(
        "scheme", "label", r("ece"), r("null_lo"), r("null_hi"), "inside_null_band")


@query("f7_bin_occupancy", v.with_views("docs", f"""
select scheme, label, {K}::bigint as n_bins, count(*) as n_occupied, min(n) as count_min, max(n) as count_max
from curve group by scheme, label""", CURVE))
def f7(spark, sf):
    docs = v.scored_documents(spark, sf)
    return both_schemes(lambda s: cal.bin_occupancy(cal.reliability(docs, "y", "p", K, s, ["label"]), ["label"], K))


def newton_sql(source: str, keys: str, slope: bool, name: str, steps: int = 15) -> str:
    """CTE {name} (keys, a, b): plain Newton unrolled over `source` (keys, x, n, pos)."""
    out = [f"{name}_0 as materialized (select distinct {keys}, 0.0::double as a, {0 if slope else 1}::double as b from {source})"]
    for i in range(steps):
        step = ("a + coalesce((h11 * g0 - h01 * g1) / nullif(h00 * h11 - h01 * h01, 0), 0) as a, "
                "b + coalesce((h00 * g1 - h01 * g0) / nullif(h00 * h11 - h01 * h01, 0), 0) as b" if slope
                else "a + coalesce(g0 / nullif(h00, 0), 0) as a, b")
        out.append(f"""{name}_{i + 1} as materialized (select {keys}, {step} from (
  select {keys}, a, b, sum(pos - n * mu) as g0, sum((pos - n * mu) * x) as g1, sum(n * mu * (1 - mu)) as h00,
         sum(n * mu * (1 - mu) * x) as h01, sum(n * mu * (1 - mu) * x * x) as h11
  from (select *, 1.0::double / (1.0::double + exp(-(a + b * x))) as mu from {source} join {name}_{i} using ({keys}))
  group by {keys}, a, b))""")
    out.append(f"{name} as (select * from {name}_{steps})")
    return ",\n".join(out)


LOGIT = "ln(least(1 - 1e-12, greatest(1e-12, p)) / (1 - least(1 - 1e-12, greatest(1e-12, p))))"
CELLS = f"""
cells as materialized (select label, p, {LOGIT} as x, count(*)::double as n, sum(y)::double as pos
                       from docs group by label, p),"""
REP_CELLS = v.draws_sql("select source as entity from docs", B) + f""",
rcells as materialized (select rep, label, p, {LOGIT} as x, sum(w * n)::double as n, sum(w * pos)::double as pos
  from (select label, source, p, count(*) as n, sum(y) as pos from docs group by all) c
  join draws on entity = source group by rep, label, p),"""


@query("f8_calibration_intercept", v.with_views("docs", "select label, round(a, 6) as intercept from fit",
                                                CELLS + newton_sql("cells", "label", False, "fit")))
def f8(spark, sf):
    return cal.calibration_intercept(v.scored_documents(spark, sf), "y", "p", ["label"]).select("label", r("intercept"))


@query("f9_calibration_slope", v.with_views("docs", "select label, round(b, 6) as slope from fit",
                                            CELLS + newton_sql("cells", "label", True, "fit")))
def f9(spark, sf):
    return cal.calibration_slope(v.scored_documents(spark, sf), "y", "p", ["label"]).select("label", r("slope"))


@query("f10_calibration_fit_ci", v.with_views("docs", f"""
select label, quantity, round(estimate, 6) as estimate, round(ci_lo, 6) as ci_lo, round(ci_hi, 6) as ci_hi, n_boot,
       n_boot - n_finite as n_undefined from ({v.summary_sql('q', 'label, quantity', B)})""",
       REP_CELLS + newton_sql("rcells", "rep, label", False, "fa") + ",\n"
       + newton_sql("rcells", "rep, label", True, "fb") + """,
q as (select rep, label, 'intercept' as quantity, a as value from fa union all select rep, label, 'slope', b from fb
      union all select rep, label, 'brier', sum(pos * (1 - p) * (1 - p) + (n - pos) * p * p) / sum(n)
      from rcells group by rep, label)"""))
def f10(spark, sf):
    out = cal.calibration_fit_ci(v.scored_documents(spark, sf), "y", "p", "source", ["label"], B)
    return out.select("label", "quantity", r("estimate"), r("ci_lo"), r("ci_hi"), "n_boot", "n_undefined")


GRID = dec.grid(0.01, 0.5, 0.01)
_T = ", ".join(f"({t}::double)" for t in GRID)


@query("f11_net_benefit_curve", v.with_views("pooled", f"""
select arm, label, t as threshold,
       round(avg((score >= t and y = 1)::int) - avg((score >= t and y = 0)::int) * (t / (1 - t)), 6) as net_benefit,
       round(avg(y) - avg(1 - y) * (t / (1 - t)), 6) as treat_all, 0.0::double as treat_none,
       round(avg((score >= t)::int), 6) as flagged_share, round(avg(y), 6) as prevalence
from pooled, (values {_T}) g(t) group by arm, label, t"""))
def f11(spark, sf):
    out = dec.net_benefit_curve(pooled(spark, sf), "y", "score", GRID, ["arm", "label"])
    return out.select("arm", "label", "threshold", r("net_benefit"), r("treat_all"), "treat_none",
                      r("flagged_share"), r("prevalence"))


NB = "tp / n - fp / n * (0.3::double / 0.7::double)"


@query("f12_net_benefit_at", v.with_views("pooled", f"""
select arm, label, round(s.estimate, 6) as net_benefit, round(s.ci_lo, 6) as ci_lo, round(s.ci_hi, 6) as ci_hi,
       round(o.all_nb, 6) as treat_all, round(d.estimate, 6) as vs_treat_all, round(d.ci_lo, 6) as vs_treat_all_lo,
       round(d.ci_hi, 6) as vs_treat_all_hi, d.ci_lo > 0 as beats_treat_all, s.ci_lo > 0 as beats_treat_none,
       round((tp + fp) / n, 6) as flagged_share, round(pos / n, 6) as prevalence,
       round(seed_nb_min, 6) as seed_nb_min, round(seed_nb_max, 6) as seed_nb_max,
       round(seed_nb_max - seed_nb_min, 6) as seed_nb_spread
from ({v.summary_sql('nb', 'arm, label', B)}) s
join ({v.summary_sql('(select *, value - all_nb as diff from nb)', 'arm, label', B, 'diff')}) d using (arm, label)
join nb o using (arm, label) join sd using (arm, label) where o.rep = -1""",
       v.draws_sql("select entity_id as entity from pooled", B) + f""",
ec as (select arm, label, entity_id, count(*) as n, sum(y) as pos, count(*) filter (score >= 0.3 and y = 1) as tp,
              count(*) filter (score >= 0.3 and y = 0) as fp from pooled group by all),
nb as (select *, {NB} as value, pos / n - (n - pos) / n * (0.3::double / 0.7::double) as all_nb from (
       select rep, arm, label, sum(w * n)::double as n, sum(w * pos)::double as pos, sum(w * tp)::double as tp,
              sum(w * fp)::double as fp from ec join draws on entity = entity_id group by rep, arm, label)),
sd as (select arm, label, min(v) as seed_nb_min, max(v) as seed_nb_max from (
       select arm, label, seed, {NB} as v from (select arm, label, seed, count(*)::double as n,
         count(*) filter (score >= 0.3 and y = 1) as tp, count(*) filter (score >= 0.3 and y = 0) as fp
         from predictions group by all)) group by all)"""))
def f12(spark, sf):
    preds = v.predictions(spark, sf)
    from stampline.operators.discrimination import seed_pool

    pool = seed_pool(preds, list(v.SEEDS), ["arm", "label"], carry=["entity_id", "y"], digits=9)
    out = dec.net_benefit_at(pool, preds, "y", "score", 0.3, "entity_id", ["arm", "label"], B)
    return out.select("arm", "label", r("net_benefit"), r("ci_lo"), r("ci_hi"), r("treat_all"), r("vs_treat_all"),
                      r("vs_treat_all_lo"), r("vs_treat_all_hi"), "beats_treat_all", "beats_treat_none",
                      r("flagged_share"), r("prevalence"), r("seed_nb_min"), r("seed_nb_max"), r("seed_nb_spread"))


@query("f13_usable_probability_verdict", v.with_views("docs", """
select label, usable_probabilities, n_schemes, round(net_benefit, 6) as net_benefit,
       (row_number() over (order by net_benefit desc, label))::int as place
from (select label, bool_and(ece between null_lo and null_hi) as usable_probabilities, count(*) as n_schemes
      from ece join nb using (scheme, label) group by label)
join (select label, avg((p >= 0.1 and y = 1)::int) - avg((p >= 0.1 and y = 0)::int) * (0.1::double / 0.9::double) as net_benefit
      from docs group by label) using (label)""", NULLS))
def f13(spark, sf):
    docs = v.scored_documents(spark, sf)
    bands = both_schemes(lambda s: cal.ece_null_band(docs, "y", "p", "doc_id", K, s, ["label"], DRAWS, 1))
    benefit = dec.net_benefit_curve(docs, "y", "p", [0.1], ["label"]).select("label", "net_benefit")
    out = dec.usable_probability_verdict(bands, benefit, ["label"])
    return out.select("label", "usable_probabilities", "n_schemes", r("net_benefit"), "place")
