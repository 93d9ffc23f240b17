"""Queries for the signal jobs, on embeddings read as 4 leads of 16 samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from stampline.operators import signals as s
from stampline.plans import views as v
from stampline.plans.registry import query

N, LEN = 4, 16
NAMES = ["I", "II", "aVR", "V1"]


def recordings(spark, sf, gaps=True):
    """(vec_id, leads): the vector times ten, cut into leads, with regular gaps."""
    emb = v.table(spark, sf, "embeddings")
    value = lambda x, i: F.when((i % 7 != F.col("vec_id") % 7) | F.lit(not gaps), x.cast("double") * 10)
    flat = F.transform("embedding", value)
    cut = F.array(*[F.slice(flat, k * LEN + 1, LEN) for k in range(N)])
    return emb.select("vec_id", cut.alias("leads"))


def samples(df, *keep, leads="leads"):
    """One row per sample: (keys, lead, pos, value)."""
    return df.select(*keep, F.posexplode(leads).alias("lead", "_c")) \
        .select(*keep, "lead", F.posexplode("_c").alias("pos", "value"))


FLAT = """
smp as (select vec_id, (i - 1) // 16 as lead, (i - 1) % 16 as pos,
               case when (i - 1) % 7 <> vec_id % 7 then embedding[i]::double * 10 end as raw
        from embeddings, range(1, 65) t(i)),
nn as (select *, max(case when raw is not null then pos end) over (w rows between unbounded preceding and current row) as lo,
              min(case when raw is not null then pos end) over (w rows between current row and unbounded following) as hi
       from smp window w as (partition by vec_id, lead order by pos)),
cl as (select n.vec_id, n.lead, n.pos, n.raw,
              case when lo is not null then greatest(-3.0::double, least(3.0::double, case when n.raw is not null then n.raw
                when hi is null then a.raw else a.raw + (b.raw - a.raw) * (n.pos - lo) / (hi - lo) end)) end as value
       from nn n left join smp a on a.vec_id = n.vec_id and a.lead = n.lead and a.pos = lo
       left join smp b on b.vec_id = n.vec_id and b.lead = n.lead and b.pos = hi)"""


@query("h1_signal_clean", v.with_views("", """
select vec_id, lead::int as lead, pos::int as pos, round(value, 6) as value from cl""", FLAT))
def h1(spark, sf):
    return samples(s.signal_clean(recordings(spark, sf)), "vec_id") \
        .withColumn("value", F.round("value", 6))


_TAPS = s.fir_taps(2)
_TAPVALUES = ", ".join(f"({i}, {t!r}::double)" for i, t in enumerate(_TAPS))


@query("h2_signal_decimate", v.with_views("", f"""
select c.vec_id, c.lead::int as lead, j::int as pos, round(sum(t.w * x.raw), 6) as value
from (select distinct vec_id, lead from s2) c, range(8) o(j), (values {_TAPVALUES}) t(k, w)
join s2 x on x.vec_id = c.vec_id and x.lead = c.lead and x.pos = greatest(0, least(15, j * 2 + t.k - {len(_TAPS) // 2}))
group by c.vec_id, c.lead, j""", """
s2 as (select vec_id, (i - 1) // 16 as lead, (i - 1) % 16 as pos, embedding[i]::double * 10 as raw
       from embeddings, range(1, 65) t(i))"""))
def h2(spark, sf):
    return samples(s.signal_decimate(recordings(spark, sf, gaps=False), 2), "vec_id") \
        .withColumn("value", F.round("value", 6))


@query("h3_leads_by_name", v.with_views("", """
select vec_id, o.lead::int as lead, p.pos::int as pos, round(case when o.src is null then 0.0::double
         else embedding[o.src * 16 + p.pos + 1]::double * 10 end, 6) as value,
       case when vec_id % 4 = 3 then 3 else 4 end::int as leads_mapped
from (select vec_id, embedding, l.lead,
             case when vec_id % 4 = 3 and l.lead = 1 then null
                  else (3 - l.lead + vec_id % 4) % 4 end as src
      from embeddings, (values (0), (1), (2), (3)) l(lead)) o, range(16) p(pos)"""))
def h3(spark, sf):
    """Channel k carries name (3 - k + vec_id) mod 4 in mixed case; every fourth record mislabels one."""
    rec = recordings(spark, sf, gaps=False)
    names = F.array(*[F.lit(n.upper()) for n in NAMES])

    def name_at(k):
        i = ((3 - k + F.col("vec_id")) % 4).cast("int")
        n = F.when((F.col("vec_id") % 4 == 3) & (i == 1), F.lit("x9")).otherwise(names[i])
        return F.when(F.col("vec_id") % 2 == 0, F.lower(n)).otherwise(n)

    rec = rec.withColumn("names", F.array(*[name_at(k) for k in range(N)]))
    return samples(s.leads_by_name(rec, NAMES), "vec_id", "leads_mapped").withColumn("value", F.round("value", 6))


@query("h4_signal_stats", v.with_views("", """
select vec_id, count(*) filter (raw is null)::int as nulls_before, count(*) filter (value is null)::int as nulls_after,
       round(min(value), 6) as amp_min, round(max(value), 6) as amp_max,
       count(distinct lead) filter (value <> 0)::int as leads_nonzero
from cl group by vec_id""", FLAT))
def h4(spark, sf):
    raw = recordings(spark, sf)
    out = s.signal_stats(s.signal_clean(raw.withColumn("raw", F.col("leads"))))
    return out.select("vec_id", "nulls_before", "nulls_after", F.round("amp_min", 6).alias("amp_min"),
                      F.round("amp_max", 6).alias("amp_max"), "leads_nonzero")


@query("h4_signal_totals", v.with_views("", """
select count(*) as n_records, sum(n)::bigint as nulls_after_total, count(*) filter (n > 0) as records_with_residue,
       count(*) filter (nz <> 4) as records_incomplete, count(distinct digest) as n_digests
from (select vec_id, count(*) filter (value is null) as n, count(distinct lead) filter (value <> 0) as nz,
             substr(sha256(string_agg(coalesce(round(value * 1e6)::bigint::varchar, '~'), ',' order by lead, pos)), 1, 16) as digest
      from cl group by vec_id)""", FLAT))
def h4_totals(spark, sf):
    raw = recordings(spark, sf)
    stats = s.signal_stats(s.signal_clean(raw.withColumn("raw", F.col("leads"))))
    digests = stats.agg(F.countDistinct("digest").alias("n_digests"))
    return s.signal_totals(stats, N).crossJoin(digests)


@query("h5_fixed_crops", v.with_views("", """
select vec_id, (pos // 4)::int as crop, lead::int as lead, (pos % 4)::int as pos, round(coalesce(raw, 0), 6) as value from smp""", FLAT))
def h5(spark, sf):
    crops = s.fixed_crops(recordings(spark, sf), 4)
    return samples(crops, "vec_id", "crop", leads="crop_leads").withColumn("value", F.round("value", 6))


@query("h6_hashed_crop", v.with_views("", """
select vec_id, "offset", lead::int as lead, (pos - "offset")::int as pos, round(coalesce(raw, 0), 6) as value
from smp join (select vec_id, floor(('0x' || substr(md5('3|1|' || vec_id), 1, 8))::bigint / 4294967296.0::double * 11)::int as "offset"
               from embeddings) using (vec_id)
where pos between "offset" and "offset" + 5""", FLAT))
def h6(spark, sf):
    crops = s.hashed_crop(recordings(spark, sf), 6, "vec_id", 3, 1)
    return samples(crops, "vec_id", "offset", leads="crop_leads").withColumn("value", F.round("value", 6))
