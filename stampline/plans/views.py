"""Domain views over the test tables, as DataFrames and as SQL for the twin queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stampline.functions.expr import hashed_int, micros
from stampline.functions.ordered import asof, position
from stampline.operators.cohort import assign_split
from stampline.session import pinned

HORIZONS = (6, 24, 72)
SEEDS = (0, 1, 2, 3, 4)
#: Items a task of a table dealt by item may hold; a prediction table has 45 rows for each.
ITEMS_PER_TASK = 50_000
SPLIT = {"train": list(range(18)), "val": [18], "test": [19]}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def base_records(spark: SparkSession, sf: str) -> DataFrame:
    """One row per event with entity, episode, acuity, fold and split."""
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    out = ev.select(
        F.col("event_id").alias("item_id"), F.col("user_id").alias("entity_id"),
        F.col("ts").alias("index_time"), "event_type", "value", k.alias("k"),
        (F.col("user_id") * 1000 + F.dayofyear("ts")).alias("episode_id"),
        F.nullif(k % 6, F.lit(0)).alias("acuity"), (F.col("user_id") % 20).alias("fold"))
    return assign_split(out, "fold", SPLIT)


def records(spark: SparkSession, sf: str, seq: bool = False) -> DataFrame:
    """Records with the episode start, its 90-minute window close and optionally the order."""
    base = base_records(spark, sf)
    first = base.groupBy("episode_id").agg(F.min("index_time").alias("intime"))
    out = base.join(first, "episode_id").withColumn(
        "window_close", F.col("intime") + F.expr("INTERVAL 90 MINUTES"))
    if seq:
        out = position(out, ["episode_id"], micros("index_time"), ["item_id"], "cumcount", "seq")
    return out


def item_labels(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, entity_id, labels): one row per event, labels an array of (label, y) over the horizons.

    y tells of a purchase within the horizon; -999 past the data end.
    """
    rec = base_records(spark, sf).select("item_id", "entity_id", "index_time", "event_type")
    buys = rec.where(F.col("event_type") == "purchase").select("entity_id", F.col("index_time").alias("buy"))
    nxt = asof(rec.select("item_id", "entity_id", "index_time"), buys, ["entity_id"],
               "index_time", "buy", strict=True, direction="forward")
    end = rec.agg(F.max("index_time").alias("data_end"))
    rows = nxt.crossJoin(F.broadcast(end))

    def y(h):
        close = F.col("index_time") + F.expr(f"INTERVAL {h} HOURS")
        return F.when(close > F.col("data_end"), -999).when(F.col("_hit.t") <= close, 1).otherwise(0)

    return rows.select("item_id", "entity_id", F.array(*[
        F.struct(F.lit(f"h{h}").alias("label"), y(h).alias("y")) for h in HORIZONS]).alias("labels"))


def horizon_labels(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, entity_id, label, y) of `item_labels`, a row per label."""
    return item_labels(spark, sf).select("item_id", "entity_id", F.inline("labels"))


def by_item(rows: DataFrame) -> DataFrame:
    """A written table dealt by item, in tasks small enough that rows derived from an item can be grouped where they
    are: grouping by item and more then takes no further shuffle."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ITEMS_PER_TASK))
    return rows.repartition(tasks, "item_id")


def wide_labels(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, h6, h24, h72)."""
    long = horizon_labels(spark, sf)
    return long.groupBy("item_id").agg(
        *[F.max(F.when(F.col("label") == f"h{h}", F.col("y"))).alias(f"h{h}") for h in HORIZONS])


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """(arm, label, seed, item_id, entity_id, y, score) for arms prev, ctx and sig."""
    lab = item_labels(spark, sf).withColumn("labels", F.filter("labels", lambda x: x["y"] >= 0))
    rec = base_records(spark, sf).select("item_id", "acuity", "split")
    rows = pinned(lab.where(F.size("labels") > 0).join(rec, "item_id"))  # the labelled cohort is a written table
    train = rows.where(F.col("split") == "train").select(F.inline("labels")).groupBy("label") \
        .agg(F.round(F.avg("y"), 9).alias("prev"))

    def h(tag):
        return hashed_int(F.lit(tag), F.col("seed"), F.col("item_id")).alias(tag)

    # A seed's hashes serve all labels of the item.
    seeds = by_item(rows).select("item_id", "entity_id", "labels", "acuity", F.explode(F.array(*[F.lit(s) for s in SEEDS])).alias("seed"))
    grid = seeds.select("item_id", "entity_id", "labels", "acuity", "seed", h("ctx"), h("sig")) \
        .select("item_id", "entity_id", "acuity", "seed", "ctx", "sig", F.inline("labels")).join(F.broadcast(train), "label")
    ctx = ((5 - F.coalesce("acuity", F.lit(3))) * 10 + 5 * F.col("y") + F.col("ctx") % 20) / 100.0
    sig = (30 * F.col("y") + F.col("sig") % 70) / 100.0
    arms = F.explode(F.array(F.struct(F.lit("prev").alias("arm"), F.col("prev").alias("score")),
                             F.struct(F.lit("ctx").alias("arm"), ctx.alias("score")),
                             F.struct(F.lit("sig").alias("arm"), sig.alias("score")))).alias("a")
    return grid.select("item_id", "entity_id", "label", "seed", "y", arms) \
        .select(F.col("a.arm").alias("arm"), "label", "seed", "item_id", "entity_id", "y",
                F.col("a.score").alias("score"))


def crop_predictions(spark: SparkSession, sf: str, crops: int = 4) -> DataFrame:
    """(label, item_id, entity_id, crop, y, score): several scored crops per record."""
    lab = by_item(pinned(item_labels(spark, sf))).select("item_id", "entity_id", F.inline("labels")).where(F.col("y") >= 0)
    rows = lab.select("*", F.explode(F.array(*[F.lit(c) for c in range(crops)])).alias("crop"))
    noise = hashed_int(F.concat(F.lit("crop"), F.col("crop")), F.lit(0), F.col("item_id"))
    return rows.withColumn("score", (30 * F.col("y") + noise % 70) / 100.0)


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Heavy-tie scored rows in many clusters."""
    li = table(spark, sf, "lineitem")
    bucket = F.floor(F.col("l_quantity") / 10).cast("bigint")
    return li.select(
        (F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_discount").alias("score"),
        F.col("l_tax").alias("tax"), F.col("l_suppkey").alias("cluster"),
        F.concat_ws("|", "l_linestatus", bucket.cast("string")).alias("stratum"))


def scored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """(label, doc_id, source, y, p) for the two document labels."""
    lab = table(spark, sf, "labels").unpivot(["doc_id"], ["quality", "toxic"], "label", "y")
    doc = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    p = F.round(F.col("n_chars") / (F.col("n_chars") + F.lit(5000.0)), 4)
    return lab.join(doc, "doc_id").select("label", "doc_id", "source", "y", p.alias("p"))


def strata(spark: SparkSession, sf: str) -> DataFrame:
    """(item_id, stratum): acuity x quarter of the day x weekend."""
    rec = base_records(spark, sf)
    key = F.concat_ws(
        "|", F.coalesce(F.col("acuity").cast("string"), F.lit("-1")),
        F.floor(F.hour("index_time") / 6).cast("string"),
        (F.extract(F.lit("DAYOFWEEK_ISO"), "index_time") >= 6).cast("int").cast("string"))
    return rec.select("item_id", key.alias("stratum"))


# ---- the same views in SQL -------------------------------------------------

_SQL = {
    "records": """
records as (
  select *, min(index_time) over (partition by episode_id) as intime,
         min(index_time) over (partition by episode_id) + interval 90 minute as window_close,
         row_number() over (partition by episode_id order by index_time, item_id) - 1 as seq,
         nullif(k % 6, 0) as acuity, entity_id % 20 as fold,
         case when entity_id % 20 <= 17 then 'train' when entity_id % 20 = 18 then 'val'
              else 'test' end as split
  from (select event_id as item_id, user_id as entity_id, ts as index_time, event_type, value,
               cast(json_extract_string(props, '$.k') as bigint) as k,
               user_id * 1000 + dayofyear(ts) as episode_id from events))""",
    "horizon_labels": """
horizon_labels as (
  select r.item_id, r.entity_id, 'h' || h.hours as label,
         case when r.index_time + to_hours(h.hours) > (select max(index_time) from records) then -999
              when exists (select 1 from records p where p.entity_id = r.entity_id
                   and p.event_type = 'purchase' and p.index_time > r.index_time
                   and p.index_time <= r.index_time + to_hours(h.hours)) then 1 else 0 end as y
  from records r, (values (6), (24), (72)) h(hours))""",
    "wide_labels": """
wide_labels as (
  select item_id, max(y) filter (label = 'h6') as h6, max(y) filter (label = 'h24') as h24,
         max(y) filter (label = 'h72') as h72 from horizon_labels group by item_id)""",
    "predictions": """
pred_base as (
  select l.item_id, l.entity_id, l.label, l.y, r.acuity, s.seed, p.prev
  from horizon_labels l join records r using (item_id)
  join (select l2.label, round(avg(l2.y), 9) as prev from horizon_labels l2
        join records r2 using (item_id)
        where r2.split = 'train' and l2.y >= 0 group by l2.label) p on p.label = l.label,
  (values (0), (1), (2), (3), (4)) s(seed) where l.y >= 0),
predictions as (
  select 'prev' as arm, label, seed, item_id, entity_id, y, prev as score from pred_base
  union all
  select 'ctx', label, seed, item_id, entity_id, y,
         ((5 - coalesce(acuity, 3)) * 10 + 5 * y
          + ('0x' || substr(md5('ctx|' || seed || '|' || item_id), 1, 8))::bigint % 20)::double / 100.0::double
  from pred_base
  union all
  select 'sig', label, seed, item_id, entity_id, y,
         (30 * y + ('0x' || substr(md5('sig|' || seed || '|' || item_id), 1, 8))::bigint % 70)::double / 100.0::double
  from pred_base)""",
    "pooled": """
pooled as (
  select arm, label, item_id, any_value(entity_id) as entity_id, any_value(y) as y,
         round(avg(score), 9) as score
  from predictions group by arm, label, item_id having count(distinct seed) = 5)""",
    "crops": """
crops as (
  select label, item_id, entity_id, c.crop, y,
         (30 * y + ('0x' || substr(md5('crop' || c.crop || '|0|' || item_id), 1, 8))::bigint % 70)::double
         / 100.0::double as score
  from horizon_labels, (values (0), (1), (2), (3)) c(crop) where y >= 0)""",
    "lines": """
lines as (
  select case when l_returnflag = 'R' then 1 else 0 end as y, l_discount as score, l_tax as tax,
         l_suppkey as cluster,
         l_linestatus || '|' || cast(floor(l_quantity / 10) as bigint) as stratum
  from lineitem)""",
    "docs": """
docs as (
  select l.label, d.doc_id, d.source, l.y, round(d.n_chars / (d.n_chars + 5000.0::double), 4)::double as p
  from (select doc_id, 'quality' as label, quality as y from labels
        union all select doc_id, 'toxic', toxic from labels) l
  join documents d using (doc_id))""",
    "strata": """
strata as (
  select item_id, coalesce(cast(acuity as varchar), '-1') || '|' || (hour(index_time) // 6) || '|'
         || case when isodow(index_time) >= 6 then 1 else 0 end as stratum
  from records)""",
}
_NEEDS = {
    "records": [], "horizon_labels": ["records"], "wide_labels": ["horizon_labels"],
    "predictions": ["horizon_labels"], "pooled": ["predictions"], "crops": ["horizon_labels"],
    "lines": [], "docs": [], "strata": ["records"],
}


def with_views(names: str, body: str, ctes: str = "") -> str:
    """Prefix `body` with the named views, what they need, and extra CTE text."""
    order: list[str] = []

    def need(name: str) -> None:
        for dep in _NEEDS[name]:
            need(dep)
        if name not in order:
            order.append(name)

    for n in names.split():
        need(n)
    parts = [_SQL[n].strip() for n in order]
    if ctes.strip():
        parts.append(ctes.strip().rstrip(","))
    return ("with " + ",\n".join(parts) + "\n" if parts else "") + body.strip()


# ---- SQL text for the resampling core --------------------------------------

def draws_sql(universe: str, n_boot: int, seed: int = 0, mode: str = "multinomial",
              name: str = "draws") -> str:
    """CTEs giving (rep, entity, w), with the observed sample as rep -1.

    `universe` is a query with one column `entity`.
    """
    if mode == "poisson":
        from stampline.functions.expr import poisson1_cuts

        cuts = " + ".join(f"(u >= {c!r}::double)::int" for c in poisson1_cuts())
        return f"""
{name} as (
  select * from (
    select rep, entity, {cuts} as w from (
      select b.rep, e.entity,
             ('0x' || substr(md5('{seed}|' || b.rep || '|' || e.entity), 1, 8))::bigint / 4294967296.0::double as u
      from (select distinct entity from ({universe})) e,
           (select range::int as rep from range({n_boot})) b)) where w > 0
  union all select -1, entity, 1 from (select distinct entity from ({universe})))"""
    from stampline.functions.splitting import splitting_sql

    return f"""
{name}_e as (select entity, row_number() over (order by entity) - 1 as idx
             from (select distinct entity from ({universe}) where entity is not null)),
{name}_g as (select count(*) as g from {name}_e),
{splitting_sql(name, seed, n_boot)},
{name} as (
  select c.rep, e.entity, c.w from {name}_leaf c join {name}_e e using (idx)
  union all select -1, entity, 1 from {name}_e)"""


def auroc_sql(source: str, keys: str, name: str, w: str = "w") -> str:
    """CTE (keys, auroc) over `source` with columns keys, y, score and weight `w`."""
    return f"""
{name}_h as (select {keys}, score, sum(case when y = 1 then {w} else 0 end)::double as p,
             sum(case when y = 0 then {w} else 0 end)::double as n
             from {source} group by {keys}, score),
{name}_b as (select *, coalesce(sum(n) over (partition by {keys} order by score
             rows between unbounded preceding and 1 preceding), 0) as below from {name}_h),
{name} as (select {keys}, case when sum(p) > 0 and sum(n) > 0
           then sum(p * (below + 0.5::double * n)) / (sum(p) * sum(n)) end as auroc
           from {name}_b group by {keys})"""


def summary_sql(source: str, by: str, n_boot: int, value: str = "value") -> str:
    """Body giving estimate, interval, p-value and counts from (rep, by, value)."""
    v = f"(case when rep >= 0 then {value} end)"
    lead = f"{by}, " if by else ""
    tail = f"group by {by}" if by else ""
    return f"""
select {lead}max(case when rep = -1 then {value} end) as estimate,
       quantile_cont({v}, 0.025) as ci_lo, quantile_cont({v}, 0.975) as ci_hi,
       least(1.0::double, 2.0::double * least(
         avg(case when {v} <= 0 then 1.0 when {v} is not null then 0.0 end),
         avg(case when {v} >= 0 then 1.0 when {v} is not null then 0.0 end))) as p_value,
       {n_boot}::bigint as n_boot, count({v}) as n_finite
from {source} {tail}"""
