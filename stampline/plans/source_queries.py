"""Queries for contracts, fingerprints, the ledger and manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from stampline.plans import views as v
from stampline.plans.registry import query
from stampline.session import ensure_checkpoint_dir
from stampline.sources import contracts as k
from stampline.sources import ledger as g

ORDERS = k.TableSpec("orders", {
    "o_orderkey": k.ColumnSpec("bigint", "key", False), "o_custkey": k.ColumnSpec("bigint", "cluster", False),
    "o_orderdate": k.ColumnSpec("timestamp_ntz", "index_time", False), "o_totalprice": k.ColumnSpec("double")})


@query("a1_read_contract_table", "select o_orderkey, o_custkey, o_orderdate, o_totalprice from orders")
def a1(spark, sf):
    return k.read_contract_table(spark, f"{sf}/orders.parquet", ORDERS)


@query("a2_validate_table", """
select 'anchor_year' as "column", 'absent' as problem, null::bigint as rows
union all select 'lang', 'uncastable', count(*) filter (try_cast(lang as bigint) is null) from documents
union all select 'quality', 'null', count(*) from documents where doc_id not in (select doc_id from labels)""")
def a2(spark, sf):
    """Labels cover only some documents, languages are no numbers and one column is absent."""
    rows = v.table(spark, sf, "documents").join(v.table(spark, sf, "labels"), "doc_id", "left")
    spec = k.TableSpec("documents", {
        "doc_id": k.ColumnSpec("bigint", "key", False), "lang": k.ColumnSpec("bigint"),
        "quality": k.ColumnSpec("int", "value", False), "anchor_year": k.ColumnSpec("bigint")})
    return k.validate_table(rows, spec)


@query("a4_select_by_prefix", """
select o_orderkey, l_quantity, l_tax, l_linenumber from orders
left join (select l_orderkey, max(l_quantity) as l_quantity, max(l_tax) as l_tax, max(l_linenumber) as l_linenumber
           from lineitem group by l_orderkey) on l_orderkey = o_orderkey""")
def a4(spark, sf):
    orders = v.table(spark, sf, "orders").select("o_orderkey")
    wide = v.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    wide = wide.groupBy("o_orderkey").agg(F.max("l_quantity").alias("l_quantity"), F.max("l_tax").alias("l_tax"),
                                          F.max("l_linenumber").alias("l_linenumber"))
    return k.select_by_prefix(orders, wide, ["l_"], "o_orderkey", expect=3)


def fingerprint_sql(text: str, source: str) -> str:
    """n_rows and hash of `table_fingerprint` over rows given as text: 13 limbs of the SHA-256 digits, summed."""
    limbs = ", ".join(f"coalesce(sum(('0x' || substr(h, {i}, 5))::bigint), 0)::hugeint::varchar" for i in range(1, 65, 5))
    return (f"select count(*) as n_rows, array_to_string([{limbs}], ':') as hash "
            f"from (select sha256({text}) as h from {source})")


@query("a6_table_fingerprint", fingerprint_sql(
    "length(o_orderkey::varchar) || ':' || o_orderkey || '|' || length(o_custkey::varchar) || ':' || o_custkey "
    "|| '|' || length(o_orderpriority::varchar) || ':' || o_orderpriority", "orders"))
def a6(spark, sf):
    return k.table_fingerprint(v.table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderpriority"])


def shared_folder(spark) -> str:
    """A fresh folder next to the checkpoints, which every executor can reach."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/derived-{uuid.uuid4().hex}"


@query("a1_json_by_contract", """
with n as (select count(*) as rows, count(*) filter (o_orderkey % 50 = 0) as broken from orders)
select "column", problem, "rows" from (
  select '_broken' as "column", 'corrupt' as problem, broken as "rows" from n
  union all select 'o_orderkey', 'null', broken from n union all select 'o_custkey', 'null', broken from n
  union all select 'o_orderdate', 'null', broken from n union all select 'o_comment', 'null', n.rows from n)
where "rows" > 0""")
def a1_json(spark, sf):
    """Orders as JSON lines, every fiftieth cut short and one contracted field in none, read once by contract."""
    columns = {**ORDERS.columns, "o_comment": k.ColumnSpec("string", "value", False)}
    orders = v.table(spark, sf, "orders").select(*ORDERS.columns)
    line = F.to_json(F.struct(*orders.columns))
    whole = F.when(F.col("o_orderkey") % 50 == 0, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line)
    folder = f"{shared_folder(spark)}/orders.jsonl"
    orders.select(whole.alias("value")).write.text(folder)
    spec = k.TableSpec("orders", columns)
    return k.validate_table(k.read_contract_table(spark, folder, spec, corrupt="_broken"), spec, corrupt="_broken")


@query("a7_write_derived", """
select count(*) as n_rows, 'parquet' as format, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' as columns,
       'cohort' as role from customer""")
def a7(spark, sf):
    meta = k.write_derived(v.table(spark, sf, "customer"), shared_folder(spark) + "/customer", role="cohort")
    return meta.select("n_rows", "format", "columns", "role")


@query("a8_latest_event_per_key", """
select conv_id, max(turn) as turn, arg_max(role, turn) as role, arg_max(text, turn) as text
from conversations where role = 'assistant' group by conv_id""")
def a8(spark, sf):
    return g.latest_event_per_key(v.table(spark, sf, "conversations"), ["conv_id"], "turn", "assistant", "role")


@query("a8_resolve_cells", """
with ev as (select o_orderpriority as arm, o_orderstatus as label, (o_custkey % 50)::int as seed, o_orderkey as run_id from orders),
latest as (select arm, label, seed, max(run_id) as run_id from ev group by all),
alive as (select * from latest where run_id in (select l_orderkey from lineitem where l_quantity > 45)),
cells as (select * from (select distinct arm from ev), (select distinct label from ev), (select distinct seed from ev))
select c.arm, c.label, c.seed, coalesce(o.run_id, s.run_id) as run_id from cells c
left join alive o on o.arm = c.arm and o.label = c.label and o.seed = c.seed
left join alive s on s.label = 'P' and s.arm = c.arm and s.seed = c.seed""")
def a8_resolve(spark, sf):
    """Orders as a run ledger; a run is gone when none of its lines is large."""
    ev = v.table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("arm"), F.col("o_orderstatus").alias("label"),
        (F.col("o_custkey") % 50).cast("int").alias("seed"), F.col("o_orderkey").alias("run_id"))
    keys = ["arm", "label", "seed"]
    latest = g.latest_event_per_key(ev, keys, "run_id")
    kept = v.table(spark, sf, "lineitem").where(F.col("l_quantity") > 45).select(F.col("l_orderkey").alias("run_id"))
    # A declared grid: arms x labels x seeds.
    grid = ev.select("arm").distinct().crossJoin(ev.select("label").distinct()).crossJoin(ev.select("seed").distinct())
    return g.resolve_cells(grid, latest, kept, keys, "label", "P")


URL = r"^[a-z]+://[^/]+/([^?#]+)"


@query("a9_manifest_build", """
with p as (select regexp_extract(url, '^[a-z]+://[^/]+/([^?#]+)', 1) as path,
                  min((case when page_id % 20 = 19 then 0 when page_id % 20 = 18 then 1 else 2 end) * 100 + page_id % 20) as k
           from pages group by 1)
select row_number() over (order by k, path) - 1 as place, path, k % 100 as fold,
       case k // 100 when 0 then 'test' when 1 then 'val' else 'train' end as split from p""")
def a9(spark, sf):
    pages = v.table(spark, sf, "pages").withColumn("fold", F.col("page_id") % 20)
    return g.manifest_build(pages, "url", "fold", v.SPLIT, ["test", "val", "train"], URL)


@query("a9_manifest_counts", f"""
with p as (select regexp_extract(url, '^[a-z]+://[^/]+/([^?#]+)', 1) as path,
                  min(case when page_id % 20 = 19 then 0 when page_id % 20 = 18 then 1 else 2 end) as k
           from pages group by 1)
select split, n_paths, n_rows, hash from (
  select case k when 0 then 'test' when 1 then 'val' else 'train' end as split, count(*) as n_paths from p group by k),
  ({fingerprint_sql("length(path) || ':' || path", "p")})""")
def a9_counts(spark, sf):
    pages = v.table(spark, sf, "pages").withColumn("fold", F.col("page_id") % 20)
    manifest = g.manifest_build(pages, "url", "fold", v.SPLIT, ["test", "val", "train"], URL)
    return g.manifest_counts(manifest).crossJoin(k.table_fingerprint(manifest, ["path"]))


@query("a10_manifest_verify", """
select split, count(*) as n_files, count(*) filter (status = 'ok') as n_ok, count(*) filter (status = 'missing') as n_missing,
       count(*) filter (status = 'empty') as n_empty, count(*) filter (status = 'truncated') as n_truncated,
       count(*) filter (stray) as n_stray
from (select split, doc_id % 9 = 0 as stray,
             case when doc_id % 11 = 0 then 'missing' when doc_id % 13 = 0 then 'empty'
                  when doc_id % 7 = 0 and doc_id % 6 <> 0 then 'truncated' else 'ok' end as status
      from (select doc_id, case when doc_id % 20 = 19 then 'test' when doc_id % 20 = 18 then 'val' else 'train' end as split
            from documents)
      union all select case when doc_id % 20 = 19 then 'test' when doc_id % 20 = 18 then 'val' else 'train' end, false, 'ok'
      from documents) group by split""")
def a10(spark, sf):
    """A file listing derived from the documents: some missing, empty, short or half-fetched.

    Every sixth header mixes formats, so no size can be expected from it.
    """
    d = F.col("doc_id")
    docs = v.table(spark, sf, "documents").select("doc_id", "n_chars")
    split = F.when(d % 20 == 19, "test").when(d % 20 == 18, "val").otherwise("train")
    stem = F.concat(F.lit("files/p"), d.cast("string"), F.lit("/"), d.cast("string"))
    expected = docs.select(F.explode(F.array(F.concat(stem, F.lit(".hea")), F.concat(stem, F.lit(".dat")))).alias("path"),
                           split.alias("split"))
    size = F.col("n_chars") * 4
    length = F.when(d % 13 == 0, 0).when(d % 7 == 0, size - 1).otherwise(size)
    data = docs.where(d % 11 != 0).select(F.concat(stem, F.lit(".dat")).alias("path"), length.alias("length"))
    heads = docs.select(F.concat(stem, F.lit(".hea")).alias("path"), F.lit(64).cast("bigint").alias("length"))
    parts = docs.where(d % 9 == 0).select(F.concat(stem, F.lit(".dat.part")).alias("path"), F.lit(5).cast("bigint").alias("length"))
    second = F.when(d % 6 == 0, "212").otherwise("16x1")
    text = F.concat(d.cast("string"), F.lit(" 2 500 "), F.col("n_chars").cast("string"), F.lit("\n a.dat 16:0 200\n b.dat "),
                    second, F.lit(" 200\n# note"))
    headers = docs.select(stem.alias("record"), text.alias("header"))
    return g.verify_totals(g.manifest_verify(expected, data.unionByName(heads).unionByName(parts), headers))
