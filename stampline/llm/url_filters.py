"""URL filters by a sort-merge range join, with DataFrame functions only.

A host's key is its labels in reverse, each with a dot: `www.example.com` is `com.example.www.`. A rule's
host then covers the interval from its key up to the key with its last dot raised by one, which holds the
host and all its subdomains. Intervals of rules nest, so a sweep over sorted keys needs, at a host, only the
last interval that began: its stack of enclosing intervals holds all active rules. The sweep runs in range
partitions; the last interval begun before each partition comes from one row per partition. Rules on paths
are judged on the stack, the longest that fits wins (host and path together, then the longer host).

The sweep sees distinct hosts, so a host with a third of all urls is one row there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stampline.llm.texts import ascii_lower
from stampline.session import pinned

SCHEME = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Partitions of the sweep.
SWEEPS = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without `://`."""
    part = lambda i: F.coalesce(F.regexp_extract(url, SCHEME, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """One row per rule host: its interval `lo`, and `stack`, the rules of it and of every host above it."""
    per_host = (rules.groupBy(ascii_lower(F.col("host")).alias("host"))
                .agg(F.collect_set(F.struct("path", "action")).alias("own"))
                .withColumn("lo", host_key(F.col("host"))))
    # A host's enclosing intervals are those of its suffixes, so the nesting is an equi-join on them.
    labels = F.split("host", r"\.")
    above = per_host.select("lo", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("host"))
    return (above.join(per_host.select("host", "own", F.col("lo").alias("from")), "host")
            .groupBy("lo").agg(F.collect_list(F.struct(
                F.col("from").alias("lo"),
                F.concat(F.substring("from", F.lit(1), F.length("from") - 1), F.lit("/")).alias("hi"),
                "host", "own")).alias("stack")))


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url",
                 default: str = "allow") -> DataFrame:
    """Verdict of every url: `id_col`, host, path, rule (`host` + `path` of the rule that won, or null), verdict.

    rules: host, path (with its leading slash), action. A rule fits its host and all subdomains if the url's
    path starts with the rule's; without one, the verdict is `default`. Null urls and urls without `://` have
    an empty host and path and fit no rule. Equal rows are kept as they are; a rule given twice counts once,
    one given with both actions blocks. Rules without a host are left out; the rules of one host fit a row.
    """
    host, path = host_and_path(pages[url_col])
    urls = pages.select(pages[id_col].alias("_id"), host.alias("host"), path.alias("path"))
    rules = rules.where("host <> ''").select("host", F.coalesce("path", F.lit("/")).alias("path"), "action")
    starts = rule_stacks(rules).select(F.col("lo").alias("key"), F.lit(0).alias("kind"), "stack",
                                       F.lit(None).cast("string").alias("host"))
    hosts = urls.select("host").distinct().select(
        host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"),
        F.lit(None).cast(starts.schema["stack"].dataType).alias("stack"), "host")
    # Written once: the partition numbers must stay what they are for both uses.
    events = pinned(starts.unionByName(hosts).repartitionByRange(SWEEPS, "key")
                    .withColumn("part", F.spark_partition_id()))
    last = events.where("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("stack"))
    parts = events.select("part").distinct().join(last, "part", "left")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    carried = parts.select("part", F.last("stack", True).over(before).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    active = (events.withColumn("begun", F.last("stack", True).over(sweep)).where("kind = 1")
              .join(F.broadcast(carried), "part")  # SWEEPS rows
              .select("host", F.filter(F.coalesce("begun", "carried"), lambda r: (F.col("key") >= r["lo"])
                                       & (F.col("key") < r["hi"])).alias("active")))
    fitting = F.flatten(F.transform("active", lambda r: F.transform(
        F.filter(r["own"], lambda x: F.startswith(F.col("path"), x["path"])),
        lambda x: F.struct((F.length(r["host"]) + F.length(x["path"])).alias("size"),
                           F.length(r["host"]).alias("host_size"), x["action"].alias("action"),
                           F.concat(r["host"], x["path"]).alias("rule")))))
    best = F.array_max(F.coalesce(fitting, F.array()))
    return (urls.join(active, "host", "left").withColumn("best", best)
            .select(F.col("_id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.action", F.lit(default)).alias("verdict")))
