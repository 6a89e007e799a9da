"""URL filters by a temporal list join (native).

A list is a log of dated entries (key, day, action, category): an ``add`` lists the key in the
category from that day, a ``remove`` ends it; the categories of a key do not touch each other. Entries
become validity intervals [from_day, to_day); a capture is evaluated against the intervals that hold
on the day it was fetched. Keys are ``d:`` plus a host or
one of its parent domains and ``p:`` plus host and first path segment.

Captures are reduced to distinct (host, segment, day) probes before the join, so a host with a third
of all captures costs as many probes as it has days and segments.

Defined results: a null or unparsable url has no keys and is never listed; entries with a null key
or day are ignored; of entries for one key, category and day the last action by name wins (``remove``
after ``add``); a null category is one of its own; an empty list lists nothing; an empty table of captures stays
empty; repeated captures are evaluated alike; urls may be of any length; further columns pass, one
named like an added column as ``<name>_input``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.binding import aside, spare


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.regexp_replace(found, r"\.+$", "")


def segment_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """key, from_day, to_day (null: open), category: one row for each stretch in which the key is listed in the category."""
    log = entries.where("key IS NOT NULL AND day IS NOT NULL").groupBy("key", "category", "day").agg(F.max("action").alias("action"))
    upto = F.lead("day").over(Window.partitionBy("key", "category").orderBy("day"))
    log = log.select("key", F.col("day").alias("from_day"), upto.alias("to_day"), "action", "category")
    return log.where("action = 'add'").drop("action")


def _keys(host: Column, segment: Column) -> Column:
    labels = F.split(host, r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.struct(F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")).alias("key"), (F.size(labels) - i + 1).alias("depth")),
    )
    path = F.array(F.struct(F.concat(F.lit("p:"), host, F.lit("/"), segment).alias("key"), (F.size(labels) + 1).alias("depth")))
    return F.concat(parents, path)


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetch_day") -> DataFrame:
    """``captures`` with host, n_active (entries that apply, by key and category), listed and the category of the most specific one."""
    added = ("host", "n_active", "listed", "category")
    captures = aside(captures, *added)
    url, day = (f"{c}_input" if c in added else c for c in (url, day))
    seg, at = spare(captures, "_seg"), spare(captures, "_day")
    named = captures.withColumn("host", host_of(F.col(url))).withColumn(seg, segment_of(F.col(url))).withColumn(at, F.col(day))
    probes = named.select("host", F.col(seg).alias("seg"), F.col(at).alias("at")).where("host <> '' AND at IS NOT NULL").distinct()
    keyed = probes.select("host", "seg", "at", F.inline(_keys(F.col("host"), F.col("seg"))))
    hits = keyed.join(intervals(entries), "key").where((F.col("at") >= F.col("from_day")) & (F.col("to_day").isNull() | (F.col("at") < F.col("to_day"))))
    verdicts = hits.groupBy("host", F.col("seg").alias(seg), F.col("at").alias(at)).agg(
        F.count("*").alias("n_active"), F.max_by("category", F.struct("depth", "category")).alias("category")
    )
    out = named.join(verdicts, ["host", seg, at], "left").drop(seg, at)
    return out.withColumn("n_active", F.coalesce("n_active", F.lit(0)).cast("long")).withColumn("listed", F.col("n_active") > 0)


def entries_from_pages(pages: DataFrame) -> DataFrame:
    """A dated list derived from the hosts of the pages themselves: which keys are listed when follows from digests of the keys.

    Categories of a key overlap, and some begin on one day.
    """
    byte = lambda c: F.conv(F.substring(F.md5(c), 1, 2), 16, 10).cast("long")
    named = pages.select(host_of(F.col("url")).alias("host"), segment_of(F.col("url")).alias("seg")).where("host <> ''")
    entry = lambda key, day, action, category: F.struct(
        key.alias("key"), day.cast("long").alias("day"), F.lit(action).alias("action"), F.lit(category).alias("category")
    )
    key, a = F.concat(F.lit("d:"), F.col("name")), F.col("a")
    none = F.array().cast("array<struct<key:string,day:bigint,action:string,category:string>>")
    hosts = named.select(F.col("host").alias("name")).distinct().withColumn("a", byte(F.col("name")))
    hosts = hosts.where("a % 4 = 0").select(
        F.inline(
            F.concat(
                F.array(entry(key, a % 90, "add", "spam"), entry(key, a % 60 + 120, "remove", "spam")),
                F.when(a % 8 == 0, F.array(entry(key, a % 60 + 40, "add", "malware"), entry(key, a % 90, "add", "fraud"), entry(key, F.lit(300), "remove", "malware"))).otherwise(none),
            )
        )
    )
    domains = named.select(F.substring_index("host", ".", -3).alias("name")).distinct().withColumn("a", byte(F.col("name")))
    domains = domains.where("a % 16 = 1").select(F.inline(F.array(entry(key, F.lit(30), "add", "adult"), entry(key, F.lit(200), "remove", "adult"))))
    paths = named.select(F.concat("host", F.lit("/"), "seg").alias("name")).distinct().withColumn("a", byte(F.col("name")))
    paths = paths.where("a % 8 = 2").select(F.inline(F.array(entry(F.concat(F.lit("p:"), F.col("name")), a, "add", "tracker"))))
    return hosts.unionByName(domains).unionByName(paths)
