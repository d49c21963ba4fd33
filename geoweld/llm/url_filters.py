"""URL filters as a temporal list join.

A list is a log of dated entries: from a date on a key is blocked, allowed or
removed. The entries of a key become validity intervals, each up to the next
entry's date. A capture meets the list through the keys that its URL has: its
host, the host's parent domains, the page itself, and the host with each leading part of the
path, of those only that are as deep as some key of the list, so that a long URL has no more keys than the list has depths.
An as-of join (the last entry of the key at or before the fetch time) finds the entries
active at fetch time, of which the longest key decides. Entries and captures of a key are merged by time
in ranges, so a key may have any number of either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweld.llm.common import checkpointed, free_name

SCHEME = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//"


def url_keys(url: Column, labels: Column, slashes: Column) -> Column:
    """Distinct keys of a URL in lower-cased host and given path: example.org for itself and all hosts below it, example.org/a/ for what lies under it.

    labels are the numbers of labels of the list's hosts, slashes those of slashes of its paths that end with one; other depths
    are left out, but for the page's own key. Scheme, user, port, query and fragment don't matter. No keys for a null URL or one without a host.
    """
    host = F.lower(F.regexp_extract(url, SCHEME + r"(?:[^/?#@]*@)?([^/?#:]+)", 1))
    path = F.regexp_extract(url, SCHEME + r"[^/?#]+(/[^?#]*)", 1)
    depth = F.length(path) - F.length(F.replace(path, F.lit("/")))
    dots = F.length(host) - F.length(F.replace(host, F.lit(".")))
    domains = F.transform(F.filter(labels, lambda n: n <= dots + 1), lambda n: F.call_function("substring_index", host, F.lit("."), -n))
    under = F.transform(F.filter(slashes, lambda n: n <= depth), lambda n: F.concat(host, F.call_function("substring_index", path, F.lit("/"), n), F.lit("/")))
    page = F.array(F.concat(host, path))
    return F.when(host != "", F.array_distinct(F.concat(domains, under, page))).otherwise(F.array().cast("array<string>"))


def _dated(entries: DataFrame) -> DataFrame:
    """key, action, entry_id, at of the entries with a key and a date; host keys are lower-cased."""
    host = F.lower(F.substring_index("key", "/", 1))
    key = F.concat(host, F.substring("key", F.length(host) + 1, 1 << 30))
    return entries.where("key IS NOT NULL AND at IS NOT NULL").select(key.alias("key"), "action", "entry_id", "at")


def validity_intervals(entries: DataFrame) -> DataFrame:
    """key, action, entry_id, valid_from, valid_to (null: still valid) from entries (entry_id, key, action, at).

    An entry holds from its date until the next entry of its key; of entries of
    one date the largest entry_id holds. Removals end an entry and hold nothing.
    Entries with a null key or date are no entries. Host keys are lower-cased.
    """
    following = Window.partitionBy("key").orderBy("valid_from", "entry_id")
    until = _dated(entries).withColumnRenamed("at", "valid_from").withColumn("valid_to", F.lead("valid_from").over(following))
    return until.select("key", "action", "entry_id", "valid_from", "valid_to").where("action IN ('block', 'allow') AND (valid_to IS NULL OR valid_to > valid_from)")


def as_of(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (key, at, ...) with `entry` (entry_id, action): the last of its key's entries (key, at, entry_id, action) at or before it; null if there is none.

    Both are sorted as one by key and time and dealt by ranges. Within a range the last entry seen is the
    answer; where a range begins in the middle of a key, that key's last entry of the ranges before is.
    """
    rest = [c for c in asked.columns if c not in ("key", "at")]
    entry = F.struct("entry_id", "action")
    none = [F.lit(None).cast(asked.schema[c].dataType).alias(c) for c in rest]
    log = entries.select("key", "at", F.lit(0).alias("turn"), F.col("entry_id").alias("mark"), entry.alias("entry"), *none)
    rows = asked.select("key", "at", F.lit(1).alias("turn"), F.xxhash64(*rest).alias("mark"), F.lit(None).cast(log.schema["entry"].dataType).alias("entry"), *rest)
    order = ["key", "at", "turn", "mark"]
    whole = log.withColumn("mark", F.col("mark").cast("long")).union(rows).repartitionByRange(*order)
    dealt = checkpointed(whole.withColumn("part", F.spark_partition_id()))
    seen = dealt.withColumn("entry", F.last("entry", ignorenulls=True).over(Window.partitionBy("part", "key").orderBy(*order)))
    of_part = dealt.where("turn = 0").groupBy("part", "key").agg(F.max_by("entry", F.struct("at", "mark")).alias("before"))
    first = dealt.groupBy("part").agg(F.min("key").alias("key"))  # a range that begins within a key begins with it; one row a range
    open_ = first.join(of_part.withColumnRenamed("part", "earlier"), "key").where("earlier < part").groupBy("part", "key").agg(F.max_by("before", "earlier").alias("before"))
    return seen.where("turn = 1").join(open_, ["part", "key"], "left").select("key", "at", *rest, F.coalesce("entry", "before").alias("entry"))


def judged(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched_at") -> DataFrame:
    """captures with blocked (boolean), rule_id and rule_key of the entry that decides (null: none is active).

    An entry holds from its date until the next of its key (see validity_intervals). Each distinct (url, time) is joined once, so repeated captures cost nothing;
    captures of one host are spread by URL. The longest active key decides, so an allowed
    path on a blocked host is let through. A null URL or time meets no entry and isn't
    blocked. Columns of captures stay, but ones under these three names are replaced.
    """
    old = [c for c in captures.columns if c.lower() not in {"blocked", "rule_id", "rule_key"}]
    u, t = free_name(captures, "capture_url"), free_name(captures, "capture_at")
    log = _dated(entries)
    # depths of the list's keys: a few numbers
    path = F.col("key").endswith("/")
    count = lambda mark: (F.length("key") - F.length(F.replace(F.col("key"), F.lit(mark)))).cast("int")
    bare = ~F.col("key").contains("/")
    depths = F.broadcast(log.agg(F.collect_set(F.when(bare, count(".") + 1)).alias("labels"), F.collect_set(F.when(path, count("/"))).alias("slashes")))
    once = captures.select(F.col(url).alias(u), F.col(at).alias(t)).where(F.col(u).isNotNull() & F.col(t).isNotNull()).distinct()
    keyed = once.crossJoin(depths).select(u, F.col(t).alias("at"), F.explode(url_keys(F.col(u), F.col("labels"), F.col("slashes"))).alias("key"))
    asked = keyed.join(log.select("key").distinct(), "key", "left_semi").select("key", "at", u)
    found = as_of(log, asked).where("entry.action IN ('block', 'allow')")
    rule = F.max(F.struct(F.length("key").alias("size"), F.col("entry.entry_id").alias("entry_id"), F.col("key"), F.col("entry.action").alias("action")))
    decided = found.groupBy(u, F.col("at").alias(t)).agg(rule.alias("rule"))
    c, d = captures.select(*old).alias("c"), decided.alias("d")
    joined = c.join(d, (F.col(f"c.{url}") == F.col(f"d.{u}")) & (F.col(f"c.{at}") == F.col(f"d.{t}")), "left")
    return joined.select(
        "c.*",
        F.coalesce(F.col("d.rule.action") == "block", F.lit(False)).alias("blocked"),
        F.col("d.rule.entry_id").alias("rule_id"),
        F.col("d.rule.key").alias("rule_key"),
    )
