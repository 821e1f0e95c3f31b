"""URL filters that know time: list entries with dates, captures with fetch times.

List events (add or remove an entry on a day) become validity intervals, and
every capture is judged by the entries active on the day it was fetched.

An entry of kind ``domain`` covers its host and all hosts below it, one of
kind ``url`` covers one page address (scheme, fragment and a closing slash do
not count). An entry is active from the day of an ``add`` up to, but not on,
the day of the next ``remove``.

How it scales: events of one entry and day are one row, so an entry has at
most one interval per calendar day. Captures are first reduced, in one pass, to
distinct (host, day) and (address, day) pairs, each judged once against the
intervals; the few pairs that are listed are joined back in a second pass. A pair that holds more than a
thousandth of all captures (at most a thousand of them, so their list may be
broadcast) is salted in that join.

Defined cases: several events of an entry on one day leave it active if any of
them adds it; a NULL action, entry or day is no event; a NULL or unparsable
url has no host and matches no entry (``blocked`` is false); a capture without
a fetch day has NULL ``blocked``; repeated captures and events are harmless;
either table may be empty; names of further columns never matter, as captures
keep theirs in the struct ``row``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retailcast.llm.common import cut_lineage, quoted

SALTS = 32
BROADCAST_ENTRIES = 100_000   # intervals of a kind, counted; beyond it they are repeated for salted probes
HOT_SHARE = 1000   # a pair is hot if it holds more than one capture in so many


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute url, or NULL."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(host != "", F.regexp_replace(host, r"\.$", ""))


def address_of(url: Column) -> Column:
    """Host and the rest of a url without scheme, fragment and closing slash, or NULL."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.concat(host_of(url), F.regexp_replace(rest, "/$", ""))


def validity_intervals(events: DataFrame) -> DataFrame:
    """(kind, entry, valid_from, valid_to) from events (kind, entry, action, day); an open end is NULL."""
    days = (events.where(F.col("action").isin("add", "remove") & F.col("kind").isNotNull()
                         & F.col("entry").isNotNull() & F.col("day").isNotNull())
            .groupBy("kind", "entry", "day").agg(F.max(F.col("action") == "add").alias("active")))
    after = Window.partitionBy("kind", "entry").orderBy("day")   # one row per calendar day at most
    return (days.withColumn("valid_to", F.lead("day").over(after)).where("active")
            .select("kind", "entry", F.col("day").alias("valid_from"), "valid_to"))


def _active(pairs: DataFrame, intervals: DataFrame, kind: str) -> DataFrame:
    """(key, day, entries): the entries that are active on a pair's day; ``pairs`` has (key, probe, day).

    All hosts under ``com`` probe for ``com``: a list of counted size is
    broadcast, beyond it probes are salted and the list is repeated.
    """
    listed = intervals.where(F.col("kind") == kind).select("entry", "valid_from", "valid_to")
    same = F.col("probe") == F.col("entry")
    if listed.count() <= BROADCAST_ENTRIES:
        listed = F.broadcast(listed)
    else:
        listed = listed.withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = pairs.withColumn("mine", F.pmod(F.xxhash64("key", "day"), F.lit(SALTS)).cast("int"))
        same = same & (F.col("mine") == F.col("lot"))
    return (pairs.join(listed, same)
            .where((F.col("day") >= F.col("valid_from"))
                   & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to"))))
            .groupBy("key", "day").agg(F.sort_array(F.collect_set(F.concat(F.lit(f"{kind}:"), "entry"))).alias("entries")))


def _attach(captures: DataFrame, found: DataFrame, key: str, name: str, hot: DataFrame) -> DataFrame:
    """Left join of the listed pairs, hot pairs salted."""
    marked = (captures.join(F.broadcast(hot.select(F.col("key").alias(key), "day", F.lit(True).alias("hot"))),
                            [key, "day"], "left")
              .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(SALTS))).otherwise(F.lit(0)))
              .drop("hot"))
    spread = (found.join(F.broadcast(hot.select("key", "day", F.lit(True).alias("hot"))), ["key", "day"], "left")
              .select(F.col("key").alias(key), "day", F.col("entries").alias(name), F.explode(
                  F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
              .withColumn("salt", F.col("salt").cast("bigint")))
    return marked.withColumn("salt", F.col("salt").cast("bigint")).join(spread, [key, "day", "salt"], "left").drop("salt")


def filter_captures(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """Columns ``row`` (the capture), blocked, entries (kind:entry of what blocks it, sorted)."""
    intervals = cut_lineage(validity_intervals(events))
    judged = captures.select(F.struct(*[quoted(c) for c in captures.columns]).alias("row"),
                             host_of(quoted(url)).alias("host"), address_of(quoted(url)).alias("address"),
                             quoted(fetched).cast("date").alias("day"))
    # both kinds of pairs from one pass over the captures
    pairs = cut_lineage(judged.where("host IS NOT NULL AND day IS NOT NULL").select("day", F.explode(F.array(
        F.struct(F.lit("domain").alias("kind"), F.col("host").alias("key")),
        F.struct(F.lit("url").alias("kind"), F.col("address").alias("key")))).alias("k"))
        .where("k.key IS NOT NULL").groupBy("k.kind", "k.key", "day").agg(F.count("*").alias("n")))
    hosts, pages = (pairs.where(F.col("kind") == kind).drop("kind") for kind in ("domain", "url"))
    least = (hosts.agg(F.sum("n")).first()[0] or 0) / HOT_SHARE
    labels = F.split("key", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    by_host = _active(hosts.select("key", F.explode(above).alias("probe"), "day"), intervals, "domain")
    by_page = _active(pages.select("key", F.col("key").alias("probe"), "day"), intervals, "url")
    out = _attach(judged, by_host, "host", "host_entries", hosts.where(F.col("n") > least).select("key", "day"))
    out = _attach(out, by_page, "address", "page_entries", pages.where(F.col("n") > least).select("key", "day"))
    none = F.array().cast("array<string>")
    entries = F.concat(F.coalesce("host_entries", none), F.coalesce("page_entries", none))
    return out.select("row", F.when(F.col("day").isNotNull(), F.size(entries) > 0).alias("blocked"),
                      F.sort_array(entries).alias("entries"))
