"""Operator 4 [native]: URL filters as a temporal list join.

A list is a log of dated entries (key, day, action); a key is a host, a parent domain, or host and
first path segment. Entries become validity intervals, and every capture is judged by the entries
that are active on the day it was fetched; the most specific key with an active entry decides.

The as-of join sorts, for each key, the distinct days it is asked for together with the starts of its
intervals and carries the last interval forward. A key has at most a row for each day and entry there,
so a host with a third of all captures costs no more than its days, and histories never travel with
captures. Captures meet their verdicts by host, segment and day.

Defined cases: a URL without a host, empty or null, has verdict null; a null day too; two entries
of a key on one day: 'block' wins; entries without a key or a day say nothing; an empty list leaves
every verdict null; an empty table of captures gives an empty result; long URLs are taken whole;
captures that repeat are judged each. Other columns, whatever their names, stay as they are, but for
a column _verdict, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and a leading www."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/:?#]+)", 1)


def path_key(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)", 1)


def keys_of(host: Column, first: Column) -> Column:
    """List keys of a capture, the most specific first: host/segment, host, then its parent domains of two labels or more."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    up = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    up = F.when(n < 2, F.array(host)).otherwise(up)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.when(first != "", F.array(F.concat(host, F.lit("/"), first))).otherwise(F.array().cast("array<string>")), up)))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, day, action) to (key, since, until, action): an entry holds until the key's next one; until is null while open."""
    one = entries.filter("key is not null and day is not null").groupBy("key", "day").agg(F.min("action").alias("action"))
    return one.withColumn("until", F.lead("day").over(Window.partitionBy("key").orderBy("day"))).select("key", F.col("day").alias("since"), "until", "action")


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """All columns of ``captures`` and a struct _verdict(action, key, since)."""
    spans = intervals(entries)
    rows = captures.select(F.struct(*(F.col(f"`{c}`") for c in captures.columns)).alias("_row"))
    at = F.col(f"_row.`{url}`")
    rows = rows.select("_row", F.coalesce(host_of(at), F.lit("")).alias("_host"), F.coalesce(path_key(at), F.lit("")).alias("_first"), F.col(f"_row.`{day}`").alias("_day"))
    places = rows.filter("_host <> '' and _day is not null").select("_host", "_first", "_day").distinct()
    asked = places.select("_host", "_first", "_day", F.posexplode(keys_of(F.col("_host"), F.col("_first"))).alias("_rank", "_key"))
    starts = spans.select(F.col("key").alias("_key"), F.col("since").alias("_day"), F.struct("since", "until", "action").alias("_span"))
    both = starts.unionByName(asked.select("_key", "_day").distinct(), allowMissingColumns=True)
    # of one day the start and the question are peers, so the day's own entry counts
    carried = both.withColumn("_last", F.last("_span", ignorenulls=True).over(Window.partitionBy("_key").orderBy("_day"))).filter("_span is null")
    active = carried.filter((F.col("_last.since") <= F.col("_day")) & (F.col("_last.until").isNull() | (F.col("_last.until") > F.col("_day"))))
    found = asked.join(active.select("_key", "_day", "_last"), ["_key", "_day"]).groupBy("_host", "_first", "_day")
    found = found.agg(F.min_by(F.struct(F.col("_last.action").alias("action"), F.col("_key").alias("key"), F.col("_last.since").alias("since")), "_rank").alias("_verdict"))
    judged = rows.join(found, ["_host", "_first", "_day"], "left")
    return judged.select(*(F.col(f"_row.`{c}`").alias(c) for c in captures.columns if c != "_verdict"), "_verdict")


def _digits(text: Column, salt: str, n: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), text)), 1, 7), 16, 10).cast("long") % n


def capture_days(pages: DataFrame) -> DataFrame:
    """The synthetic pages have no fetch time: days 0 to 729 by page id stand for it."""
    return pages.select("page_id", "url", (F.col("page_id") * 7919 % 730).alias("day"))


def sample_list(captures: DataFrame) -> DataFrame:
    """A dated list for the synthetic hosts: by hash of a key, up to four entries that block and release it again."""
    places = captures.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("h"), F.coalesce(path_key(F.col("url")), F.lit("")).alias("f")).distinct()
    keys = places.select(F.explode(keys_of(F.col("h"), F.col("f"))).alias("key")).distinct().filter(F.size(F.split("key", r"\.")) > 2)
    entry = keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i")).filter(_digits(F.concat("key", F.col("i").cast("string")), "use", 3) == 0)
    return entry.select("key", _digits(F.concat("key", F.col("i").cast("string")), "day", 730).alias("day"), F.when(F.col("i") % 2 == 0, "block").otherwise("release").alias("action"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    captures = capture_days(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    out = url_filter(captures, sample_list(captures))
    return out.select("page_id", "day", F.coalesce("_verdict.action", F.lit("none")).alias("action"), F.coalesce("_verdict.key", F.lit("")).alias("list_key"), F.coalesce("_verdict.since", F.lit(-1)).cast("long").alias("since"))


SQL_URLS = r"""
with cap as (
  select page_id, url, page_id * 7919 % 730 as day,
    coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/:?#]+)', 1), '') as h,
    coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1), '') as f
  from pages),
place as (select distinct h, f, string_split(h, '.') as l from cap where h <> ''),
up as (
  select h, f, 0 as rank, h || '/' || f as key from place where f <> ''
  union all
  select h, f, i as rank, array_to_string(list_slice(l, i, len(l)), '.') as key
  from (select h, f, l, unnest(range(1, greatest(len(l), 2))) as i from place)),
entry as (
  select key, ('0x' || substr(md5('day' || key || i), 1, 7))::bigint % 730 as day, case when i % 2 = 0 then 'block' else 'release' end as action
  from (select distinct key from up where len(string_split(key, '.')) > 2), (select unnest(range(0, 4)) as i)
  where ('0x' || substr(md5('use' || key || i), 1, 7))::bigint % 3 = 0),
one as (select key, day, min(action) as action from entry group by key, day),
span as (select key, day as since, lead(day) over (partition by key order by day) as until, action from one),
hit as (
  select c.page_id, s.action, s.key, s.since, row_number() over (partition by c.page_id order by u.rank) as rn
  from cap c join up u on c.h = u.h and c.f = u.f join span s on s.key = u.key and s.since <= c.day and (s.until is null or s.until > c.day))
select c.page_id, c.day::bigint as day, coalesce(hit.action, 'none') as action, coalesce(hit.key, '') as list_key, coalesce(hit.since, -1)::bigint as since
from cap c left join hit on hit.page_id = c.page_id and hit.rn = 1
"""
