"""URL filters by a temporal list join.

List entries are dated: a key (a domain or an address) is added to a list on a
day, perhaps removed, perhaps added again.  The entries of a list and key become
validity intervals, from a day on which the key is listed up to the next day on
which it no longer is.  Each capture looks up its own address and its host with
all parent domains, and counts the entries that were active on the day it was
fetched: an as-of join on the key with the day held against the intervals.

Only DataFrame functions are used.  A key's intervals are packed into one row, so
the join adds no rows; captures of a host with a third of all rows are spread
over ``SALT`` copies of the (much smaller) list, and adaptive execution may split
them further.  Addresses stay out of it: only identifier, key and day move.

Defined results: a capture without address, host or day matches nothing; hosts
are compared in lower case without a last dot, addresses without scheme, query
and fragment; entries without list, key or day are left out; on one day a removal
beats an addition; equal captures get equal results; a host is looked up with
every parent domain that is as long as a listed one can be; an empty list blocks nothing, an empty table
gives an empty result; other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from astrolabe.llm import register
from astrolabe.llm.common import table

SALT = 8
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
LONGEST_HOST = 253


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and last dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), HOST, 1)), r"\.$", "")


def address_of(url: Column) -> Column:
    """Host and path, without user, port, query and fragment."""
    path = F.regexp_extract(url.cast("string"), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(host_of(url), path)


def capture_keys(url: Column, longest: int = LONGEST_HOST) -> Column:
    """Array of the keys that concern an address: ``d:`` host and parent domains, ``u:`` the address.

    Domains of more than ``longest`` characters are left out: no listed one is longer (see ``filter_captures``).
    Of a longer host only the end is cut into labels, so the keys' size follows ``longest``, not the host.
    """
    host = host_of(url)
    cut = F.length(host) > longest
    end = F.when(cut, F.right(host, F.lit(longest + 1))).otherwise(host)
    labels = F.split(end, r"\.")
    # the first label of a cut host is a part of one, or what stands before its first whole suffix
    first = F.when(cut, 2).otherwise(1)
    domains = F.when(F.size(labels) >= first, F.transform(F.sequence(first, F.size(labels)), lambda k: F.concat(
        F.lit("d:"), F.array_join(F.slice(labels, k, F.size(labels)), ".")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.concat(domains, F.array(F.concat(F.lit("u:"), address_of(url))))).otherwise(
        F.array().cast("array<string>"))


def validity(entries: DataFrame) -> DataFrame:
    """``list, key, action, day`` (action ``add`` or ``remove``) to ``list, key, valid_from, valid_to`` (null: open)."""
    daily = (entries.where("list IS NOT NULL AND key IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
             .groupBy("list", "key", "day").agg(F.min((F.col("action") == "add").cast("int")).alias("listed")))
    line = Window.partitionBy("list", "key").orderBy("day")
    # a day on which nothing changes neither opens nor closes an interval
    changes = daily.withColumn("before", F.coalesce(F.lag("listed").over(line), F.lit(0))).where("listed <> before")
    return (changes.withColumn("valid_to", F.lead("day").over(line)).where("listed = 1")
            .select("list", "key", F.col("day").alias("valid_from"), "valid_to"))


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url",
                    day_col: str = "fetch_day", salt: int = SALT) -> DataFrame:
    """``id, host, day, active_lists, blocked`` per capture.

    ``entries`` has ``list, key, action, day`` with keys as in ``capture_keys``.
    """
    listed = entries.where(F.col("key").startswith("d:")).agg(F.max(F.length("key"))).first()[0] or 0
    longest = max(LONGEST_HOST, listed - 2)
    packed = (validity(entries).groupBy("key")
              .agg(F.collect_list(F.struct("list", "valid_from", "valid_to")).alias("spans"))
              .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))))
    base = captures.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"),
                           F.col(day_col).cast("date").alias("day"))
    # a capture is named by its own columns: equal captures share their lookup
    name = F.xxhash64("id", "url", "day")
    probes = (base.where("url IS NOT NULL AND day IS NOT NULL")
              .select(name.alias("name"), "id", "url", "day")
              .select("name", "id", "day", F.explode(capture_keys(F.col("url"), longest)).alias("key"))
              .withColumn("salt", F.pmod("name", F.lit(salt)).cast("int")))
    active = F.filter("spans", lambda s: (s["valid_from"] <= F.col("day")) & (
        s["valid_to"].isNull() | (F.col("day") < s["valid_to"])))
    hits = (probes.join(packed, ["key", "salt"])
            .select("name", "id", "day", F.transform(active, lambda s: s["list"]).alias("lists"))
            .where(F.size("lists") > 0)
            .groupBy(F.col("name").alias("h_name"), F.col("id").alias("h_id"), F.col("day").alias("h_day"))
            .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lists")))).alias("lists")))
    same = ((F.col("name") == F.col("h_name")) & F.col("id").eqNullSafe(F.col("h_id")) & (F.col("day") == F.col("h_day")))
    return (base.withColumn("name", name).join(hits, same, "left")
            .select("id", host_of(F.col("url")).alias("host"), "day",
                    F.coalesce(F.array_join("lists", ","), F.lit("")).alias("active_lists"),
                    F.col("lists").isNotNull().alias("blocked")))


def _number(text: Column, start: int) -> Column:
    """A number from seven hexadecimal digits of the text's MD5."""
    return F.conv(F.substring(F.md5(text), start, 7), 16, 10).cast("long")


def list_history(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts, parent domains and addresses of ``pages``.

    The tables hold no block lists, so their history is derived from the pages:
    digests of a key decide whether it is listed, from when, and until when.
    """
    url = F.col("url")
    hosts = pages.select(host_of(url).alias("host")).where("host <> ''").distinct()
    parent = F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1)
    keys = (hosts.select(F.lit("hosts").alias("list"), F.concat(F.lit("d:"), "host").alias("key"), F.lit(3).alias("share"))
            .union(hosts.select(F.lit("domains"), F.concat(F.lit("d:"), parent), F.lit(4)).where(parent != "").distinct())
            .union(pages.where(host_of(url) != "").select(F.lit("addresses"), F.concat(F.lit("u:"), address_of(url)), F.lit(5))
                   .distinct()))
    name = F.concat("list", F.lit("|"), "key")
    start = F.date_add(F.lit("2024-01-01").cast("date"), (_number(name, 8) % 300).cast("int"))
    length = (_number(name, 15) % 90 + 1).cast("int")
    known = keys.where(_number(name, 1) % F.col("share") == 0).withColumn("start", start).withColumn("length", length)
    events = F.array(
        F.struct(F.lit("add").alias("action"), F.col("start").alias("day")),
        F.struct(F.lit("remove").alias("action"), F.date_add("start", F.col("length")).alias("day")),
        F.struct(F.lit("add").alias("action"), F.date_add("start", F.col("length") * 2).alias("day")))
    return known.select("list", "key", F.explode(events).alias("event")).select("list", "key", "event.action", "event.day")


@register("op2_url_filter", r"""
WITH c AS (
  SELECT page_id, url, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') AS host,
         DATE '2024-01-01' + (('0x' || substr(md5('fetch|' || page_id), 1, 7))::BIGINT % 366)::INTEGER AS day
  FROM pages),
a AS (SELECT *, host || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS address FROM c),
k AS (
  SELECT DISTINCT 'hosts' AS list, 'd:' || host AS key, 3 AS share FROM a WHERE host <> ''
  UNION ALL SELECT DISTINCT 'domains', 'd:' || regexp_extract(host, '^[^.]+\.(.+\..+)$', 1), 4 FROM a WHERE regexp_extract(host, '^[^.]+\.(.+\..+)$', 1) <> ''
  UNION ALL SELECT DISTINCT 'addresses', 'u:' || address, 5 FROM a WHERE host <> ''),
e AS (
  SELECT list, key, DATE '2024-01-01' + (('0x' || substr(md5(list || '|' || key), 8, 7))::BIGINT % 300)::INTEGER AS start,
         (('0x' || substr(md5(list || '|' || key), 15, 7))::BIGINT % 90 + 1)::INTEGER AS length
  FROM k WHERE ('0x' || substr(md5(list || '|' || key), 1, 7))::BIGINT % share = 0),
m AS (
  SELECT DISTINCT a.page_id, e.list
  FROM a JOIN e ON (e.key = 'u:' || a.address OR e.key = 'd:' || a.host OR (e.key LIKE 'd:%' AND ends_with(a.host, '.' || substr(e.key, 3))))
  WHERE a.host <> '' AND a.day >= start AND (a.day < start + length OR a.day >= start + 2 * length)),
l AS (SELECT page_id, string_agg(list, ',' ORDER BY list) AS lists FROM m GROUP BY page_id)
SELECT a.page_id, host, day AS fetch_day, coalesce(lists, '') AS active_lists, lists IS NOT NULL AS blocked
FROM a LEFT JOIN l ON a.page_id = l.page_id
""")
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture of a day, held against the lists of that day."""
    pages = table(spark, sf_dir, "pages")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (_number(
        F.concat(F.lit("fetch|"), F.col("page_id").cast("string")), 1) % 366).cast("int"))
    captures = pages.select("page_id", "url", day.alias("fetch_day"))
    return (filter_captures(captures, list_history(pages))
            .withColumnRenamed("id", "page_id").withColumnRenamed("day", "fetch_day"))
