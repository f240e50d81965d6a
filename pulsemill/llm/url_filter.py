"""URL filtering by a temporal list join, in DataFrame operations only.

Blocklists change: an entry (list, kind, pattern) is added and removed on dates. The dated entries of one pattern, in
order, become validity intervals, each ending where the next begins. A capture is evaluated as of its own fetch time: its
keys (suffixes of the host by label, and prefixes of host and path by segment) meet the intervals in an equality join on
the key, with the interval test as a residual. Only keys of as many labels or segments as some entry has are made, as no
other can meet one, so a long url makes few; the numbers of labels and segments that occur are at most the root of twice
the list's size. The intervals are broadcast if they are few by count; otherwise the join is salted, so a hot host's rows
go to many tasks.

Edge cases: null or unparsable urls and null fetch times are evaluated as not blocked; several entries of one pattern on
one date: the removal is last; an entry with a null date or pattern is ignored; repeated captures each get a row; ports,
user names, case of host, queries and fragments don't matter; empty tables give no rows; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_ROWS, cleaned, stored, table

SALTS = 16


def host_of(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("."))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)


def url_keys(url: Column, labels: list[int], segments: list[int]) -> Column:
    """array<struct<kind, key>>: 'host' suffixes and 'path' prefixes of the given numbers of parts; empty for urls without a host."""
    host, names = host_of(url), F.split(host_of(url), r"\.")
    parts = F.array_remove(F.split(path_of(url), "/"), "")
    some = lambda numbers, of: F.filter(F.array(*map(F.lit, numbers)).cast("array<int>"), lambda n: n <= F.size(of))
    hosts = F.transform(some(labels, names), lambda n: F.struct(F.lit("host").alias("kind"), F.array_join(F.slice(names, F.size(names) - n + 1, n), ".").alias("key")))
    paths = F.transform(some(segments, parts), lambda n: F.struct(F.lit("path").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")).alias("key")))
    return F.when(host == "", F.array().cast("array<struct<kind:string,key:string>>")).otherwise(F.concat(hosts, paths))


def intervals(entries: DataFrame) -> DataFrame:
    """Entries (list, kind, key, action 'add' or 'remove', day date) as the intervals [since, until) in which a key is listed."""
    known = entries.where("key IS NOT NULL AND day IS NOT NULL").select("list", "kind", "key", "action", "day")
    by = Window.partitionBy("list", "kind", "key").orderBy("day", F.col("action") == "remove")
    spans = known.select("list", "kind", "key", "action", F.col("day").alias("since"), F.lead("day").over(by).alias("until"))
    return spans.where("action = 'add' AND (until IS NULL OR until > since)").drop("action")


def filtered(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """capture_id, url, blocked, n_rules and rules (sorted 'list:kind:key', joined by blanks) of captures (capture_id, url, day)."""
    rows = captures.select("capture_id", "url", "day", F.monotonically_increasing_id().alias("rid"))
    held = stored(intervals(entries), "intervals")
    parts = held.select("kind", (F.length("key") - F.length(F.replace("key", F.when(F.col("kind") == "host", ".").otherwise("/"), F.lit("")))).alias("n")).distinct().collect()
    labels, segments = sorted(r["n"] + 1 for r in parts if r["kind"] == "host"), sorted(r["n"] for r in parts if r["kind"] == "path")
    asked = rows.select("rid", "capture_id", "url", "day", F.explode_outer(url_keys(F.col("url"), labels, segments)).alias("k")).select("rid", "capture_id", "url", "day", "k.kind", "k.key")
    few = held.count() <= BROADCAST_ROWS
    salts = F.array(F.lit(0)) if few else F.sequence(F.lit(0), F.lit(SALTS - 1))
    held = held.select("list", F.col("kind").alias("of_kind"), F.col("key").alias("of_key"), "since", "until", F.explode(salts).alias("of_salt"))
    asked = asked.withColumn("salt", F.lit(0) if few else F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
    active = (F.col("kind") == F.col("of_kind")) & (F.col("key") == F.col("of_key")) & (F.col("salt") == F.col("of_salt")) & (F.col("day") >= F.col("since")) & (F.col("until").isNull() | (F.col("day") < F.col("until")))
    rule = F.when(F.col("list").isNotNull(), F.concat_ws(":", "list", "kind", "key"))
    met = asked.join(F.broadcast(held) if few else held, active, "left").groupBy("rid", "capture_id", "url").agg(F.array_sort(F.collect_set(rule)).alias("r"))
    return met.select("capture_id", "url", (F.size("r") > 0).alias("blocked"), F.size("r").cast("long").alias("n_rules"), F.array_join("r", " ").alias("rules"))


FIRST_DAY = "2024-01-01"


def page_captures(pages: DataFrame) -> DataFrame:
    """The table has no fetch times; a page's is a day of 2024 that follows from its id."""
    return pages.select(F.col("page_id").alias("capture_id"), "url", F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod("page_id", F.lit(365)).cast("int")).alias("day"))


def page_entries(pages: DataFrame) -> DataFrame:
    """The data have no lists either; they follow from digests of the pages' hosts.

    A fifth of the hosts is listed, removed after 60 days and listed again after 120; a tenth of the domains (the host less
    its first label, if more than one is left) is listed to the end; a third of the first path segments is listed for 90 days.
    """
    host = host_of(F.col("url"))
    first = F.regexp_extract(path_of(F.col("url")), "^/+([^/]+)", 1)
    rest = F.regexp_replace(host, r"^[^.]*\.", "")
    names = pages.select(host.alias("host"), F.when(rest.contains("."), rest).alias("domain"), F.when(first != "", F.concat(host, F.lit("/"), first)).alias("path")).where("host <> ''").distinct()
    names = stored(names, "names")
    number = lambda c: F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("int")
    day = lambda n, after: F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod(F.shiftright(n, 5), F.lit(240)) + after)

    def dated(keys: DataFrame, name: str, kind: str, share: int, steps: list[tuple[str, int]]) -> DataFrame:
        n = number(F.col("key"))
        chosen = keys.where("key IS NOT NULL").distinct().where(F.pmod(n, F.lit(share)) == 0)
        moves = F.array(*[F.struct(F.lit(a).alias("action"), day(n, F.lit(d)).alias("day")) for a, d in steps])
        return chosen.select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), "key", F.inline(moves))

    hosts = dated(names.select(F.col("host").alias("key")), "adverts", "host", 5, [("add", 0), ("remove", 60), ("add", 120)])
    domains = dated(names.select(F.col("domain").alias("key")), "malware", "host", 10, [("add", 0)])
    paths = dated(names.select(F.col("path").alias("key")), "spam", "path", 3, [("add", 0), ("remove", 90)])
    return hosts.union(domains).union(paths)


ORACLE = r"""
WITH captures AS (
  SELECT row_number() OVER () AS rid, page_id AS capture_id, url, DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS day,
    rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.') AS host,
    regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
names AS (
  SELECT DISTINCT host, regexp_replace(host, '^[^.]*\.', '') AS domain,
    CASE WHEN regexp_extract(path, '^/+([^/]+)', 1) <> '' THEN host || '/' || regexp_extract(path, '^/+([^/]+)', 1) END AS p
  FROM captures WHERE host <> ''),
keys AS (
  SELECT list, kind, key, share, CAST(('0x' || substr(md5(key), 1, 6)) AS INTEGER) AS n FROM (
    SELECT DISTINCT 'adverts' AS list, 'host' AS kind, host AS key, 5 AS share FROM names
    UNION SELECT DISTINCT 'malware', 'host', domain, 10 FROM names WHERE domain LIKE '%.%'
    UNION SELECT DISTINCT 'spam', 'path', p, 3 FROM names WHERE p IS NOT NULL)),
spans AS (
  SELECT list, kind, key, DATE '2024-01-01' + CAST((n >> 5) % 240 + a AS INTEGER) AS since, CASE WHEN b IS NOT NULL THEN DATE '2024-01-01' + CAST((n >> 5) % 240 + b AS INTEGER) END AS until
  FROM keys JOIN (VALUES ('adverts', 0, 60), ('adverts', 120, NULL), ('malware', 0, NULL), ('spam', 0, 90)) AS s(l, a, b) ON l = list WHERE n % share = 0),
asked AS (
  SELECT rid, capture_id, url, day, 'host' AS kind, array_to_string(string_split(host, '.')[i:], '.') AS key
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM captures WHERE host <> '')
  UNION ALL
  SELECT rid, capture_id, url, day, 'path', host || '/' || array_to_string(parts[:i], '/')
  FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS parts FROM captures WHERE host <> ''))),
met AS (
  SELECT DISTINCT rid, s.list || ':' || a.kind || ':' || a.key AS rule
  FROM asked a JOIN spans s ON a.kind = s.kind AND a.key = s.key AND a.day >= s.since AND (s.until IS NULL OR a.day < s.until))
SELECT capture_id, url, count(rule) > 0 AS blocked, count(rule) AS n_rules, coalesce(string_agg(rule, ' ' ORDER BY rule), '') AS rules
FROM captures LEFT JOIN met USING (rid) GROUP BY rid, capture_id, url
"""


@cleaned
def filtered_pages(pages: DataFrame) -> DataFrame:
    return filtered(page_captures(pages), page_entries(pages))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered_pages(table(spark, sf_dir, "pages"))
