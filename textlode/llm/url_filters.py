"""URL filters: a temporal join of page captures with dated list entries.

A list is a log of dated events (list, pattern, action add/remove). Events of one pattern
become validity intervals [from, to); every capture is looked up as of its fetch date under
the patterns that can match it: its host, each parent domain, and each path prefix. The
lookup is an equality on the pattern key with the interval as a residual condition, so no
pair is made that shares no pattern. All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

FAR_FUTURE = "9999-12-31"
#: First day, number of days and lists of the dated log that the query derives.
FIRST_DAY, DAYS = "2024-01-01", 360


def url_host(url: Column) -> Column:
    """Lower-case host of an absolute URL without user, port and a trailing dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def url_path(url: Column) -> Column:
    """Path of an absolute URL without query and fragment, '/' if it is empty."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def url_keys(url: Column) -> Column:
    """The patterns that match a URL: host and parent domains ('d:a.b'), and host with each leading part of the path ('p:a.b/x/y').

    A domain pattern needs two labels at least. Null or hostless URLs have none.
    """
    host, labels = url_host(url), F.split(url_host(url), r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    parts = F.filter(F.split(url_path(url), "/"), lambda x: x != "")
    prefixes = F.transform(
        F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")),
    )
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, prefixes)))


def validity(events: DataFrame) -> DataFrame:
    """(list_name, pattern, valid_from, valid_to) of the times at which each pattern is listed.

    events: list_name, pattern, event_date, action ('add' or 'remove'). Rows with a null in any
    of them are no events. On one day a removal wins over an addition, and repeated events count
    once; an addition to a listed pattern, or a removal of an unlisted one, changes nothing. A
    pattern that is never removed stays to 9999-12-31.
    """
    days = (
        events.select("list_name", "pattern", "event_date", "action")
        .dropna()
        .where(F.col("action").isin("add", "remove"))
        .groupBy("list_name", "pattern", "event_date")
        .agg(F.min(F.col("action") == "add").alias("listed"))
    )
    by = Window.partitionBy("list_name", "pattern").orderBy("event_date")
    changes = days.withColumn("before", F.lag("listed").over(by)).where(F.col("listed") != F.coalesce("before", F.lit(False)))
    spans = changes.withColumn("valid_to", F.coalesce(F.lead("event_date").over(by), F.lit(FAR_FUTURE).cast("date")))
    return spans.where("listed").select("list_name", "pattern", F.col("event_date").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, events: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetch_date") -> DataFrame:
    """The verdict on every capture, one row each: key, url, fetched, n_entries, blocked, list_name, pattern, valid_from.

    n_entries counts the list entries active at the fetch time that match; list_name, pattern and
    valid_from are of the longest such pattern (ties: smaller list name, then the later start).
    Captures with a null or hostless URL, or a null fetch time, match nothing and stay; repeated
    captures stay as often as they come. Further columns are not carried.

    A host may hold a third of all captures. Its key is then hot on the captures' side only, where
    adaptive execution splits the exchange; the verdict is gathered by row, never by key.
    """
    seen = captures.select(F.col(key).alias("_tl_key"), F.col(url).alias("_tl_url"), F.col(fetched).alias("_tl_at"))
    seen = seen.withColumn("_tl_row", F.monotonically_increasing_id())
    asked = seen.select("*", F.explode_outer(url_keys(F.col("_tl_url"))).alias("_tl_pattern"))
    met = asked.join(
        validity(events),
        (F.col("_tl_pattern") == F.col("pattern")) & (F.col("valid_from") <= F.col("_tl_at")) & (F.col("_tl_at") < F.col("valid_to")),
        "left",
    )
    best = F.struct((-F.length("pattern")).alias("a"), F.col("list_name").alias("b"), (-F.unix_date("valid_from")).alias("c"), F.col("pattern").alias("d"), F.col("valid_from").alias("e"))
    verdict = met.groupBy("_tl_row", "_tl_key", "_tl_url", "_tl_at").agg(F.count("pattern").alias("n_entries"), F.min(F.when(F.col("pattern").isNotNull(), best)).alias("best"))
    return verdict.select(
        F.col("_tl_key").alias(key),
        F.col("_tl_url").alias(url),
        F.col("_tl_at").alias(fetched),
        "n_entries",
        (F.col("n_entries") > 0).alias("blocked"),
        F.col("best.b").alias("list_name"),
        F.col("best.d").alias("pattern"),
        F.col("best.e").alias("valid_from"),
    )


def digit(hexed: Column, at: int) -> Column:
    """A number from six hexadecimal digits of a digest."""
    return F.conv(F.substring(hexed, at, 6), 16, 10).cast("long")


def derived_events(pages: DataFrame) -> DataFrame:
    """A dated log over the hosts, parent domains and first path parts that the pages have: the tables hold no lists.

    By a digest of list and pattern, a third of all patterns are added on some day, half of those
    are removed later, and a quarter of the removed ones are added again.
    """
    host, labels = url_host(F.col("url")), F.split(url_host(F.col("url")), r"\.")
    first = F.get(F.filter(F.split(url_path(F.col("url")), "/"), lambda x: x != ""), F.lit(0))
    entries = pages.where(host.isNotNull()).select(
        F.explode(
            F.array(
                F.struct(F.lit("hosts").alias("list_name"), F.concat(F.lit("d:"), host).alias("pattern")),
                F.struct(F.lit("parents").alias("list_name"), F.concat(F.lit("d:"), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")).alias("pattern")),
                F.struct(F.lit("paths").alias("list_name"), F.concat(F.lit("p:"), host, F.lit("/"), first).alias("pattern")),
            )
        ).alias("e")
    ).select("e.*").dropna().distinct()
    hexed = F.md5(F.concat_ws(" ", "list_name", "pattern"))
    n = entries.select("list_name", "pattern", digit(hexed, 1).alias("n1"), (digit(hexed, 7) % (DAYS // 3)).cast("int").alias("d1"), (1 + digit(hexed, 13) % (DAYS // 4)).cast("int").alias("d2"), (1 + digit(hexed, 19) % (DAYS // 4)).cast("int").alias("d3"))
    day = lambda *parts: F.date_add(F.lit(FIRST_DAY).cast("date"), sum(parts[1:], parts[0]))
    row = lambda when, date, action: F.when(when, F.struct(date.alias("event_date"), F.lit(action).alias("action")))
    d1, d2, d3, n1 = (F.col(c) for c in ("d1", "d2", "d3", "n1"))
    log = F.array(row(n1 % 3 == 0, day(d1), "add"), row(n1 % 6 == 0, day(d1, d2), "remove"), row(n1 % 24 == 0, day(d1, d2, d3), "add"))
    return n.select("list_name", "pattern", F.explode(F.filter(log, lambda x: x.isNotNull())).alias("e")).select("list_name", "pattern", "e.event_date", "e.action")


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    """Every page as a capture on a day that follows from its URL, judged by the derived lists."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit(FIRST_DAY).cast("date"), (digit(F.md5("url"), 1) % DAYS).cast("int"))
    return filter_captures(pages.withColumn("fetch_date", fetched), derived_events(pages))


OP9_SQL = rf"""
WITH seen AS (
  SELECT row_number() OVER () AS rid, page_id, url,
         DATE '{FIRST_DAY}' + CAST(('0x' || substr(md5(url), 1, 6))::BIGINT % {DAYS} AS INTEGER) AS fetch_date,
         nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', ''), '') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages),
keyed AS (
  SELECT rid, page_id, url, fetch_date, host, parts, string_split(host, '.') AS labels FROM seen),
asked AS (
  SELECT DISTINCT rid, page_id, url, fetch_date, 'd:' || array_to_string(list_slice(labels, i, len(labels)), '.') AS pattern
  FROM keyed, unnest(range(1, greatest(len(labels), 2))) AS t(i) WHERE host IS NOT NULL
  UNION
  SELECT DISTINCT rid, page_id, url, fetch_date, 'p:' || host || '/' || array_to_string(list_slice(parts, 1, i), '/')
  FROM keyed, unnest(range(1, len(parts) + 1)) AS t(i) WHERE host IS NOT NULL),
entries AS (
  SELECT 'hosts' AS list_name, 'd:' || host AS pattern FROM keyed WHERE host IS NOT NULL
  UNION SELECT 'parents', 'd:' || array_to_string(labels[-2:], '.') FROM keyed WHERE host IS NOT NULL
  UNION SELECT 'paths', 'p:' || host || '/' || parts[1] FROM keyed WHERE host IS NOT NULL AND len(parts) > 0),
hexed AS (SELECT *, md5(list_name || ' ' || pattern) AS m FROM entries),
dated AS (
  SELECT list_name, pattern, ('0x' || substr(m, 1, 6))::BIGINT AS n1,
         CAST(('0x' || substr(m, 7, 6))::BIGINT % {DAYS // 3} AS INTEGER) AS d1,
         CAST(1 + ('0x' || substr(m, 13, 6))::BIGINT % {DAYS // 4} AS INTEGER) AS d2,
         CAST(1 + ('0x' || substr(m, 19, 6))::BIGINT % {DAYS // 4} AS INTEGER) AS d3 FROM hexed),
spans AS (
  SELECT list_name, pattern, DATE '{FIRST_DAY}' + d1 AS valid_from,
         CASE WHEN n1 % 6 = 0 THEN DATE '{FIRST_DAY}' + (d1 + d2) ELSE DATE '{FAR_FUTURE}' END AS valid_to FROM dated WHERE n1 % 3 = 0
  UNION ALL
  SELECT list_name, pattern, DATE '{FIRST_DAY}' + (d1 + d2 + d3), DATE '{FAR_FUTURE}' FROM dated WHERE n1 % 24 = 0),
met AS (
  SELECT a.rid, s.list_name, s.pattern, s.valid_from,
         row_number() OVER (PARTITION BY a.rid ORDER BY length(s.pattern) DESC, s.list_name, s.valid_from DESC) AS k,
         count(*) OVER (PARTITION BY a.rid) AS n
  FROM asked a JOIN spans s ON a.pattern = s.pattern AND s.valid_from <= a.fetch_date AND a.fetch_date < s.valid_to)
SELECT s.page_id, s.url, s.fetch_date, coalesce(m.n, 0) AS n_entries, m.n IS NOT NULL AS blocked, m.list_name, m.pattern, m.valid_from
FROM seen s LEFT JOIN met m ON m.rid = s.rid AND m.k = 1
"""
