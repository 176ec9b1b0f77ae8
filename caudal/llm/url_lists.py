"""URL filter by dated lists: a temporal join of captures and list entries.

An entry adds a pattern to a list or removes it from there on a date. Entries
become validity intervals (from an addition up to the pattern's next entry in
that list, the end excluded), and every capture is judged by the intervals
that hold on the day of its fetch: it is dropped when a ``block`` entry is
active and no ``allow`` entry is.

A pattern is ``d:`` and a domain, which covers the hosts below it, or ``p:``
and a host with leading path segments. A capture's keys are all domains above
its host and all its leading paths, so the as-of join is an equi-join on
pattern and month, in which a pattern has a row per day at most. Captures are
reduced to distinct (url, day) pairs first and judged once each.

Defined results. A null or unreadable url, or a null fetch date, matches no
entry and is kept. Of entries on the same day for one pattern and list a
removal wins; repeated entries count once; entries with a null in any field
are ignored, as are lists other than the two. Repeated captures are all
judged. Empty tables are allowed on either side. Extra columns, whatever
their names, are kept by :func:`filter_captures` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caudal.llm.joins import counted_join
from caudal.llm.tables import written

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(url, _HOST, 1), r"\.+$", ""))


def segments_of(url: Column) -> Column:
    return F.filter(F.split(F.regexp_extract(url, _PATH, 1), "/"), lambda s: s != "")


def url_keys(url: Column) -> Column:
    """Every pattern that covers ``url``; none for a url without a host."""
    host, segs = host_of(url), segments_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(labels, lambda _, i: F.concat(
        F.lit("d:"), F.array_join(F.slice(labels, i + 1, F.size(labels) - i), ".")))
    paths = F.transform(segs, lambda _, i: F.concat(
        F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(segs, 1, i + 1), "/")))
    return F.when(host != "", F.concat(domains, paths)).otherwise(F.array().cast("array<string>"))


def validity(entries: DataFrame) -> DataFrame:
    """(list, pattern, since, until) of entries (list, pattern, action, dated); ``until`` is null while open."""
    days = (entries.select("list", "pattern", "action", F.col("dated").cast("date").alias("dated"))
            .filter(F.col("list").isin("block", "allow") & F.col("action").isin("add", "remove")
                    & F.col("pattern").isNotNull() & F.col("dated").isNotNull())
            .groupBy("list", "pattern", "dated").agg(F.max(F.col("action") == "remove").alias("gone")))
    # One row per pattern and day, so a window's rows are bounded by the days of the list's history.
    return (days.withColumn("until", F.expr("lead(dated) OVER (PARTITION BY list, pattern ORDER BY dated)"))
            .filter("NOT gone").select("list", "pattern", F.col("dated").alias("since"), "until"))


def verdicts(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """(url, day, n_block, n_allow): active entries for each distinct capture that any entry covers."""
    seen = (captures.select(F.col(url).alias("url"), F.col(fetched).cast("date").alias("day"))
            .filter("url IS NOT NULL AND day IS NOT NULL").distinct())
    span = seen.agg(F.struct(F.min("day").alias("first"), F.max("day").alias("last"))).scalar()
    first, last = span.getField("first"), span.getField("last")
    keyed = seen.withColumn("month", F.trunc("day", "month")).withColumn("pattern", F.explode(url_keys(F.col("url"))))
    # Intervals by month of the captures' time range: a (pattern, list, month) has 31 rows at most.
    intervals = (validity(entries)
                 .withColumn("from", F.greatest("since", first))
                 .withColumn("to", F.least(F.coalesce(F.date_sub("until", 1), last), last))
                 .filter(F.col("from") <= F.col("to"))
                 .withColumn("month", F.explode(F.sequence(F.trunc("from", "month"), F.trunc("to", "month"),
                                                           F.expr("interval 1 month"))))
                 .select("list", "pattern", "month", "from", "to"))
    # Most of a url's patterns are on no list: only those that are go into the shuffle.
    intervals = written(intervals)
    keyed = counted_join(keyed, intervals.select("pattern").distinct(), ["pattern"], "left_semi")
    active = keyed.join(intervals, ["pattern", "month"]).filter(F.col("day").between(F.col("from"), F.col("to")))
    return active.groupBy("url", "day").agg(F.count_if(F.col("list") == "block").alias("n_block"),
                                            F.count_if(F.col("list") == "allow").alias("n_allow"))


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url: str = "url",
          fetched: str = "fetched") -> DataFrame:
    """(page_id, fetched, n_block, n_allow, kept) per capture."""
    v = verdicts(captures, entries, url, fetched).select(
        F.col("url").alias("_url"), F.col("day").alias("_day"), "n_block", "n_allow")
    rows = captures.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"),
                           F.col(fetched).cast("date").alias("fetched"))
    zero = F.lit(0).cast("long")
    return (rows.join(v, (F.col("url") == F.col("_url")) & (F.col("fetched") == F.col("_day")), "left")
            .select("page_id", "fetched", F.coalesce("n_block", zero).alias("n_block"),
                    F.coalesce("n_allow", zero).alias("n_allow"))
            .withColumn("kept", (F.col("n_block") == 0) | (F.col("n_allow") > 0)))


def filter_captures(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` that the lists of their day let through, all columns as they were."""
    bad = verdicts(captures, entries, url, fetched).filter("n_block > 0 AND n_allow = 0").select(
        F.col("url").alias("_url"), F.col("day").alias("_day"))
    return captures.join(bad, (captures[url] == bad["_url"]) & (captures[fetched].cast("date") == bad["_day"]), "left_anti")


# -- the registered query's captures and lists, derived from ``pages`` ---------------------
#
# The tables have no fetch dates and no lists, so both are worked out from page
# ids: a capture's day, and per host, leading path and domain the days of its
# entries from the smallest page id below it.

_DAY0 = "date '2000-01-01'"


def dated_captures(pages: DataFrame) -> DataFrame:
    day = F.expr(f"date_add({_DAY0}, cast(page_id * 7919 % 1000 as int))")
    return pages.select("page_id", "url", day.alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """(list, pattern, action, dated): as many entries as hosts and paths call for."""
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), segments_of(F.col("url")).alias("segs"))
    urls = urls.filter("host <> ''")
    labels = F.split("host", r"\.")
    keys = urls.select("page_id", F.explode(F.array(
        F.struct(F.lit("host").alias("kind"), F.concat(F.lit("d:"), "host").alias("pattern")),
        F.struct(F.lit("path").alias("kind"),
                 F.concat(F.lit("p:"), "host", F.lit("/"), F.get("segs", F.lit(0))).alias("pattern")),
        F.struct(F.lit("domain").alias("kind"), F.concat(F.lit("d:"), F.array_join(F.slice(
            labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".")).alias("pattern")))).alias("k")).select("page_id", "k.*")
    m = keys.filter("pattern IS NOT NULL").groupBy("kind", "pattern").agg(F.min("page_id").alias("m"))
    plans = F.expr("""filter(array(
        struct('block' AS list, 'add' AS action, m * 37 % 700 AS day, kind = 'host' AND m % 3 = 0 AS used),
        struct('block' AS list, 'remove' AS action, m * 37 % 700 + 40 + m % 200 AS day, kind = 'host' AND m % 3 = 0 AS used),
        struct('block' AS list, 'add' AS action, m * 37 % 700 + 300 + m % 100 AS day, kind = 'host' AND m % 6 = 0 AS used),
        struct('allow' AS list, 'add' AS action, m * 29 % 800 AS day, kind = 'host' AND m % 7 = 0 AS used),
        struct('allow' AS list, 'remove' AS action, m * 29 % 800 + 90 AS day, kind = 'host' AND m % 7 = 0 AS used),
        struct('block' AS list, 'add' AS action, m * 53 % 900 AS day, kind = 'path' AND m % 5 = 1 AS used),
        struct('block' AS list, 'add' AS action, 100 + m % 50 AS day, kind = 'domain' AS used),
        struct('block' AS list, 'remove' AS action, 115 + m % 50 AS day, kind = 'domain' AS used)), x -> x.used)""")
    return (m.select("pattern", F.explode(plans).alias("x"))
            .select("x.list", "pattern", "x.action", F.expr(f"date_add({_DAY0}, cast(x.day as int))").alias("dated")))


def judged_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    pages = pages.select("page_id", "url")
    return judge(dated_captures(pages), derived_entries(pages))


#: DuckDB statement for the rows of ``judged_pages(pages)``.
ORACLE = r"""
WITH u AS (
  SELECT page_id, url, page_id * 7919 % 1000 AS d,
         lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)', 1), '\.+$', '')) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS segs
  FROM pages),
l AS (SELECT *, string_split(host, '.') AS labels FROM u WHERE host <> ''),
k AS (
  SELECT 'host' AS kind, 'd:' || host AS pattern, min(page_id) AS m FROM l GROUP BY ALL
  UNION ALL SELECT 'path', 'p:' || host || '/' || segs[1], min(page_id) FROM l WHERE len(segs) > 0 GROUP BY ALL
  UNION ALL SELECT 'domain', 'd:' || array_to_string(labels[greatest(len(labels) - 1, 1):], '.'), min(page_id) FROM l GROUP BY ALL),
e AS (
  SELECT 'block' AS list, pattern, 'add' AS action, m * 37 % 700 AS d FROM k WHERE kind = 'host' AND m % 3 = 0
  UNION ALL SELECT 'block', pattern, 'remove', m * 37 % 700 + 40 + m % 200 FROM k WHERE kind = 'host' AND m % 3 = 0
  UNION ALL SELECT 'block', pattern, 'add', m * 37 % 700 + 300 + m % 100 FROM k WHERE kind = 'host' AND m % 6 = 0
  UNION ALL SELECT 'allow', pattern, 'add', m * 29 % 800 FROM k WHERE kind = 'host' AND m % 7 = 0
  UNION ALL SELECT 'allow', pattern, 'remove', m * 29 % 800 + 90 FROM k WHERE kind = 'host' AND m % 7 = 0
  UNION ALL SELECT 'block', pattern, 'add', m * 53 % 900 FROM k WHERE kind = 'path' AND m % 5 = 1
  UNION ALL SELECT 'block', pattern, 'add', 100 + m % 50 FROM k WHERE kind = 'domain'
  UNION ALL SELECT 'block', pattern, 'remove', 115 + m % 50 FROM k WHERE kind = 'domain'),
days AS (SELECT list, pattern, d, bool_or(action = 'remove') AS gone FROM e GROUP BY ALL),
iv AS (SELECT list, pattern, d AS since, gone, lead(d) OVER (PARTITION BY list, pattern ORDER BY d) AS until FROM days),
keys AS (
  SELECT DISTINCT page_id, url, d, unnest(list_concat(
    list_transform(range(1, len(labels) + 1), lambda i: 'd:' || array_to_string(labels[i:], '.')),
    list_transform(range(1, len(segs) + 1), lambda i: 'p:' || host || '/' || array_to_string(segs[1:i], '/')))) AS pattern
  FROM l),
hit AS (
  SELECT page_id, url, count(*) FILTER (list = 'block') AS n_block, count(*) FILTER (list = 'allow') AS n_allow
  FROM keys JOIN iv USING (pattern) WHERE NOT gone AND d >= since AND (until IS NULL OR d < until) GROUP BY ALL)
SELECT u.page_id, CAST(date '2000-01-01' + CAST(u.d AS INTEGER) AS DATE) AS fetched,
       CAST(coalesce(n_block, 0) AS BIGINT) AS n_block, CAST(coalesce(n_allow, 0) AS BIGINT) AS n_allow,
       (coalesce(n_block, 0) = 0 OR coalesce(n_allow, 0) > 0) AS kept
FROM u LEFT JOIN hit ON u.page_id = hit.page_id AND u.url = hit.url
"""
