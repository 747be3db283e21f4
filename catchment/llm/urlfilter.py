"""URL filters against a dated list: every capture is judged by the entries active when it was fetched.

The list is a log of (entry, kind, category, listed_at, action) rows with action ``add`` or
``remove``. For each entry and category the log becomes validity intervals: from an ``add`` to the
next row of that entry. A capture's keys are its host (kind ``host``), the host and all its parent
domains (``domain``), and the host with each leading run of path segments (``prefix``). The as-of
join is an equi-join on kind and key with the fetch time inside the interval.

Only built-in functions and joins are used. Captures are reduced to distinct (url, fetched_at)
before the join, and keys are only made of the kinds and depths that the list has; so a top-level
domain is a key only where the list names one. The join carries keys only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catchment.llm.common import stored


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and final dot; "" if there is none."""
    host = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.coalesce(F.regexp_replace(F.lower(host), r"\.$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """Path without query and fragment, its slashes kept; "" if there is none."""
    return F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """kind, key, category, valid_from, valid_to (exclusive; null: still active).

    Rows of one entry at one time count as one, and ``remove`` wins over ``add``. Repeated ``add``
    rows while active change nothing. Rows with a null entry, kind, time or action are void; a null
    category is one of its own.
    """
    good = entries.where("entry is not null and kind is not null and listed_at is not null and action in ('add', 'remove')")
    log = good.groupBy("kind", F.lower("entry").alias("key"), "category", "listed_at").agg(F.max("action").alias("action"))
    order = Window.partitionBy("kind", "key", "category").orderBy("listed_at")
    log = log.withColumn("valid_to", F.lead("listed_at").over(order))
    return log.where("action = 'add'").select("kind", "key", "category", F.col("listed_at").alias("valid_from"), "valid_to")


def capture_keys(captures: DataFrame, depths: dict[str, list[int]] | None = None) -> DataFrame:
    """url, fetched_at, kind, key for each distinct capture.

    ``depths`` names, for each kind, the numbers of labels or segments of the keys to make; all, if
    it is left out.
    """
    rows = captures.select("url", "fetched_at").distinct().where("url is not null and fetched_at is not null")
    rows = rows.withColumn("host", host_of(F.col("url"))).where("host <> ''")
    rows = rows.withColumn("labels", F.split("host", r"\.")).withColumn("segments", F.filter(F.split(path_of(F.col("url")), "/"), lambda x: x != ""))

    def steps(kind: str, size: Column) -> Column:
        every = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.expr("cast(array() as array<int>)"))
        return every if depths is None else F.filter(F.array(*map(F.lit, depths.get(kind, []))).cast("array<int>"), lambda k: (k >= 1) & (k <= size))

    n = F.size("labels")
    domains = F.transform(steps("domain", n), lambda k: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice("labels", n - k + 1, k), ".").alias("key")))
    prefixes = F.transform(steps("prefix", F.size("segments")), lambda k: F.struct(F.lit("prefix").alias("kind"), F.concat("host", F.lit("/"), F.array_join(F.slice("segments", F.lit(1), k), "/")).alias("key")))
    kinds = [domains, prefixes]
    if depths is None or "host" in depths:
        kinds.append(F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("key"))))
    return rows.select("url", "fetched_at", F.explode(F.concat(*kinds)).alias("k")).select("url", "fetched_at", "k.kind", "k.key")


def listed_depths(spans: DataFrame) -> dict[str, list[int]]:
    """For each kind in the list, how many labels or segments its keys have, each number once.

    The numbers are few: a host has at most 127 labels, a path as many segments as a URL can hold.
    """
    size = F.when(F.col("kind") == "domain", F.size(F.split("key", r"\."))).when(F.col("kind") == "prefix", F.size(F.split("key", "/")) - 1).otherwise(0)
    rows = spans.where("kind in ('host', 'domain', 'prefix')").select("kind", size.alias("depth")).groupBy("kind").agg(F.collect_set("depth").alias("depths"))
    return {r["kind"]: sorted(r["depths"]) for r in rows.collect()}


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` with blocked, n_entries, categories and first_listed as of fetched_at.

    Columns of these names are replaced; all others and all rows are kept, repeated ones too. Null
    urls or times, and urls without a host, match nothing: false, 0, "" and null.
    """
    captures = captures.drop("blocked", "n_entries", "categories", "first_listed")
    spans = stored(intervals(entries), "spans")
    keys = capture_keys(captures, listed_depths(spans))
    active = keys.join(spans, ["kind", "key"]).where("fetched_at >= valid_from and (valid_to is null or fetched_at < valid_to)")
    verdict = active.groupBy("url", "fetched_at").agg(
        F.count("*").alias("n_entries"),
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
        F.min("valid_from").alias("first_listed"),
    )
    verdict = verdict.select(F.col("url").alias("_u"), F.col("fetched_at").alias("_t"), "n_entries", "categories", "first_listed")
    joined = captures.join(verdict, (F.col("url") == F.col("_u")) & (F.col("fetched_at") == F.col("_t")), "left")
    return joined.select(
        *captures.columns,
        F.col("n_entries").isNotNull().alias("blocked"),
        F.coalesce("n_entries", F.lit(0)).alias("n_entries"),
        F.coalesce("categories", F.lit("")).alias("categories"),
        "first_listed",
    )


#: The query's captures and list. Fetch times follow from page_id; the list is a log over all hosts.
CAPTURES = "SELECT page_id, url, CAST('2024-01-01' AS DATE) + CAST(page_id * 37 % 360 AS INT) AS fetched_at FROM pages"
ENTRIES = """
SELECT entry, kind, category, listed_at, action FROM (
  SELECT host AS entry, 'domain' AS kind, 'spam' AS category, CAST('2023-06-01' AS DATE) AS listed_at, 'add' AS action FROM hosts WHERE host LIKE '%spam-farm%' OR host LIKE '%cheap-pills%'
  UNION ALL SELECT host, 'host', 'adult', CAST('2024-01-10' AS DATE) + d, 'add' FROM hosts WHERE a % 3 = 0
  UNION ALL SELECT host, 'host', 'adult', CAST('2024-03-10' AS DATE) + d, 'remove' FROM hosts WHERE a % 3 = 0
  UNION ALL SELECT host, 'host', 'adult', CAST('2024-06-10' AS DATE) + d, 'add' FROM hosts WHERE a % 6 = 0
  UNION ALL SELECT host || '/en', 'prefix', 'machine', CAST('2024-03-01' AS DATE) + d, 'add' FROM hosts WHERE a % 3 = 1
  UNION ALL SELECT regexp_replace(host, '^[^.]*[.]', ''), 'domain', 'proxy', CAST('2024-11-01' AS DATE), 'add' FROM hosts WHERE a % 16 = 5
)
"""
HOSTS = "SELECT DISTINCT host, ascii(substr(md5(host), 1, 1)) AS a, CAST(ascii(substr(md5(host), 2, 1)) AS INT) AS d FROM (SELECT {host} AS host FROM pages) WHERE host <> ''"


def filter_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The whole ``pages`` table against the dated list."""
    hosts = spark.sql(HOSTS.format(host="host").replace("FROM pages", "FROM {pages}"), pages=pages.select(host_of(F.col("url")).alias("host")))
    entries = spark.sql(ENTRIES.replace("FROM hosts", "FROM {hosts}"), hosts=hosts)
    captures = spark.sql(CAPTURES.replace("FROM pages", "FROM {pages}"), pages=pages)
    found = filter_urls(captures, entries)
    return found.withColumns({c: F.col(c).cast("string") for c in ("fetched_at", "first_listed")})


SQL = (
    """
WITH hosts AS ("""
    + HOSTS.format(host="coalesce(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '[.]$', ''), '')")
    + "), entries AS ("
    + ENTRIES
    + "), captures AS ("
    + CAPTURES
    + """), log AS (
  SELECT kind, lower(entry) AS key, category, listed_at, max(action) AS action FROM entries GROUP BY ALL
), spans AS (
  SELECT * FROM (SELECT *, lead(listed_at) OVER (PARTITION BY kind, key, category ORDER BY listed_at) AS valid_to FROM log) WHERE action = 'add'
), parts AS (
  SELECT *, string_split(host, '.') AS labels, list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS segments
  FROM (SELECT *, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '[.]$', '') AS host FROM captures) WHERE host <> ''
), keys AS (
  SELECT page_id, fetched_at, 'host' AS kind, host AS key FROM parts
  UNION ALL SELECT page_id, fetched_at, 'domain', array_to_string(labels[k:], '.') FROM parts, unnest(range(1, len(labels) + 1)) t(k)
  UNION ALL SELECT page_id, fetched_at, 'prefix', host || '/' || array_to_string(segments[1:k], '/') FROM parts, unnest(range(1, len(segments) + 1)) t(k)
), verdict AS (
  SELECT page_id, count(*) AS n_entries, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories, min(listed_at) AS first_listed
  FROM keys JOIN spans USING (kind, key) WHERE fetched_at >= listed_at AND (valid_to IS NULL OR fetched_at < valid_to) GROUP BY page_id
)
SELECT page_id, url, strftime(fetched_at, '%Y-%m-%d') AS fetched_at, n_entries IS NOT NULL AS blocked, coalesce(n_entries, 0) AS n_entries, coalesce(categories, '') AS categories, strftime(first_listed, '%Y-%m-%d') AS first_listed
FROM captures LEFT JOIN verdict USING (page_id)
"""
)
