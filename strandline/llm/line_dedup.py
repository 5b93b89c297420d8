"""Line dedup by site-relative frequency, with DataFrame functions only.

For each host the pages that contain a line are counted (a page once, however often the line is on
it) and divided by the host's page total; lines above the boilerplate ratio are dropped from the
host's pages. Per host there are at most (mean distinct lines of a page) / ratio such lines, so they
fit an array beside the host. Counting uses partial aggregation, and hosts with many pages are dealt
out over salted keys, so a host with a third of all pages is no single task.

Null texts stay null and have no lines; a null host is one host of its own. Blank lines are never
counted nor dropped. Repeated rows count as pages of their own, unless distinct_pages is set, which
counts equal texts of a host once, in both counts. Empty tables give empty results. Columns of the
input keep their names and values; only the text changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, fresh, table

RATIO, LEAST_PAGES = 0.1, 3
#: Scripts, styles, comments and tags of a page; what is between them are its lines.
MARKUP = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def boilerplate(pages: DataFrame, ratio: float, least_pages: int, distinct_pages: bool = False) -> DataFrame:
    """From (host, lines): (host, drop), the lines of each host above the ratio on at least least_pages pages."""
    seen = pages.select(F.col("host"), F.array_distinct(F.filter("lines", lambda x: F.trim(x) != "")).alias("own"), F.lit(1).alias("page"))
    if distinct_pages:
        seen = pages.select("host", "lines", F.sha2(F.array_join("lines", "\n"), 256).alias("digest")).dropDuplicates(["host", "digest"]).select("host", F.array_distinct(F.filter("lines", lambda x: F.trim(x) != "")).alias("own"))
    totals = seen.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counts = seen.select("host", F.explode("own").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_pages)
    return counts.join(totals, "host").filter(F.col("n") > F.lit(float(ratio)) * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("drop"))


def host_key(col):
    """A join key that keeps a null host apart from every other."""
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("h"), col))


#: A host with more than this share of all pages is dealt out: there are at most HOT_SHARE such hosts, so their list is small.
HOT_SHARE, SALTS = 1000, 64


def line_dedup(df: DataFrame, host, lines, ratio: float = RATIO, least_pages: int = LEAST_PAGES, distinct_pages: bool = False) -> tuple[DataFrame, str, str]:
    """df with two more columns, and their names, which no column of df has: the lines (array or null) and those that stay, in order.

    host and lines are columns of df. A line goes if it is on at least least_pages pages of the host and on more than
    ratio of them; least_pages=1 is the ratio alone. Pages of hot hosts meet their host's lines under one of SALTS keys, by a hash of the row.
    """
    key, own_lines, salt, drop, number, hot_one, kept = fresh(df.columns, "host", "lines", "salt", "drop", "n", "hot", "kept")
    own = df.withColumns({key: host_key(host), own_lines: lines, salt: F.pmod(F.xxhash64(*map(col, df.columns)), F.lit(SALTS)).cast("int")})
    gone = boilerplate(own.select(F.col(key).alias("host"), F.coalesce(F.col(own_lines), F.array().cast("array<string>")).alias("lines")), ratio, least_pages, distinct_pages).select(F.col("host").alias(key), F.col("drop").alias(drop))
    total = df.count()
    hot = F.broadcast(own.groupBy(key).agg(F.count(F.lit(1)).alias(number)).filter(F.col(number) * HOT_SHARE > total).select(key, F.lit(True).alias(hot_one)))
    own = own.join(hot, key, "left").withColumn(salt, F.when(F.col(hot_one), F.col(salt)).otherwise(0)).drop(hot_one)
    every = F.when(F.col(hot_one), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    gone = gone.join(hot, key, "left").select(key, drop, F.explode(every).alias(salt))
    stay = F.when(F.col(drop).isNull(), F.col(own_lines)).otherwise(F.filter(F.col(own_lines), lambda x: ~F.array_contains(F.col(drop), x)))
    return own.join(gone, [key, salt], "left").select(*map(col, df.columns), own_lines, stay.alias(kept)), own_lines, kept


def dedup_documents(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES, distinct_pages: bool = True) -> DataFrame:
    """The same columns; lines of the text (cut at \\n) that are boilerplate of their source are gone."""
    out, lines, kept = line_dedup(docs, col(host_col), F.split(col(text_col), "\n", -1), ratio, least_pages, distinct_pages)
    text = F.when(F.col(lines).isNull(), col(text_col)).otherwise(F.array_join(kept, "\n"))
    return out.select(*[text.alias(c) if c == text_col else col(c) for c in docs.columns])


def page_lines(html):
    """Trimmed non-empty pieces of text between the markup of a page."""
    return F.filter(F.transform(F.split(F.regexp_replace(html, MARKUP, "\n"), "[\r\n]+", -1), lambda x: F.trim(x)), lambda x: x != "")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages: page_id, host, n_lines, n_dropped and the text that stays."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    host = F.lower(F.regexp_extract("url", HOST, 1))
    out, lines, kept = line_dedup(pages, host, page_lines(F.coalesce("html", F.lit(""))))
    return out.select("page_id", host.alias("host"), F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(kept)).cast("long").alias("n_dropped"), F.array_join(kept, "\n").alias("text"))


SQL = rf"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '{HOST}', 1)) AS host,
         [trim(x, ' ') FOR x IN regexp_split_to_array(regexp_replace(coalesce(html, ''), '{MARKUP}', chr(10), 'g'), '[\r\n]+') IF trim(x, ' ') <> ''] AS lines
  FROM pages
), c AS (
  SELECT host, line, count(*) AS n FROM (SELECT page_id, host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line
), t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
b AS (SELECT c.host, list(line) AS drops FROM c JOIN t ON c.host IS NOT DISTINCT FROM t.host WHERE n >= {LEAST_PAGES} AND n > {RATIO}::DOUBLE * pages GROUP BY c.host)
SELECT page_id, p.host, len(lines) AS n_lines,
       len(lines) - len([x FOR x IN lines IF NOT list_contains(coalesce(drops, []), x)]) AS n_dropped,
       array_to_string([x FOR x IN lines IF NOT list_contains(coalesce(drops, []), x)], chr(10)) AS text
FROM p LEFT JOIN b ON p.host IS NOT DISTINCT FROM b.host
"""
