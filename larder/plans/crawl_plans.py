"""Queries of references, of the seeds phase and of the frontier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import parse, urls
from ..operators.store import new_folder
from ..streaming import frontier
from .registry import query, table

#: References that are put beside a page's own, by its id.
REFERENCES = ("../g", "./g/", "?y=1", "#s", "//other.example/x", "/a/./b/../c", "g;x=1/../y", "../../../g", "", "g:h", "..", "http:g")
_PARTS = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"


def _part(x: str, i: int) -> str:
    return f"regexp_extract({x}, '{_PARTS}', {i})"


_RESOLVED = rf"""WITH h AS (SELECT page_id, url, unnest(list_append(regexp_extract_all(html, '<a\b[^>]*href="([^"]*)"', 1), [{', '.join(repr(r) for r in REFERENCES)}][1 + page_id % {len(REFERENCES)}])) AS href FROM pages),
p AS (SELECT page_id, href, {_part('url', 1)} AS bs, {_part('url', 3)} AS ba, {_part('url', 5)} AS bp, {_part('url', 6)} AS bq, {_part('trim(href)', 1)} AS rs, {_part('trim(href)', 3)} AS ra, {_part('trim(href)', 5)} AS rp, {_part('trim(href)', 6)} AS rq, {_part('trim(href)', 8)} AS rf FROM h),
m AS (SELECT *, rs <> '' OR ra <> '' AS own, CASE WHEN rs <> '' OR ra <> '' OR starts_with(rp, '/') THEN rp WHEN ba <> '' AND bp = '' THEN '/' || rp ELSE regexp_extract(bp, '^(.*/)?', 0) || rp END AS merged FROM p),
d AS (SELECT *, regexp_replace(merged, '^(?:\.\.?/)+(?:\.\.?$)?|^\.\.?$', '') AS q FROM m),
s AS (SELECT *, list_prepend('', regexp_extract_all(CASE WHEN regexp_matches(q, '(^|/)\.\.?$') THEN q || '/' ELSE q END, '(^[^/]+|/[^/]*)')) AS segs FROM d)
SELECT page_id, href, CASE WHEN rs <> '' THEN rs ELSE bs END || CASE WHEN own THEN ra ELSE ba END || CASE WHEN NOT own AND rp = '' THEN bp ELSE list_reduce(segs, lambda a, x: CASE WHEN x = '/.' THEN a WHEN x = '/..' THEN regexp_replace(a, '(^|/)[^/]*$', '') ELSE a || x END) END || CASE WHEN NOT own AND rp = '' AND rq = '' THEN bq ELSE rq END || rf AS target FROM s"""


@query(_RESOLVED)
def resolved_links(spark, sf_dir):
    """Every link of every page, and one odd reference a page, resolved against the page's URL."""
    pages = table(spark, sf_dir, "pages")
    odd = pages.select("page_id", F.lit(-1).alias("n"), F.element_at(text.literals(REFERENCES), (F.col("page_id") % len(REFERENCES) + 1).cast("int")).alias("href"))
    return urls.resolved_links(parse.page_links(pages).unionByName(odd), pages).drop("n")


#: Robots lines of every host of the pages: two kinds of pages are forbidden, one to others alone.
ROBOTS = ("User-agent: *", "Disallow: /de/*", "Disallow: /en/1*", "Sitemap: http://maps/root.xml", "User-agent: other", "Disallow: /")


@query(r"""WITH u AS (SELECT url FROM pages UNION ALL SELECT url FROM pages WHERE page_id % 7 = 0), r AS (SELECT url FROM u WHERE regexp_matches(url, '^https?://[^/]+/[a-z]{2}/[0-9]+')),
a AS (SELECT DISTINCT url, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM r) SELECT url FROM a WHERE NOT regexp_matches(p, '^/de/.*|^/en/1.*')""")
def seeds_phase(spark, sf_dir):
    """Sitemaps four deep, with a circle, that list every page, and some twice: what may be fetched."""
    pages = table(spark, sf_dir, "pages").select("url", F.floor(F.col("page_id") / 20).alias("leaf"), F.floor(F.col("page_id") / 200).alias("part"), "page_id")
    again = pages.filter("page_id % 7 = 0").withColumn("leaf", F.col("leaf") + 1)
    loc = lambda kind, inner, col: F.concat(F.lit(f"<{kind}>"), F.array_join(F.collect_list(F.concat(F.lit(f"<{inner}><loc>"), F.replace(col, F.lit("&"), F.lit("&amp;")), F.lit(f"</loc></{inner}>"))), ""), F.lit(f"</{kind}>"))
    name = lambda kind, col: F.concat(F.lit(f"http://maps/{kind}-"), col.cast("string"), F.lit(".xml"))
    each = pages.unionByName(again)
    leaves = each.groupBy(name("leaf", F.col("leaf")).alias("url")).agg(loc("urlset", "url", F.col("url")).alias("xml"))
    parts = each.select("part", name("leaf", F.col("leaf")).alias("u")).distinct().groupBy(name("part", F.col("part")).alias("url")).agg(loc("sitemapindex", "sitemap", F.col("u")).alias("xml"))
    tops = each.select(F.floor(F.col("part") / 50).alias("top"), name("part", F.col("part")).alias("u")).distinct()
    tops = tops.unionByName(tops.select("top", F.lit("http://maps/root.xml").alias("u")).distinct())
    middle = tops.groupBy(name("top", F.col("top")).alias("url")).agg(loc("sitemapindex", "sitemap", F.col("u")).alias("xml"))
    root = tops.select(name("top", F.col("top")).alias("u")).distinct().groupBy(F.lit("http://maps/root.xml").alias("url")).agg(loc("sitemapindex", "sitemap", F.col("u")).alias("xml"))
    maps = leaves.unionByName(parts).unionByName(middle).unionByName(root)
    hosts = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host")).distinct()
    lines = hosts.select("host", F.posexplode(text.literals(ROBOTS)).alias("line_no", "line"))
    return urls.find_seeds(lines, maps, pattern=r"^https?://[^/]+/[a-z]{2}/[0-9]+").seeds


_EVENTS = "SELECT event_id AS seq, 'http://h/' || (user_id % 997) AS url, 's' || (user_id % 997 % 4) AS source, CASE event_id % 5 WHEN 0 THEN 'take' WHEN 1 THEN 'fail' ELSE 'enqueue' END AS kind FROM events"
_FRONTIER = f"""WITH e AS ({_EVENTS}), f AS (SELECT url, any_value(source) AS source, min(seq) FILTER (kind = 'enqueue') AS a, min(seq) FILTER (kind = 'fail') AS b FROM e GROUP BY url),
g AS (SELECT *, a IS NOT NULL AND (b IS NULL OR a < b) AS accepted FROM f WHERE a IS NOT NULL OR b IS NOT NULL),
t AS (SELECT g.url, min(seq) AS t FROM g JOIN e USING (url) WHERE kind = 'take' AND accepted AND seq > a GROUP BY g.url),
s AS (SELECT g.url, any_value(g.source) AS source, any_value(accepted) AS accepted, any_value(t) AS t, count(*) FILTER (kind = 'fail' AND accepted AND seq > a AND (t IS NULL OR seq < t)) AS tried, count(*) FILTER (kind = 'fail' AND (NOT accepted OR seq > t)) AS lost FROM g LEFT JOIN t USING (url) JOIN e ON e.url = g.url GROUP BY g.url)
SELECT url, source, accepted AND t IS NULL AS queued, tried::INT AS retries, tried > 3 OR lost > 0 AS failed FROM s"""


@query(_FRONTIER)
def frontier_stream(spark, sf_dir):
    """Events as a stream of queued, taken and failed URLs: how each is left."""
    kind = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(kind).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events*.parquet")
    number, what = F.col("user_id") % 997, F.col("event_id") % 5
    events = rows.select(
        F.concat(F.lit("http://h/"), number.cast("string")).alias("url"), F.when(what == 0, "take").when(what == 1, "fail").otherwise("enqueue").alias("kind"), F.concat(F.lit("s"), (number % 4).cast("string")).alias("source"),
        F.lit(0).alias("priority"), F.col("event_id").alias("seq"),
    )
    folder = new_folder(spark, "frontier")
    frontier.run_frontier(events, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return frontier.load_frontier(spark, f"{folder}/out").select("url", "source", "queued", "retries", "failed")
