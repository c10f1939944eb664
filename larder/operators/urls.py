"""References of pages, and the seeds phase of a crawl: robots and sitemaps to the URLs that may be fetched."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .crawl import AGENTS, RECIPE_URL, allowed_urls, filter_urls, parse_robots, sitemap_locations
from .store import materialize

#: RFC 3986, appendix B: scheme 2, authority 4 (3 with its slashes), path 5, query 6 with its mark, fragment 8 with its mark.
PARTS = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"


def remove_dots(path: Column) -> Column:
    """A path without its . and .. segments (RFC 3986, 5.2.4): .. takes the segment before it away, if there is one."""
    plain = F.regexp_replace(path, r"^(?:\.\.?/)+(?:\.\.?$)?|^\.\.?$", "")
    plain = F.when(plain.rlike(r"(^|/)\.\.?$"), F.concat(plain, F.lit("/"))).otherwise(plain)
    segments = F.regexp_extract_all(plain, F.lit(r"(^[^/]+|/[^/]*)"), F.lit(1))

    def step(kept, s):
        less = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(s == "/.", kept).when(s == "/..", less).otherwise(F.array_append(kept, s))

    return F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "")


def resolve(base: Column, reference: Column) -> Column:
    """The target of a reference on a page (RFC 3986, 5.2.2, strict): ../x, ./x, ?q, #f, //host/x, /x or a whole URI.
    Null where either is null."""
    part = lambda x, i: F.regexp_extract(x, PARTS, i)
    b = {n: part(base, i) for n, i in (("scheme", 1), ("authority", 3), ("path", 5), ("query", 6))}
    r = {n: part(reference, i) for n, i in (("scheme", 1), ("authority", 3), ("path", 5), ("query", 6), ("fragment", 8))}

    def told(x):
        own = (x["rs"] != "") | (x["ra"] != "")
        folder = F.when((x["ba"] != "") & (x["bp"] == ""), F.lit("/")).otherwise(F.regexp_extract(x["bp"], r"^(.*/)?", 0))
        merged = F.when(own | x["rp"].startswith("/"), x["rp"]).otherwise(F.concat(folder, x["rp"]))
        path = F.when(~own & (x["rp"] == ""), x["bp"]).otherwise(remove_dots(merged))
        query = F.when(~own & (x["rp"] == "") & (x["rq"] == ""), x["bq"]).otherwise(x["rq"])
        return F.concat(F.when(x["rs"] != "", x["rs"]).otherwise(x["bs"]), F.when(own, x["ra"]).otherwise(x["ba"]), path, query, x["rf"])

    both = F.struct(*(b[n].alias("b" + n[0]) for n in b), *(r[n].alias("r" + n[0]) for n in r))
    return F.when(base.isNotNull() & reference.isNotNull(), F.transform(F.array(both), told)[0])


def resolved_links(links: DataFrame, pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """links (page id, n, href) with target: where each leads from its page."""
    own = pages.select(F.col(id_col), F.col(url_col).alias("__url"))
    return links.join(own, id_col).select(*links.columns, resolve(F.col("__url"), F.trim("href")).alias("target"))


# -- seeds -----------------------------------------------------------------------------------------


def sitemap_closure(sitemaps: DataFrame, roots: DataFrame, url_col: str = "url", xml_col: str = "xml", most: int = 100) -> DataFrame:
    """(url, depth, xml): the root sitemaps and all that their indexes lead to, at any depth, each once, at its least depth.

    A round joins the newest ones' children with the documents; what has been visited is left out, so a circle ends.
    Rounds are as many as the deepest chain; more than `most` is an error, not a cut.
    """
    documents = sitemaps.select(F.col(url_col).alias("url"), F.col(xml_col).alias("xml")).groupBy("url").agg(F.min("xml").alias("xml"))
    new = materialize(documents.join(roots.select(F.col(url_col).alias("url")).distinct(), "url", "left_semi").withColumn("depth", F.lit(0)))
    found, depth = new, 0
    while not new.isEmpty():
        depth += 1
        if depth > most:
            raise ValueError(f"sitemap indexes nest deeper than {most}")
        children = sitemap_locations(new, "xml").filter("is_index").select(F.col("loc").alias("url")).distinct()
        new = materialize(documents.join(children.join(found.select("url"), "url", "left_anti"), "url", "left_semi").withColumn("depth", F.lit(depth)))
        found = found.unionByName(new)
    return found.select("url", "depth", "xml")


@dataclass
class Seeds:
    """seeds (url), in no order; rules (host, pattern); sitemaps (url, depth); stats: one row of counts."""

    seeds: DataFrame
    rules: DataFrame
    sitemaps: DataFrame
    stats: DataFrame


def find_seeds(robots: DataFrame, sitemaps: DataFrame, known: list[str] = (), pattern: str = RECIPE_URL, agents=AGENTS, rfc: bool = False) -> Seeds:
    """The seeds phase as one plan: robots lines (host, line_no, line) give rules and root sitemaps, these lead to all others,
    their locations are filtered by the pattern, deduplicated and held against their host's rules.

    known: root sitemaps where no robots file names one. sitemaps (url, xml) holds what has been fetched. A location that
    several sitemaps list counts once a listing as seen, once as unique.
    """
    rules, roots = parse_robots(robots, agents)
    roots = roots.select(F.col("sitemap").alias("url")).distinct()
    if known and roots.isEmpty():
        roots = sitemaps.sparkSession.createDataFrame([(u,) for u in known], "url string")
    visited = sitemap_closure(sitemaps, roots)
    seen = sitemap_locations(visited, "xml").filter("not is_index").select(F.col("loc").alias("url"))
    recipes = materialize(filter_urls(seen, pattern))
    unique = recipes.distinct()
    seeds = materialize(allowed_urls(unique, rules.distinct(), rfc=rfc).select("url"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [count(visited, "sitemaps_parsed"), count(seen, "urls_seen"), count(recipes, "urls_recipe"), count(unique, "urls_unique"), count(seeds, "urls_allowed"), count(rules.distinct(), "disallow_patterns")]
    stats = parts[0]
    for p in parts[1:]:
        stats = stats.crossJoin(F.broadcast(p))  # one row each
    return Seeds(seeds, rules, visited.select("url", "depth"), stats)

