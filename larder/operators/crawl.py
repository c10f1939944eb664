"""Crawl-side operators over tables of URLs and pages; nothing here opens a connection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranges import numbered

#: What a recipe page's URL looks like, and where its id is.
RECIPE_URL = r"^https://www\.food\.com/recipe/[^/]*-(\d+)(?:/.*)?$"
#: Names that our crawler goes by in robots files; pass others.
AGENTS = ("*",)


def document_id(url: Column) -> Column:
    """The number at the end of /recipe/<name>-<number>, else of /recipe/<number>; empty if neither."""
    return F.coalesce(F.nullif(F.regexp_extract(url, r"/recipe/[^/]*-(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"/recipe/(\d+)", 1), F.lit("")), F.lit(""))


def filter_urls(urls: DataFrame, pattern: str = RECIPE_URL, url_col: str = "url") -> DataFrame:
    return urls.filter(F.col(url_col).rlike(pattern))


def dedupe_urls(urls: DataFrame, seq: str, url_col: str = "url", seen: DataFrame | None = None) -> DataFrame:
    """The first row, by seq, of each URL (by SHA-1), less the ones in seen (sha1). The first is found
    by a partial aggregation, so a URL that is much repeated is one row a task in the shuffle."""
    keyed = urls.withColumn("sha1", F.sha1(F.col(url_col).cast("binary")))
    out = keyed.groupBy("sha1").agg(F.min(F.struct(F.col(seq), F.col(url_col))).alias("m")).select("sha1", f"m.{seq}", f"m.{url_col}")
    return out.join(seen.select("sha1"), "sha1", "left_anti") if seen is not None else out


def canonical_link(html: Column) -> Column:
    """The target of the page's <link rel=canonical> as written."""
    tag = F.regexp_extract(html, r"""(?is)(<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>)""", 1)
    return F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*["']([^"']+)["']""", 1)


def canonical_url(url: Column, html: Column, link: Column | None = None) -> Column:
    """The page's <link rel=canonical> target (or link, where it's known), resolved against its URL, else the URL."""
    link = canonical_link(html) if link is None else link
    from .urls import resolve

    return F.when(F.coalesce(link, F.lit("")) == "", url).otherwise(resolve(url, F.trim(link)))


def parse_robots(lines: DataFrame, agents=AGENTS) -> tuple[DataFrame, DataFrame]:
    """lines (host, line_no, line) -> (host, pattern) of Disallow lines in our agents' groups, and
    (host, sitemap) of any group. A line's group is the last User-agent line before it."""
    text = F.trim(F.regexp_replace("line", "#.*$", ""))
    rows = lines.withColumn("key", F.lower(F.trim(F.substring_index(text, ":", 1)))).withColumn("value", F.when(F.instr(text, ":") > 0, F.trim(text.substr(F.instr(text, ":") + 1, F.length(text)))))
    w = W.partitionBy("host").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("agent", F.last(F.when(F.col("key") == "user-agent", F.lower("value")), ignorenulls=True).over(w))
    rules = rows.filter((F.col("key") == "disallow") & F.col("agent").isin(*agents) & (F.col("value") != "")).select("host", F.col("value").alias("pattern"))
    return rules, rows.filter((F.col("key") == "sitemap") & (F.col("value") != "")).select("host", F.col("value").alias("sitemap"))


def robots_regex(pattern: Column, rfc: bool = False) -> Column:
    """A robots pattern as a regular expression on the path: * is any text; without a * at its end it
    must reach the path's end (by default; with rfc it is a prefix, and $ ends it)."""
    escaped = F.regexp_replace(pattern, r"([.\\+?^$()\[\]{}|])", r"\\$1")
    body = F.replace(escaped, F.lit("*"), F.lit(".*"))
    if rfc:
        return F.concat(F.lit("^"), F.regexp_replace(body, r"\\\$$", r"\$"))
    return F.when(pattern.endswith("*"), F.concat(F.lit("^"), body)).otherwise(F.concat(F.lit("^"), body, F.lit("$")))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def allowed_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", rfc: bool = False) -> DataFrame:
    """URLs that no pattern of their host forbids. rules (host, pattern) as parse_robots gives them, or
    (pattern) for all hosts. A host's patterns, which the format bounds (crawlers read 500 KiB of a
    robots file), become one expression; URLs meet it in a join by host."""
    host = F.lower("host") if "host" in rules.columns else F.lit("")
    one = rules.select(host.alias("__host"), robots_regex(F.col("pattern"), rfc).alias("__re")).groupBy("__host").agg(F.concat_ws("|", F.sort_array(F.collect_set("__re"))).alias("__re"))
    own = urls.withColumn("__own", url_host(F.col(url_col)) if "host" in rules.columns else F.lit(""))
    path = F.regexp_extract(url_col, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return own.join(one, F.col("__own") == F.col("__host"), "left").filter(F.col("__re").isNull() | ~F.coalesce(F.call_function("rlike", path, F.col("__re")), F.lit(False))).drop("__own", "__host", "__re")


def sitemap_locations(xml: DataFrame, xml_col: str = "xml") -> DataFrame:
    """(is_index, loc) of each <loc> in sitemap documents."""
    locs = F.expr(f"""xpath({xml_col}, '//*[local-name()="loc"]/text()')""")
    return xml.select(F.expr(f"""xpath_boolean({xml_col}, '/*[local-name()="sitemapindex"]')""").alias("is_index"), F.explode(locs).alias("loc")).select("is_index", F.trim("loc").alias("loc"))


def all_locations(sitemaps: DataFrame, roots: DataFrame, url_col: str = "url", xml_col: str = "xml") -> DataFrame:
    """Distinct page URLs of the root sitemaps (url) and of all that their indexes lead to.
    sitemaps (url, xml) holds the fetched documents."""
    from .urls import sitemap_closure

    found = sitemap_locations(sitemap_closure(sitemaps, roots, url_col, xml_col), "xml")
    return found.filter("not is_index").select(F.col("loc").alias(url_col)).distinct()


def shuffled(urls: DataFrame, seed: int = 0, url_col: str = "url") -> DataFrame:
    """The rows in an order that only the seed and their URL decide, so it is the same in every run."""
    return urls.orderBy(F.xxhash64(F.lit(seed), F.col(url_col)), url_col)


def enough_ratings(recipes: DataFrame, reviews) -> DataFrame:
    """Rows with more than one review."""
    return recipes.filter(reviews > 1)


#: How many recipes of each cuisine, rating and difficulty a crawl asks for.
CUISINE_QUOTAS = {
    "italian": 400, "mexican": 350, "american": 300, "chinese": 250, "indian": 200, "french": 150, "thai": 150, "japanese": 150, "greek": 100, "korean": 100,
    "spanish": 100, "german": 100, "mediterranean": 80, "middle eastern": 70, "vietnamese": 60, "moroccan": 50, "turkish": 50, "cajun": 50, "creole": 50, "caribbean": 50,
    "brazilian": 40, "lebanese": 40, "polish": 40, "russian": 40, "african": 40, "peruvian": 40, "argentinian": 30, "ethiopian": 30, "cuban": 30, "other": 500,
}
RATING_QUOTAS = {"excellent": 1600, "very_good": 1200, "good": 800, "average": 300, "below_average": 100}
DIFFICULTY_QUOTAS = {"easy": 1800, "medium": 1400, "hard": 600, "unknown": 200}
RECIPE_QUOTAS = {"cuisine_bucket": CUISINE_QUOTAS, "rating_bucket": RATING_QUOTAS, "difficulty_bucket": DIFFICULTY_QUOTAS}
#: Portions whose kept rows one task merges.
FAN_IN = 16


def _first_of_buckets(columns: list[str], most: list[list[int]], order: list[str], drop: bool):
    """Of a task's rows those that are among the first of their bucket in some column. columns hold numbers of buckets, -1 for
    none; at any time a task holds one batch and what it keeps, as many rows as all targets together."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        kept = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows])
            at = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order]).to_numpy()
            keep = np.zeros(len(at), bool)
            for column, targets in zip(columns, most):
                bucket = rows.column(column).to_numpy()[at]
                by = np.argsort(bucket, kind="stable")
                starts = np.flatnonzero(np.r_[True, np.diff(bucket[by]) != 0]) if len(by) else by
                nth = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
                keep[by] |= (bucket[by] >= 0) & (nth < np.array([*targets, 0])[bucket[by]])
            kept = rows.take(pa.array(np.sort(at[keep])))
        if kept is not None:
            kept = kept.drop_columns([*columns, *order[1:]]) if drop else kept
            yield from kept.combine_chunks().to_batches()

    return run


def quota_sample(df: DataFrame, quotas: dict[str, dict[str, int]], seq: str, target: int, other: dict[str, str] | None = None) -> DataFrame:
    """Rows that a reader taking rows in order of seq would keep: a row is kept while any of its
    buckets (one a column in quotas) is under its target, until `target` rows are kept.

    As long as a bucket is under its target all its rows are kept, so a row is kept exactly if in
    some column it is among its bucket's first `target` rows. Of a part of the rows, those that are among the first of the part are
    all that can be among the first of the whole: each task keeps as many rows as all targets together at most, and such
    portions are merged by the same rule, FAN_IN at a time. Rows are read once; no bucket is sorted or gathered.
    Rows that tie in seq go by a hash of the row; null seqs come last; nulls are in no bucket unless `other` names one.
    """
    from pyspark.sql import types as T

    names, most, marked = [], [], df
    for i, (column, targets) in enumerate(quotas.items()):
        fallback = (other or {}).get(column)
        number = F.lit(list(targets).index(fallback) if fallback else -1)
        for j, value in enumerate(targets):
            number = F.when(F.col(column) == value, F.lit(j)).otherwise(number)
        marked = marked.withColumn(f"__bucket{i}", number)
        names.append(f"__bucket{i}")
        most.append(list(targets.values()))
    marked = marked.withColumn("__tie", F.xxhash64(*df.columns))
    order, kind = [seq, "__tie"], marked.schema
    parts = marked.mapInArrow(_first_of_buckets(names, most, order, False), kind)
    n = df.rdd.getNumPartitions()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        parts = parts.repartition(n).mapInArrow(_first_of_buckets(names, most, order, False), kind)
    kept = parts.repartition(1).mapInArrow(_first_of_buckets(names, most, order, True), T.StructType(df.schema.fields))
    return kept.orderBy(F.asc_nulls_last(seq)).limit(target)


# -- facts of pages --------------------------------------------------------------------------------

#: Patterns in the order in which they are asked.
RATING_PATTERNS = {
    "value": r'"ratingValue":\s*"?([0-9.]+)"?', "count": r'"reviewCount":\s*"?([0-9]+)"?', "rated": r"Recipe rated ([0-9.]+) stars?\. ([0-9]+) rating",
    "data": r'data-rating="([0-9.]+)"', "rating": r"rating[\"']:\s*([0-9.]+)", "stars": r"stars[\"']:\s*([0-9.]+)",
}
COUNT_PATTERNS = (r"([0-9]+)\s+reviews?", r"([0-9]+)\s+ratings?", r'"reviewCount":\s*"?([0-9]+)"?')
CUISINE_PATTERNS = (r'"recipeCuisine":\s*"([^"]+)"', r"cuisine[\"']:\s*[\"']([^\"']+)[\"']", r'data-cuisine="([^"]+)"', r'<span[^>]*class="[^"]*cuisine[^"]*"[^>]*>([^<]+)</span>', r"Cuisine:\s*([^\n<]+)", r"Category:\s*([^\n<]+)")
CUISINE_WORDS = {
    "italian": ("italian", "pasta", "pizza", "risotto", "parmesan"), "mexican": ("mexican", "taco", "burrito", "salsa", "chipotle", "jalapeño"), "chinese": ("chinese", "wok", "soy sauce", "ginger", "sesame"),
    "indian": ("indian", "curry", "turmeric", "cumin", "garam masala"), "french": ("french", "baguette", "croissant", "brie", "provence"), "thai": ("thai", "pad thai", "coconut milk", "lemongrass", "fish sauce"),
    "japanese": ("japanese", "sushi", "miso", "wasabi", "sake"), "greek": ("greek", "feta", "olive oil", "oregano", "gyro"), "american": ("american", "bbq", "hamburger", "hot dog", "apple pie"),
}
DIFFICULTY_PATTERNS = (r'"difficulty":\s*"([^"]+)"', r'"recipeDifficulty":\s*"([^"]+)"', r"difficulty[\"']:\s*[\"']([^\"']+)[\"']", r'data-difficulty="([^"]+)"', r'<span[^>]*class="[^"]*difficulty[^"]*"[^>]*>([^<]+)</span>', r"Difficulty:\s*([^\n<]+)", r"Level:\s*([^\n<]+)")
DIFFICULTY_NAMES = {"easy": ("easy", "beginner", "simple", "basic"), "medium": ("medium", "intermediate", "moderate"), "hard": ("hard", "difficult", "advanced", "expert", "challenging")}
DIFFICULTY_SIGNS = {
    "easy": ("quick", "easy", "15 min", "20 min", "simple", "no-bake", "microwave"), "medium": ("medium", "moderate", "30 min", "45 min", "intermediate"),
    "hard": ("advanced", "difficult", "complex", "2 hour", "3 hour", "challenging"),
}


def _first(html: Column, pattern: str, group: int = 1, any_case: bool = False) -> Column:
    """The group of the pattern's first match, null without one."""
    return F.nullif(F.regexp_extract(html, ("(?iU)" if any_case else "(?U)") + pattern, group), F.lit(""))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _holds(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _once(values: dict[str, Column], told) -> Column:
    """told(struct of values), where each value, however often it is used, is worked out once."""
    return F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), told)[0]


def _first_set(values: list[Column] | Column) -> Column:
    """The first that isn't null."""
    return F.get(F.array_compact(F.array(*values) if isinstance(values, list) else values), F.lit(0))


def page_rating(html: Column) -> Column:
    """Struct of rating and review_count, null where a page tells none.

    A sentence with both wins; else the last of the patterns that is there decides, and a count may stand beside it, or in words,
    if the rating isn't 0. A rating that isn't a number (two points) spoils the page, as it stops whoever reads in order.
    """
    raw = {k: _first(html, p) for k, p in RATING_PATTERNS.items()}
    raw["rated_count"] = _first(html, RATING_PATTERNS["rated"], 2)
    raw["words"] = _first_set([_first(html, p, any_case=True) for p in COUNT_PATTERNS])

    def told(r):
        number = lambda k: r[k].try_cast("double")
        bad = lambda k: r[k].isNotNull() & number(k).isNull()
        plain = F.when(~(bad("data") | bad("rating") | bad("stars")), F.coalesce(number("stars"), number("rating"), number("data"), number("value")))
        rating = F.when(~(bad("value") | bad("rated")), F.coalesce(number("rated"), plain))
        return F.struct(rating.alias("rating"), F.coalesce(r["rated_count"], r["count"]).try_cast("long").alias("beside"), r["words"].try_cast("long").alias("words"))

    def counted(r):
        count = F.coalesce(F.when((r["rating"] != 0) & (F.coalesce(r["beside"], F.lit(0)) == 0), r["words"]), r["beside"], F.lit(0))
        return F.when(r["rating"].isNotNull(), F.struct(r["rating"].alias("rating"), count.alias("review_count")))

    return F.transform(F.array(_once(raw, told)), counted)[0]


def page_cuisine(html: Column) -> Column:
    """What the first pattern with a usable name (3 to 49 characters, punctuation dropped) tells, else the first cuisine one of
    whose words is anywhere on the page, else null."""
    found = F.transform(F.array(*(_first(html, p, any_case=True) for p in CUISINE_PATTERNS)), lambda x: F.regexp_replace(_strip(x), r"(?U)[^\p{L}\p{N}_\s-]", ""))
    usable = F.filter(found, lambda x: F.length(x).between(3, 49))
    by_word = _once({"low": F.lower(html)}, lambda r: _first_set([F.when(_holds(r["low"], words), F.lit(name)) for name, words in CUISINE_WORDS.items()]))
    return F.when(html != "", F.coalesce(F.get(usable, F.lit(0)), by_word))


def page_difficulty(html: Column) -> Column:
    """What the first pattern with a usable value tells: easy, medium or hard by its words, else the value itself if it is short;
    without one, which signs on the page are most (medium where there are signs of it and no other has more than all), else null."""

    def named(x):
        return F.coalesce(*(F.when(_holds(x, words), F.lit(name)) for name, words in DIFFICULTY_NAMES.items()), F.when(F.length(x).between(1, 19), x))

    def most(n):
        return F.when((n["easy"] > n["medium"]) & (n["easy"] > n["hard"]), "easy").when((n["hard"] > n["easy"]) & (n["hard"] > n["medium"]), "hard").when(n["medium"] > 0, "medium")

    count = lambda low, words: F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))
    signs = _once({"low": F.lower(html)}, lambda r: F.struct(*(count(r["low"], words).alias(k) for k, words in DIFFICULTY_SIGNS.items())))
    found = F.transform(F.array(*(_first(html, p, any_case=True) for p in DIFFICULTY_PATTERNS)), lambda x: named(F.lower(_strip(x))))
    return F.when(html != "", F.coalesce(_first_set(found), F.transform(F.array(signs), most)[0]))


def page_facts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages with rating, review_count, cuisine, difficulty and their buckets, each read from the html by rules in order."""
    rows = pages.withColumns({"__r": page_rating(F.col(html_col)), "cuisine": page_cuisine(F.col(html_col)), "difficulty": page_difficulty(F.col(html_col))})
    key = F.lower(F.coalesce("cuisine", F.lit("other")))
    cuisine = F.when(key.isin(*CUISINE_QUOTAS), key).otherwise("other")
    rating = F.col("__r.rating")
    return rows.withColumns({
        "rating": rating, "review_count": F.col("__r.review_count"), "cuisine_bucket": cuisine, "rating_bucket": F.when(rating.isNotNull(), rating_bucket(rating)), "difficulty_bucket": difficulty_bucket(F.col("difficulty")),
    }).drop("__r")


def select_pages(pages: DataFrame, seq: str, target: int = 4000, quotas: dict[str, dict[str, int]] | None = None, html_col: str = "html") -> DataFrame:
    """The pages that a crawl keeps, in order of seq: rated more than once, and of a cuisine, rating or difficulty that is
    still asked for. A difficulty outside the buckets counts as unknown."""
    rated = page_facts(pages, html_col).filter(F.col("review_count") > 1)
    return quota_sample(rated, quotas or RECIPE_QUOTAS, seq, target)


def round_robin(frontier: DataFrame, source: str = "source", seq: str = "seq") -> DataFrame:
    """Tasks in turn: each source's first, then each source's second, and so on. A turn is a row's number in the order of
    (source, seq), found by ranges, less its source's first: a source of any size is in many tasks."""
    rows = numbered(frontier, [source, seq], "__at")
    first = rows.groupBy(F.col(source).alias("__source")).agg(F.min("__at").alias("__first"))
    met = rows.join(first, F.col(source).eqNullSafe(F.col("__source"))).withColumn("turn", (F.col("__at") - F.col("__first") + 1).cast("int"))
    return met.select(*frontier.columns, "turn").orderBy("turn", source)


def frontier_stats(frontier: DataFrame, source: str = "source") -> DataFrame:
    return frontier.groupBy(source).agg(F.count(F.lit(1)).alias("queued"))


def rating_bucket(rating: Column) -> Column:
    return F.when(rating >= 4.5, "excellent").when(rating >= 4.0, "very_good").when(rating >= 3.5, "good").when(rating >= 3.0, "average").otherwise("below_average")


def difficulty_bucket(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(low.isin("easy", "simple", "beginner", "basic"), "easy").when(low.isin("medium", "intermediate", "moderate"), "medium")
        .when(low.isin("hard", "difficult", "advanced", "expert", "challenging"), "hard").otherwise("unknown")
    )
