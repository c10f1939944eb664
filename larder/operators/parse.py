"""Recipe pages to recipe rows: JSON-LD first, HTML patterns for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import iso_minutes, split_keywords
from .crawl import canonical_link, canonical_url, document_id
from .dom import page_elements

#: Names that count as cuisines, tags that count as categories, image URL rules.
CUISINES = (
    "american", "canadian", "mexican", "tex mex", "cajun", "creole", "southwestern u.s.", "native american",
    "south american", "latin", "caribbean", "european", "italian", "french", "spanish", "greek", "german",
    "portuguese", "british", "irish", "scandinavian", "polish", "asian", "chinese", "japanese", "korean",
    "thai", "vietnamese", "indian", "filipino", "indonesian", "malaysian", "singaporean", "mediterranean",
    "moroccan", "ethiopian", "african", "middle eastern", "lebanese", "turkish", "persian", "australian",
    "new zealand", "hawaiian", "jewish", "kosher", "halal",
)
CATEGORIES = (
    "breakfast", "brunch", "lunch", "lunch/snacks", "dinner", "dessert", "appetizers", "beverages", "snacks",
    "side dishes", "vegan", "vegetarian", "kosher", "halal", "gluten-free", "dairy-free", "egg free",
    "lactose free", "no shell fish", "low cholesterol", "low protein", "high protein", "high fiber",
    "very low carbs", "healthy", "free of...", "beginner cook", "easy", "intermediate", "advanced",
    "christmas", "thanksgiving", "halloween", "easter", "birthday", "summer", "winter", "fall", "spring",
    "weeknight", "potluck", "for large groups", "kid friendly",
)
NOT_IMAGES = (
    "logo", "favicon", "icon", "brand", "avatar", "profile", "sharegraphic", "header", "footer", "navigation",
    "nav", "banner", "static", "gk-static",
)
IMAGES = ("img/recipes/", "img/feed/", "recipe", "food", "dish", "cooking", "kitchen", "meal", "cuisine")
SIZED = ("ar_5:4", "ar_3:2", "c_thumb", "q_55", "f_auto", "w_744", "w_860")
NUTRIENTS = {"calories": "calories", "fat": "fatContent", "saturated_fat": "saturatedFatContent", "cholesterol": "cholesterolContent", "sodium": "sodiumContent", "carbohydrates": "carbohydrateContent", "fiber": "fiberContent", "sugar": "sugarContent", "protein": "proteinContent"}


def json_ld(html: Column, lenient: bool = False) -> Column:
    """The first JSON-LD block that is a recipe (type Recipe in the context http://schema.org, as
    written; lenient takes https and a type list too), as VARIANT, else null."""
    raw = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    plain = F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^<!--", ""), r"-->$", ""))
    text = lambda x, path: F.get_json_object(x, path)
    if lenient:
        is_recipe = lambda x: F.coalesce(text(x, "$['@type']"), F.lit("")).contains("Recipe") & F.coalesce(text(x, "$['@context']"), F.lit("")).contains("schema.org")
    else:
        is_recipe = lambda x: (text(x, "$['@type']") == "Recipe") & (text(x, "$['@context']") == "http://schema.org")
    found = F.filter(plain, lambda x: F.coalesce(is_recipe(x), F.lit(False)))
    return F.try_parse_json(F.get(found, F.lit(0)))


def _text(v, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _texts(v, path: str) -> Column:
    return F.try_variant_get(v, path, "array<string>")


def keyword_values(keywords: Column, known: list[str]) -> Column:
    return F.filter(split_keywords(keywords), lambda k: F.lower(k).isin(*known))


def title_case(text: Column) -> Column:
    """The first letter of each run of letters as a capital, the rest small."""
    parts = F.regexp_extract_all(text, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, F.initcap), "")


def is_recipe_image(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    any_of = lambda words: low.rlike("|".join(w.replace(".", r"\.") for w in words))
    host = low.contains("img.sndimg.com") & (low.contains("recipe-default-images") | any_of(SIZED))
    return F.when((low == "") | any_of(NOT_IMAGES), F.lit(False)).otherwise(any_of(IMAGES) | host | low.contains("food.com"))


def base_image_url(url: Column) -> Column:
    cdn = F.concat(F.regexp_extract(url, r"(/food/image/upload/)[^/]+(/v\d+/.*\.jpg)", 1), F.regexp_extract(url, r"(/food/image/upload/)[^/]+(/v\d+/.*\.jpg)", 2))
    other = F.regexp_replace(F.regexp_replace(url, r"[?&](w_\d+|ar_\d+:\d+|c_thumb|q_\d+|f_auto)", ""), r"[,&]+$", "")
    return F.when(url.contains("img.sndimg.com") & (cdn != ""), cdn).otherwise(other)


def distinct_images(urls: Column) -> Column:
    """Recipe images, the first of each base URL."""

    def step(out, u):
        return F.when(F.exists(out, lambda y: base_image_url(y) == base_image_url(u)), out).otherwise(F.array_append(out, u))

    return F.aggregate(F.filter(urls, is_recipe_image), F.array().cast("array<string>"), step)


def difficulty(keywords: Column) -> Column:
    low = F.lower(F.coalesce(keywords, F.lit("")))
    return F.when(low.contains("easy"), "easy").when(low.contains("intermediate") | low.contains("medium"), "intermediate").when(low.rlike("hard|difficult|advanced"), "hard").otherwise("")


#: Where a page's script tells its URL, in the order in which they are asked.
URLS = (r'"url"\s*:\s*"(https://www\.food\.com/recipe/[^"]*)"', r"""canonicalUrl["']?\s*:\s*["']([^"']*)["']""", r"""currentUrl["']?\s*:\s*["']([^"']*)["']""")


def script_url(html: Column) -> Column:
    """The recipe's URL in the page's script: the first pattern whose first match is one; null without any."""
    found = F.transform(F.array(*(F.regexp_extract(html, "(?iU)" + p, 1) for p in URLS)), lambda u: F.trim(u))
    return F.get(F.filter(found, lambda u: u.contains("food.com") & u.contains("/recipe/")), F.lit(0))


#: What both ways of reading a page tell, and what only its elements and patterns do.
JSON_LD_COLUMNS = (
    "recipe_id", "canonical", "title", "description", "ingredients", "instructions", "times", "cuisine", "category", "yield", "author",
    "keywords", "date_published", "image", "all_images", "difficulty", "nutrition", "ratings", "parser",
)
HTML_COLUMNS = (*JSON_LD_COLUMNS, "tools", "serving_size", "author_bio", "author_location", "author_stats", "daily_values")


def _with_json_ld(pages: DataFrame, html_col: str, lenient: bool) -> DataFrame:
    """pages with `__v`, the page's JSON-LD. As an exploded column of one value it's computed once a page: a filter on what comes
    from it stays above, where a plain column's expression would be copied into the filter for each use."""
    return pages.select("*", F.explode(F.array(json_ld(F.col(html_col), lenient))).alias("__v"))


def _json_ld_columns(url_col: str, html_col: str) -> dict[str, Column]:
    """A recipe's columns from `__v`."""
    v = F.col("__v")
    s = lambda path: F.coalesce(_text(v, path), F.lit(""))
    minutes = lambda path: iso_minutes(s(path))
    prep, cook, total = minutes("$.prepTime"), minutes("$.cookTime"), minutes("$.totalTime")
    steps = F.coalesce(F.filter(F.transform(F.try_variant_get(v, "$.recipeInstructions", "array<variant>"), lambda x: F.trim(F.coalesce(F.try_variant_get(x, "$.text", "string"), F.try_variant_get(x, "$", "string"), F.lit("")))), lambda x: x != ""), F.array().cast("array<string>"))
    author = F.coalesce(_text(v, "$.author.name"), F.when(F.schema_of_variant(F.try_variant_get(v, "$.author", "variant")) == "STRING", _text(v, "$.author")), F.lit(""))
    images = F.coalesce(_texts(v, "$.image"), F.when(s("$.image") != "", F.array(s("$.image"))), F.array().cast("array<string>"))
    named = F.when(F.schema_of_variant(F.try_variant_get(v, "$.mainEntityOfPage", "variant")) == "STRING", F.nullif(_text(v, "$.mainEntityOfPage"), F.lit("true")))
    url = F.coalesce(F.nullif(_text(v, "$.url"), F.lit("")), _text(v, "$.mainEntityOfPage.url"), named, script_url(F.col(html_col)), F.col(url_col))
    keywords = s("$.keywords")
    category = F.array_distinct(F.concat(F.when(F.trim(s("$.recipeCategory")) != "", F.array(F.trim(s("$.recipeCategory")))).otherwise(F.array().cast("array<string>")), keyword_values(keywords, CATEGORIES)))
    nutrition = F.when(F.try_variant_get(v, "$.nutrition", "variant").isNotNull(), F.struct(*(_text(v, f"$.nutrition.{n}").alias(k) for k, n in NUTRIENTS.items())))
    ratings = F.when(F.try_variant_get(v, "$.aggregateRating", "variant").isNotNull(), F.struct(_text(v, "$.aggregateRating.ratingValue").alias("rating"), _text(v, "$.aggregateRating.reviewCount").alias("review_count")))
    cols = (
        document_id(F.col(url_col)).alias("recipe_id"), url.alias("canonical"), s("$.name").alias("title"), s("$.description").alias("description"),
        F.coalesce(F.filter(F.transform(_texts(v, "$.recipeIngredient"), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>")).alias("ingredients"), steps.alias("instructions"),
        F.struct(prep.alias("prep"), cook.alias("cook"), F.when(total == 0, prep + cook).otherwise(total).alias("total")).alias("times"),
        F.transform(keyword_values(keywords, CUISINES), title_case).alias("cuisine"), category.alias("category"), s("$.recipeYield").alias("yield"), author.alias("author"),
        split_keywords(keywords).alias("keywords"), s("$.datePublished").alias("date_published"), F.coalesce(F.get(images, F.lit(0)), F.lit("")).alias("image"), distinct_images(images).alias("all_images"),
        difficulty(keywords).alias("difficulty"), nutrition.alias("nutrition"), ratings.alias("ratings"), F.when(v.isNotNull(), "json-ld").alias("parser"),
    )
    return dict(zip(JSON_LD_COLUMNS, cols, strict=True))


def parse_json_ld(pages: DataFrame, url_col: str = "url", html_col: str = "html", lenient: bool = False) -> DataFrame:
    """pages with the columns of a recipe taken from JSON-LD; title is empty where there is none."""
    cols = _json_ld_columns(url_col, html_col)
    return _with_json_ld(pages, html_col, lenient).select(*pages.columns, *(c.alias(n) for n, c in cols.items()))


def clean(html: Column) -> Column:
    """Text of an HTML stretch: tags out, the five named references and white space folded."""
    out = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def html_title(html: Column) -> Column:
    """The first of h1, og:title and title that has more than three characters."""
    heads = [clean(F.regexp_extract(html, p, 1)) for p in (r"(?is)<h1\b[^>]*>(.*?)</h1>", r"""(?is)<meta[^>]*property=["']og:title["'][^>]*content=["']([^"']*)""", r"(?is)<title\b[^>]*>(.*?)</title>")]
    return F.coalesce(*(F.when(F.length(h) > 3, h) for h in heads), F.lit(""))


def _near(plain: Column, what: str) -> Column:
    """What follows a label such as 'Prep Time:' in a page's lower-cased text."""
    return F.regexp_extract(plain, rf"{what}(?:\s*time)?\s*(?:in)?\s*:?\s*((?:\d+\s*(?:hours?|hrs?|h|minutes?|mins?|m)\b\s*)+)", 1)


def _minutes(near: Column) -> Column:
    n = lambda unit: F.coalesce(F.regexp_extract(near, rf"(\d+)\s*(?:{unit})\b", 1).try_cast("int"), F.lit(0))
    return n("hours?|hrs?|h") * 60 + n("minutes?|mins?|m")


def html_minutes(html: Column, what: str) -> Column:
    """Minutes after a label such as 'Prep Time: 1 hr 20 min'."""
    return _minutes(_near(F.lower(clean(html)), what))


#: Categories that a page's crumbs and keywords may tell; tools; words of a difficulty; patterns, in the order in which
#: they are asked.
HTML_CATEGORIES = (
    "breakfast", "brunch", "lunch", "lunch/snacks", "dinner", "dessert", "appetizers", "beverages", "snacks", "side dishes",
    "vegan", "vegetarian", "kosher", "halal", "gluten-free", "dairy-free", "egg free", "lactose free", "no shell fish", "low cholesterol",
    "low protein", "high protein", "high fiber", "very low carbs", "healthy", "free of...",
)
TOOLS = ("oven", "stove", "pan", "pot", "skillet", "grill", "microwave", "blender", "mixer", "food processor", "knife", "cutting board", "baking sheet", "casserole dish", "slow cooker", "pressure cooker")
DIFFICULTIES = {"easy": ("easy", "simple", "quick", "basic", "beginner"), "intermediate": ("intermediate", "medium", "moderate"), "hard": ("hard", "difficult", "advanced", "complex", "challenging")}
YIELDS = (r"serves?\s*(\d+)", r"yield[s]?\s*(\d+)", r"makes?\s*(\d+)", r"(\d+)\s*serving[s]?", r"(\d+)\s*portion[s]?")
AUTHORS = (r"submitted\s+by\s+([^,\n]+)", r"by\s+([^,\n]+)", r"author[:\s]+([^,\n]+)")
DATES = (r"""datePublished["']?\s*:\s*["']([^"']*)["']""", r"""OrigPubDate["']?\s*:\s*["']([^"']*)["']""")
SERVINGS = (r"""servingSize["']?\s*:\s*["']([^"']*)["']""", r"serving\s*size[:\s]*([^<\n]+)", r"per\s*serving[:\s]*([^<\n]+)")
BIOS = (r"""bio["']?\s*:\s*["']([^"']*)["']""", r"""biography["']?\s*:\s*["']([^"']*)["']""")
PLACES = (r"""location["']?\s*:\s*["']([^"']*)["']""", r"""address["']?\s*:\s*["']([^"']*)["']""")
DAILY_VALUES = {
    "serving_size": "servingSize", "calories_from_fat": "caloriesFromFat", "calories_from_fat_pct": "caloriesFromFatPctDailyValue", "total_fat_pct": "totalFatPctDailyValue",
    "saturated_fat_pct": "saturatedFatPctDailyValue", "cholesterol_pct": "cholesterolPctDailyValue", "sodium_pct": "sodiumPctDailyValue", "carbohydrate_pct": "totalCarbohydratePctDailyValue",
    "fiber_pct": "dietaryFiberPctDailyValue", "sugar_pct": "sugarsPctDailyValue", "protein_pct": "proteinPctDailyValue",
}


def _asked(html: Column, patterns) -> Column:
    """The group of the first pattern that the page has, in any case, stripped; empty without one."""
    tries = [F.when(html.rlike("(?iU)" + p), F.regexp_extract(html, "(?iU)" + p, 1)) for p in patterns]
    return F.regexp_replace(F.coalesce(*tries, F.lit("")), r"(?U)^\s+|\s+$", "")


#: The label of a time, as a pattern.
TIMES = {"prep": "prep", "cook": "cook", "total": "(?:total|ready)"}


def _with_elements(pages: DataFrame, html: Column) -> DataFrame:
    """pages with what several columns of a page's facts come from, each computed once: source, elements, text, link, times."""
    rows = pages.withColumn("__h", html).withColumn("__e", page_elements(F.col("__h"))).withColumns({"__low": F.lower("__h"), "__text": clean(F.col("__h")), "__link": canonical_link(F.col("__h"))})
    return rows.withColumn("__plain", F.lower("__text")).withColumns({"__served": _asked(F.col("__low"), YIELDS), **{f"__{k}": _near(F.col("__plain"), p) for k, p in TIMES.items()}})


def _html_columns(url_col: str) -> dict[str, Column]:
    """A recipe's columns from those of _with_elements."""
    h, low, link = F.col("__h"), F.col("__low"), F.col("__link")
    none = F.array().cast("array<string>")
    e = lambda name: F.col(f"__e.{name}")
    texts = lambda name: F.coalesce(e(name), none)
    meta = lambda name: F.trim(F.coalesce(e("metas")[name], F.lit("")))
    told = F.when(F.map_contains_key(e("metas"), F.lit("keywords")), e("metas")["keywords"])
    keywords = split_keywords(F.coalesce(told, F.lit("")))
    listed = F.when(told.isNotNull(), keywords).otherwise(split_keywords(_asked(h, (r"""keywords["']?\s*:\s*["']([^"']*)["']""",))))
    crumbs = F.transform(texts("crumbs"), lambda x: F.lower(x))
    places = F.filter(F.array(*map(F.lit, CUISINES)), lambda c: F.exists(crumbs, lambda t: F.contains(t, c)))
    cuisine = F.array_distinct(F.concat(F.transform(F.filter(keywords, lambda k: F.lower(k).isin(*CUISINES)), title_case), F.transform(places, title_case)))
    linked = F.filter(texts("crumb_links"), lambda t: (F.length(t) > 2) & F.lower(t).isin(*HTML_CATEGORIES))
    category = F.concat(linked, F.filter(F.array_distinct(F.filter(keywords, lambda k: F.lower(k).isin(*HTML_CATEGORIES))), lambda k: ~F.array_contains(linked, k)))
    tools = F.array_distinct(F.flatten(F.transform(texts("instructions"), lambda i: F.filter(F.array(*map(F.lit, TOOLS)), lambda t: F.contains(F.lower(i), t)))))
    prep, cook, total = (_minutes(F.col(f"__{k}")) for k in TIMES)
    good = lambda urls: F.filter(urls, lambda u: is_recipe_image(u))
    og = F.when(F.map_contains_key(e("metas"), F.lit("og:image")), F.array(meta("og:image"))).otherwise(none)
    lead = good(F.slice(texts("primary"), 1, 1))
    own = F.array_distinct(F.concat(lead, good(texts("other"))))
    pictures = F.when(F.size(own) > 0, own).otherwise(F.array_distinct(F.concat(good(og), good(texts("every")))))
    image = F.coalesce(F.get(F.concat(lead, good(texts("media")), good(og), good(texts("every"))), F.lit(0)), F.lit(""))
    hard = F.lit("")
    for level, words in reversed(DIFFICULTIES.items()):
        hard = F.when(low.rlike("|".join(words)), F.lit(level)).otherwise(hard)
    served = F.when(F.col("__served") != "", F.col("__served")).otherwise(F.regexp_extract("__text", r"(?i)(?:serves|servings|yields?|makes)\s*:?\s*(\d+(?:\s*-\s*\d+)?)", 1))
    value = lambda name: rf"""{name}["']?\s*:\s*["']([^"']*)["']"""
    daily = F.map_filter(F.create_map(*(x for k, name in DAILY_VALUES.items() for x in (F.lit(k), F.when(h.rlike("(?i)" + value(name)), _asked(h, (value(name),)))))), lambda k, v: v.isNotNull())
    number = lambda name: F.nullif(F.regexp_extract(h, rf"""(?i){name}["']?\s*:\s*(\d+)""", 1), F.lit("")).cast("long")
    bio = F.regexp_replace(F.regexp_replace(_asked(h, BIOS), r"<[^>]+>", ""), r"&[^;]+;", " ")
    date = F.when(F.map_contains_key(e("metas"), F.lit("datePublished")), meta("datePublished")).otherwise(_asked(h, DATES))
    description = F.when(F.map_contains_key(e("metas"), F.lit("description")), meta("description")).otherwise(meta("og:description"))
    cols = (
        document_id(F.col(url_col)).alias("recipe_id"), F.when(canonical_url(F.lit(""), h, link) != "", canonical_url(F.col(url_col), h, link)).otherwise(F.coalesce(script_url(h), F.col(url_col))).alias("canonical"), F.coalesce(e("title"), F.lit("")).alias("title"), description.alias("description"),
        texts("ingredients").alias("ingredients"), texts("instructions").alias("instructions"),
        F.struct(prep.cast("int").alias("prep"), cook.cast("int").alias("cook"), F.when(total == 0, prep + cook).otherwise(total).cast("int").alias("total")).alias("times"),
        cuisine.alias("cuisine"), category.alias("category"), served.alias("yield"), _asked(low, AUTHORS).alias("author"),
        listed.alias("keywords"), date.alias("date_published"), image.alias("image"), pictures.alias("all_images"), hard.alias("difficulty"),
        F.when(F.size(e("nutrition")) > 0, F.struct(*(e("nutrition")[k].alias(k) for k in NUTRIENTS))).alias("nutrition"),
        F.when(e("rating").isNotNull() | e("reviews").isNotNull(), F.struct(e("rating").alias("rating"), e("reviews").alias("review_count"))).alias("ratings"), F.lit("html").alias("parser"),
        tools.alias("tools"), _asked(h, SERVINGS).alias("serving_size"), bio.alias("author_bio"), _asked(h, PLACES).alias("author_location"),
        F.struct(number("recipesCount").alias("recipes"), number("followMeCount").alias("followers")).alias("author_stats"), daily.alias("daily_values"),
    )
    return dict(zip(HTML_COLUMNS, cols, strict=True))


def parse_html(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The same columns, and tools, serving_size, author_bio, author_location, author_stats, daily_values, from the page's
    elements (dom.read_page, one pass a page) and from patterns over its source."""
    cols = _html_columns(url_col)
    return _with_elements(pages, F.col(html_col)).select(*pages.columns, *(c.alias(n) for n, c in cols.items()))


def parse_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html", lenient: bool = False) -> DataFrame:
    """JSON-LD where it has a title and ingredients, else HTML patterns; rows without a title are left out. Pages are read
    once, and elements only where JSON-LD doesn't do."""
    told, seen = _json_ld_columns(url_col, html_col), _html_columns(url_col)
    ok = (told["title"] != "") & (F.size(told["ingredients"]) > 0)
    first = _with_json_ld(pages, html_col, lenient).withColumn("__ok", ok)
    rows = _with_elements(first, F.when(~F.col("__ok"), F.col(html_col)))
    either = [(F.when(F.col("__ok"), told[n]).otherwise(c) if n in told else F.when(~F.col("__ok"), c)).alias(n) for n, c in seen.items()]
    return rows.select(*pages.columns, *either).filter("title <> ''")


def ingredient_links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Distinct (ingredient_id, slug, name) of links to /about/<slug>-<id>."""
    pattern = r"""(?is)<a\b[^>]*href=["'][^"']*/about/([^"'/?#]+)-(\d+)[^"']*["'][^>]*>([^<]+)</a>"""
    group = lambda i: F.regexp_extract_all(html_col, F.lit(pattern), F.lit(i))
    rows = pages.select(F.explode(F.arrays_zip(group(2).alias("i"), group(1).alias("s"), group(3).alias("n"))).alias("x"))
    return rows.select(F.col("x.i").alias("ingredient_id"), F.col("x.s").alias("slug"), F.trim(F.lower("x.n")).alias("name")).filter("length(name) > 1").distinct()


def page_links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, n, href) of all links, in page order."""
    hrefs = F.regexp_extract_all(html_col, F.lit(r"""<a\b[^>]*href="([^"]*)\""""), F.lit(1))
    return pages.select(id_col, F.posexplode(hrefs).alias("n", "href"))
