"""Queries of what a crawl keeps: facts read from pages, quotas over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import crawl
from .registry import query, table

#: What is put behind a page's html, by its id: marks in each way that a page may tell a fact.
MARKS = (
    '{"ratingValue": "4.7", "reviewCount": 12, "recipeCuisine": "Italian", "difficulty": "Easy peasy"}',
    "Recipe rated 3.9 stars. 7 rating <p>Cuisine: Thai food!</p><b>Level: Expert</b>",
    '<i data-rating="3.2"></i> 25 Reviews <span class="x cuisine-tag">Greek</span> data-difficulty="so so"',
    "'rating': 4.1 and 9 ratings; takes 45 min, salsa",
    '{"ratingValue": 4.0.1} "reviewCount": "88" Category: Stew',
    "'stars': 2.5 'rating': 5 3 reviews <span class='difficulty'>no</span> Difficulty: Moderate\nwok",
    "",
    '"ratingValue": "0" "reviewCount": 0 4 reviews cuisine": "x" Cuisine: Cajun quick and simple',
    '"ratingValue": 4.6 "reviewCount": 1 20 min',
    '"ratingValue": 3.1 "reviewCount": 40 recipeDifficulty "recipeDifficulty": "Intermediate level" curry',
    'Recipe rated 4.5 star. 0 rating 14 reviews Cuisine: MEXICAN, really',
)
_HTML = "html || [" + ", ".join("'" + m.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for m in MARKS) + f"][1 + page_id % {len(MARKS)}]"
_X = "nullif(regexp_extract(h, '{}', {}), '')"


def _x(pattern: str, group: int = 1) -> str:
    return _X.format(pattern.replace("'", "''"), group)


def _cuisine_sql() -> str:
    tried = [f"trim(regexp_replace(trim({_x('(?i)' + p)}), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g'))" for p in ('"recipeCuisine":\\s*"([^"]+)"', "cuisine[\"']:\\s*[\"']([^\"']+)[\"']", 'data-cuisine="([^"]+)"', '<span[^>]*class="[^"]*cuisine[^"]*"[^>]*>([^<]+)</span>', "Cuisine:\\s*([^\\n<]+)", "Category:\\s*([^\\n<]+)")]
    usable = ", ".join(f"CASE WHEN length({t}) BETWEEN 3 AND 49 THEN {t} END" for t in tried)
    word = " ".join(
        f"WHEN regexp_matches(lower(h), '{words}') THEN '{name}'"
        for name, words in (
            ("italian", "italian|pasta|pizza|risotto|parmesan"), ("mexican", "mexican|taco|burrito|salsa|chipotle|jalapeño"), ("chinese", "chinese|wok|soy sauce|ginger|sesame"), ("indian", "indian|curry|turmeric|cumin|garam masala"),
            ("french", "french|baguette|croissant|brie|provence"), ("thai", "thai|coconut milk|lemongrass|fish sauce"), ("japanese", "japanese|sushi|miso|wasabi|sake"), ("greek", "greek|feta|olive oil|oregano|gyro"), ("american", "american|bbq|hamburger|hot dog|apple pie"),
        )
    )
    return f"coalesce({usable}, CASE {word} END)"


def _difficulty_sql() -> str:
    tried = [f"lower(trim({_x('(?i)' + p)}))" for p in ('"difficulty":\\s*"([^"]+)"', '"recipeDifficulty":\\s*"([^"]+)"', "difficulty[\"']:\\s*[\"']([^\"']+)[\"']", 'data-difficulty="([^"]+)"', '<span[^>]*class="[^"]*difficulty[^"]*"[^>]*>([^<]+)</span>', "Difficulty:\\s*([^\\n<]+)", "Level:\\s*([^\\n<]+)")]
    named = ", ".join(f"CASE WHEN regexp_matches({t}, 'easy|beginner|simple|basic') THEN 'easy' WHEN regexp_matches({t}, 'medium|intermediate|moderate') THEN 'medium' WHEN regexp_matches({t}, 'hard|difficult|advanced|expert|challenging') THEN 'hard' WHEN length({t}) BETWEEN 1 AND 19 THEN {t} END" for t in tried)
    signs = lambda words: " + ".join(f"contains(lower(h), '{w}')::INT" for w in words)
    e, m, d = signs(("quick", "easy", "15 min", "20 min", "simple", "no-bake", "microwave")), signs(("medium", "moderate", "30 min", "45 min", "intermediate")), signs(("advanced", "difficult", "complex", "2 hour", "3 hour", "challenging"))
    return f"coalesce({named}, CASE WHEN ({e}) > ({m}) AND ({e}) > ({d}) THEN 'easy' WHEN ({d}) > ({e}) AND ({d}) > ({m}) THEN 'hard' WHEN ({m}) > 0 THEN 'medium' END)"


_NUMBER = "try_cast({} AS DOUBLE)"
_FACTS = f"""WITH p AS MATERIALIZED (SELECT page_id, {_HTML} AS h FROM pages),
a AS (SELECT page_id, h, {_x('"ratingValue":\\s*"?([0-9.]+)"?')} AS v, {_x('"reviewCount":\\s*"?([0-9]+)"?')} AS n, {_x('Recipe rated ([0-9.]+) stars?\\. ([0-9]+) rating')} AS r, {_x('Recipe rated ([0-9.]+) stars?\\. ([0-9]+) rating', 2)} AS rn, {_x('data-rating="([0-9.]+)"')} AS d, {_x("rating[\"']:\\s*([0-9.]+)")} AS t, {_x("stars[\"']:\\s*([0-9.]+)")} AS s,
  coalesce({_x('(?i)([0-9]+)\\s+reviews?')}, {_x('(?i)([0-9]+)\\s+ratings?')}, {_x('(?i)"reviewCount":\\s*"?([0-9]+)"?')}) AS w, {_cuisine_sql()} AS cuisine, {_difficulty_sql()} AS difficulty FROM p),
b AS (SELECT *, CASE WHEN v IS NOT NULL AND {_NUMBER.format('v')} IS NULL THEN NULL WHEN r IS NOT NULL THEN {_NUMBER.format('r')} WHEN (d IS NOT NULL AND {_NUMBER.format('d')} IS NULL) OR (t IS NOT NULL AND {_NUMBER.format('t')} IS NULL) OR (s IS NOT NULL AND {_NUMBER.format('s')} IS NULL) THEN NULL
  ELSE coalesce({', '.join(_NUMBER.format(c) for c in 'stdv')}) END AS rating, coalesce(rn, n)::BIGINT AS beside FROM a),
f AS (SELECT page_id, rating, CASE WHEN rating IS NOT NULL THEN CASE WHEN rating <> 0 AND coalesce(beside, 0) = 0 THEN coalesce(w::BIGINT, beside, 0) ELSE coalesce(beside, 0) END END AS review_count, cuisine, difficulty,
  CASE WHEN lower(coalesce(cuisine, 'other')) IN ({', '.join(f"'{c}'" for c in crawl.CUISINE_QUOTAS)}) THEN lower(coalesce(cuisine, 'other')) ELSE 'other' END AS cuisine_bucket,
  CASE WHEN rating >= 4.5 THEN 'excellent' WHEN rating >= 4.0 THEN 'very_good' WHEN rating >= 3.5 THEN 'good' WHEN rating >= 3.0 THEN 'average' WHEN rating IS NOT NULL THEN 'below_average' END AS rating_bucket,
  CASE WHEN difficulty IN ('easy', 'simple', 'beginner', 'basic') THEN 'easy' WHEN difficulty IN ('medium', 'intermediate', 'moderate') THEN 'medium' WHEN difficulty IN ('hard', 'difficult', 'advanced', 'expert', 'challenging') THEN 'hard' ELSE 'unknown' END AS difficulty_bucket FROM b)"""


def _marked(spark, sf_dir):
    mark = F.element_at(text.literals(MARKS), (F.col("page_id") % len(MARKS) + 1).cast("int"))
    return table(spark, sf_dir, "pages").withColumn("html", F.concat("html", mark))


@query(f"{_FACTS} SELECT * FROM f")
def page_facts(spark, sf_dir):
    """Rating, reviews, cuisine and difficulty of every page."""
    return crawl.page_facts(_marked(spark, sf_dir)).drop("url", "html")


SOME = {"cuisine_bucket": {"italian": 4, "mexican": 9, "cajun": 2, "other": 12}, "rating_bucket": {"excellent": 5, "good": 30, "average": 3}, "difficulty_bucket": {"easy": 6, "medium": 40, "unknown": 1}}


def _rank(column: str, targets: dict) -> str:
    return f"row_number() OVER (PARTITION BY {column} ORDER BY page_id) <= CASE {column} " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in targets.items()) + " ELSE 0 END"


@query(f"{_FACTS} SELECT * FROM (SELECT * FROM f WHERE review_count > 1 QUALIFY {' OR '.join(_rank(c, t) for c, t in SOME.items())}) ORDER BY page_id LIMIT 90")
def select_pages(spark, sf_dir):
    """The pages that a crawl with quotas keeps, from all pages."""
    return crawl.select_pages(_marked(spark, sf_dir), "page_id", 90, SOME).drop("url", "html")
