"""Recipe pages without JSON-LD: facts from their elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import parse
from .registry import query, table

#: Five ways to write a page, of a title T, names A to C and steps S and U. The first element that fits isn't always the first that
#: counts; the third page's steps are, by the rule, the long items of its first numbered list.
PAGES = (
    '<title>Site</title><nav><a href="/">Home</a> <a>Dessert</a> italian food</nav><h1> T </h1><div class="x ingredient">A</div><p>no</p><b class="ingredient"> <i>B</i> </b><span class="ingredient">C</span><p class="step one">S</p><p class="step">x</p><div class="step">U</div><p>2 servings</p>',
    '<h1>ab</h1><h2 class="recipe-title">T</h2><ul class="big ingredients"><li>A<li>B<ul><li>C</ul></ul><ol class="directions"><li>S<li>short<li>U</ol><meta name="keywords" content="Thai, x, Vegan,thai"><p>serves 4 quick</p>',
    "<title>T</title><ul><li>one</li><li>two</li></ul><ol><li>A</li><li>xy</li><li>B &amp; C</li></ol><ol><li>S</li><li>U</li></ol><script>var keywords: 'a, b'; recipesCount: 7</script>",
    '<div data-testid="recipe-title">T</div><ol><li class="my-ingredient-x">A</li><li class="ingredient2">B<li>no<li class="an-ingredient">C</ol><p class="instruction">tiny</p><ul><li class="direction">S<li class="directions-x">U</ul><p>Makes 12</p>advanced',
    '<h1>T</h1><div class="breadcrumbs"><a>Lunch</a><a>recipes</a> Greek </div><ul class="ingredient-list"><li>A</li><li>B</li><li>C</li></ul><div class="cooking-instruction">S<br>U</div><table class="nutrition"><tr><th>Calories<td> 12 <tr><td>Saturated Fat<td>3g<tr><td>Total fat</td><td>5g</td></tr></table><i class="stars">4.5 of 5</i><b class="review-count">(31)</b>',
)
_SQL = """WITH w AS (SELECT doc_id, list_transform(range(0, 9), lambda i: coalesce(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}')[1 + i], 'none' || i)) AS w FROM documents),
v AS (SELECT doc_id, doc_id % 5 AS k, w[1] || ' ' || w[2] AS t, w[3] AS a, w[4] AS b, w[5] AS c, 'mix the ' || w[6] || ' well' AS s, 'then bake ' || w[7] AS u FROM w)
SELECT doc_id, t AS title, CASE k WHEN 0 THEN a || '|' || b || '|' || c WHEN 1 THEN a || '|' || b || c || '|' || c WHEN 2 THEN a || '|' || b || ' & ' || c ELSE a || '|' || b || '|' || c END AS ingredients,
CASE k WHEN 2 THEN CASE WHEN length(a) > 10 THEN a || '|' ELSE '' END || b || ' & ' || c WHEN 4 THEN s || u ELSE s || '|' || u END AS instructions, CASE k WHEN 0 THEN 'Italian' WHEN 1 THEN 'Thai' WHEN 4 THEN 'Greek' ELSE '' END AS cuisine, CASE k WHEN 0 THEN 'Dessert' WHEN 1 THEN 'Vegan' WHEN 4 THEN 'Lunch' ELSE '' END AS category,
CASE k WHEN 1 THEN 'Thai|x|Vegan|thai' WHEN 2 THEN 'a|b' ELSE '' END AS keywords, CASE k WHEN 0 THEN '2' WHEN 1 THEN '4' WHEN 3 THEN '12' ELSE '' END AS served,
CASE k WHEN 4 THEN '12' END AS calories, CASE k WHEN 4 THEN '3g' END AS saturated, CASE k WHEN 4 THEN '5g' END AS fat, CASE k WHEN 4 THEN '4.5' END AS rating, CASE k WHEN 4 THEN '31' END AS review_count, CASE k WHEN 2 THEN 7 END::BIGINT AS recipes FROM v"""


@query(_SQL)
def html_recipes(spark, sf_dir):
    """A page a document, without JSON-LD, written in five ways."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]{4,})"), F.lit(1))
    # exploded, the list of words is computed once; a plain column's expression would be copied to each use of a word
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(words)).alias("w"))
    w = lambda i: F.coalesce(F.get("w", F.lit(i)), F.lit(f"none{i}"))
    parts = {"\x01": F.concat(w(0), F.lit(" "), w(1)), "\x02": w(2), "\x03": w(3), "\x04": w(4), "\x05": F.concat(F.lit("mix the "), w(5), F.lit(" well")), "\x06": F.concat(F.lit("then bake "), w(6))}
    html = F.element_at(F.array(*(F.lit(_marked(p)) for p in PAGES)), (F.col("doc_id") % len(PAGES) + 1).cast("int"))
    for mark, value in parts.items():
        html = F.replace(html, F.lit(mark), value)
    rows = parse.parse_pages(docs.select("doc_id", F.concat(F.lit("http://x/recipe/"), F.col("doc_id").cast("string")).alias("url"), html.alias("html")))
    joined = lambda c: F.array_join(c, "|").alias(c)
    return rows.select(
        "doc_id", "title", joined("ingredients"), joined("instructions"), joined("cuisine"), joined("category"), joined("keywords"), F.col("yield").alias("served"), "nutrition.calories", F.col("nutrition.saturated_fat").alias("saturated"),
        "nutrition.fat", "ratings.rating", "ratings.review_count", F.col("author_stats.recipes").alias("recipes"),
    )


def _marked(page: str) -> str:
    """The places of T, A, B, C, S and U in a page as control characters, which no word has."""
    import re

    return re.sub(r"(?<![A-Za-z])([TABCSU])(?![A-Za-z])", lambda m: chr(1 + "TABCSU".index(m[1])), page)
