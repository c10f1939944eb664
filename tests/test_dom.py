"""Selectors over a page's elements, and the recipe fields that come from them, on written-out pages."""

import pytest
from pyspark.sql import functions as F

from larder.operators import dom, parse

TREE = '<div class="a b" id=x><p>one<p class="b">two <b>bold</b></div><ul class="b"><li>1<li class="z b">2<ul><li>in</ul><li>3</ul><img src=i.png><br>end</nope>'


@pytest.mark.parametrize("selector, texts", [
    ("p", ["one", "two bold"]), (".b", ["onetwo bold", "two bold", "12in3", "2in"]), ("div .b", ["two bold"]), ("ul.b li", ["1", "2in", "in", "3"]), ("ul ul li", ["in"]), ("li[class*=\"z\"]", ["2in"]), ("[id=\"x\"]", ["onetwo bold"]),
    ("div.a.b p b", ["bold"]), ("img[src]", [""]), ("section", []), (".a li", []),
])
def test_selectors(selector, texts):
    tree = dom.Tree(TREE)
    assert [tree.text(n) for n in tree.nodes if dom.matches(n, selector)] == texts


GOLDEN = {
    "title of three characters goes on to the next selector": ("<h1>abc</h1><div class=title>Real one</div>", {"title": "Real one"}),
    "only the first element of a selector counts": ("<h1> </h1><h1>Second</h1><title>From head</title>", {"title": "From head"}),
    "no title": ("<p>x</p>", {"title": ""}),
    "selectors by order, not by place": ('<li class="ingredient-list-x">late</li><div class="ingredients"><ul><li>early</li></ul></div>', {"ingredients": ["early"]}),
    "a selector whose items are too short is passed over": ('<b class="ingredient">ab</b><ul class="ingredients"><li>three</li></ul>', {"ingredients": ["three"]}),
    "the first list of three, ordered ones too": ("<ul><li>one</li><li>two</li></ul><ol><li>aaa</li><li>b</li><li>ccc</li></ol>", {"ingredients": ["aaa", "ccc"]}),
    "nested items belong to the outer list": ("<ul><li>top<ul><li>sub one</li></ul></li><li>end</li></ul>", {"ingredients": ["topsub one", "sub one", "end"]}),
    "steps over ten characters": ('<p class="step">0123456789</p><p class="step">01234567890</p>', {"instructions": ["01234567890"]}),
    "two numbered items will do": ("<ol><li>first long step</li><li>second long step</li></ol>", {"instructions": ["first long step", "second long step"], "ingredients": []}),
    "last row of a nutrient stays": ('<table class="nutrition"><tr><td>Fat</td><td>1</td></tr><tr><td>Fat total</td><td> 2 </td></tr><tr><td>Fat, saturated</td><td>3</td></tr><tr><td>alone</td></tr></table>', {"nutrition": {"fat": "2", "saturated_fat": "3"}}),
    "the first element with a number": ('<i class="stars">none</i><i data-rating="9">4.25 stars, 3</i><i class="reviews">x 12 y</i>', {"rating": "4.25", "reviews": "12"}),
    "scripts hold no elements": ("<script>var a = '<h1>No</h1>';</script><h1>Yes &amp; <b>no</b></h1><!-- <h1>x</h1> -->", {"title": "Yes & no"}),
    "images by their places": ('<div class="media"><img src="m"><div class="my primary-image"><p><img src="p"><img></div></div><img src="e">', {"primary": ["p"], "media": ["m", "p"], "other": [], "every": ["m", "p", "e"]}),
    "crumbs": ('<nav>A <a>b</a></nav><ol class="breadcrumb"><li><a>c d</a></ol>', {"crumbs": ["A b", "c d"], "crumb_links": ["b", "c d"]}),
    "metas": ('<meta name="keywords" content="a, b"><meta name="keywords" content="c"><meta property="og:image" content="i"><meta name=description>', {"metas": {"keywords": "a, b", "og:image": "i"}}),
}


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_elements(name):
    html, want = GOLDEN[name]
    got = dom.read_page(html)
    assert {k: got[k] for k in want} == want


def test_odd_pages(spark):
    pages = [None, "", "<", "<<p>>", "</p></p>", "<li>" * 3000, "<h1>" + "x" * 200_000, "<p a=1 a=2 class>", "\x00<h1>ok title</h1>", "<svg/><h1 class='" + "c " * 500 + "'>many classes</h1>"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string").select("i", dom.page_elements(F.col("h")).alias("e")).collect()
    got = {r.i: r.e for r in rows}
    assert got[0] is None and got[1] is None and len(got[6].title) == 200_000 and got[8].title == "ok title" and got[9].title == "many classes"
    assert dom.read_page(None) is None


def test_fields_of_a_page(spark):
    html = """<html><head><title>Any</title><meta name="keywords" content="Thai, easy , Vegan,"><meta name="description" content=" Good "><meta property="og:image" content="http://x/food/og.jpg"></head>
<nav><a>Dinner</a><a>Home</a> moroccan</nav><h1>Hot Soup</h1><p>Submitted by Ann Lee, 2020</p><div class="primary-image"><img src="http://x/logo.png"></div><div class="other-images"><img src="http://x/recipe/2.jpg"><img src="http://x/recipe/2.jpg"></div>
<li class="ingredient">1 onion</li><p class="instruction">Heat the pan in the OVEN.</p><p class="instruction">Use a knife and the pan.</p>
<script>{"servingSize": "1 cup", "datePublished": "2020-01-02", "bio": "I <b>cook</b>&nbsp;much", "location": "Rome", "recipesCount": 12, "totalFatPctDailyValue": "9"}</script> Yields 6 Prep time: 10 min</html>"""
    r = parse.parse_html(spark.createDataFrame([("http://x/recipe/hot-7", html)], "url string, html string")).first()
    assert (r.recipe_id, r.title, r.description, r.ingredients, r.instructions) == ("7", "Hot Soup", "Good", ["1 onion"], ["Heat the pan in the OVEN.", "Use a knife and the pan."])
    assert (r.cuisine, r.category, r.keywords, r.tools) == (["Thai", "Moroccan"], ["Dinner", "Vegan"], ["Thai", "easy", "Vegan"], ["oven", "pan", "knife"])
    assert (getattr(r, "yield"), r.author, r.date_published, r.difficulty, r.serving_size, r.times.prep) == ("6", "ann lee", "2020-01-02", "easy", "1 cup", 10)
    assert (r.author_bio, r.author_location, r.author_stats.recipes, r.author_stats.followers, r.daily_values) == ("I cook much", "Rome", 12, None, {"serving_size": "1 cup", "total_fat_pct": "9"})
    assert (r.image, r.all_images, r.nutrition, r.ratings) == ("http://x/food/og.jpg", ["http://x/recipe/2.jpg"], None, None)


def test_pages_are_read_once(spark, tmp_path):
    """A filter on what a page tells makes neither its elements nor its JSON-LD be read again."""
    ld = '<script type="application/ld+json">{"@context": "http://schema.org", "@type": "Recipe", "name": "Pie", "recipeIngredient": ["egg"]}</script>'
    pages = [("http://x/recipe/a-1", ld), ("http://x/recipe/b-2", "<h1>Soup of the day</h1>"), ("http://x/recipe/c-3", "<p>no title</p>"), ("http://x/recipe/d-4", None)]
    spark.createDataFrame(pages, "url string, html string").write.parquet(str(tmp_path / "p"))
    rows = parse.parse_pages(spark.read.parquet(str(tmp_path / "p")))
    assert sorted((r.recipe_id, r.title, r.parser, r.tools) for r in rows.collect()) == [("1", "Pie", "json-ld", None), ("2", "Soup of the day", "html", [])]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("parseJson") == 1 and plan.count("Relation") == 1


def test_candidates_of_an_element_are_those_of_all_selectors():
    for html in (TREE, *(h for h, _ in GOLDEN.values())):
        for n in dom.Tree(html).nodes:
            keys = (("", n.tag), *((".", c) for c in n.classes), *(("@", a) for a in n.attrs))
            assert sorted(s for k in keys for s, parts in dom._BY_KEY.get(k, ()) if dom._fits(n, parts)) == sorted(s for s in dom._ALL if dom.matches(n, s))


def test_functions_travel_without_the_package():
    import os
    import subprocess
    import sys

    from pyspark import cloudpickle

    got = subprocess.run([sys.executable, "-c", "import pickle, sys; print(pickle.loads(sys.stdin.buffer.read())('<h1>Soup</h1>')['title'])"], input=cloudpickle.dumps(dom.read_page), capture_output=True, cwd="/", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert got.stdout.decode().strip().endswith("Soup"), got.stderr.decode()[-300:]
