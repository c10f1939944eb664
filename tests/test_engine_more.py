"""Boolean search through the engine, default recipes, URL order, built-in names."""

from pyspark.sql import functions as F

from larder.engine import Engine
from larder.operators import entities, parse, recipes
from larder.sources import files


def test_engine_boolean(spark):
    docs = spark.createDataFrame([(1, "red soup\nsalt, egg\nboil the egg", "en", "s", 240), (2, "soup\negg\nfry", "de", "s", 61), (3, "tart\nfig\nbake", "en", "s", 30)], "doc_id long, text string, lang string, source string, n_chars long")
    engine = Engine(spark, recipes.from_documents(docs))
    hits = engine.boolean_search("soup", settings={"include_ingredients": "egg"})
    rows = {r.docId: r for r in hits.collect()}
    assert set(rows) == {"1", "2"} and rows["1"].total_minutes is None and rows["2"].total_minutes == 61 and rows["1"].wiki_links == []
    quiet, plain = engine.render(hits, quiet=True), engine.render(hits)
    assert all(line.split("\t")[0] in rows and len(line.split(".")[-1]) == 4 for line in quiet)
    assert {p.split(" | ")[1] for p in plain} == {"red soup", "soup"} and any("61 min" in p for p in plain)


def test_default_recipes(spark, tmp_path):
    sample = files.default_recipes(spark, str(tmp_path / "none.jsonl")).collect()
    assert len(sample) == 20 and sample[4].id == "sample_5" and sample[4].times.total == 55 and sample[4].ingredients == ["Ingredient 5A", "Ingredient 5B", "Ingredient 5C"]
    assert files.default_recipes(spark, str(tmp_path / "none.jsonl"), 3).count() == 3
    (tmp_path / "r.jsonl").write_text('{"id": "1", "title": "A"}\nbroken\n{"id": "2"}\n')
    assert [r.id for r in files.default_recipes(spark, str(tmp_path / "r.jsonl")).collect()] == ["1", "2"]
    (tmp_path / "e.jsonl").write_text("broken\n")
    assert files.default_recipes(spark, str(tmp_path / "e.jsonl")).count() == 20


def test_url_order(spark):
    ld = lambda more: '<script type="application/ld+json">{"@context": "http://schema.org", "@type": "Recipe", "name": "Pie", "recipeIngredient": ["a"]' + more + "}</script>"
    script = "canonicalUrl: 'https://x/none'; currentUrl: ' https://www.food.com/recipe/c-3 '"
    cases = {
        ld(', "url": "http://own"') + script: "http://own", ld(', "mainEntityOfPage": {"url": "http://entity", "@id": "http://id"}'): "http://entity", ld(', "mainEntityOfPage": "http://text"'): "http://text",
        ld(', "mainEntityOfPage": "true"') + script: "https://www.food.com/recipe/c-3", ld(""): "http://page", "<h1>Title</h1><link rel=canonical href='/k'>" + script: "http://page/k", "<h1>Title</h1>" + script: "https://www.food.com/recipe/c-3",
        '<h1>Title</h1>"url": "https://www.food.com/recipe/u-1"' + script: "https://www.food.com/recipe/u-1", "<h1>Title</h1>": "http://page",
    }
    df = spark.createDataFrame([("http://page", h) for h in cases], "url string, html string")
    assert {r.html: r.canonical for r in parse.parse_pages(df).collect()} == cases


def test_builtin_names(spark):
    g = {r.surface: (r.wiki_title, r.norm) for r in entities.ingredient_gazetteer(spark).collect()}
    assert g["eggplants"] == ("Eggplant", "eggplant") and g["pepper"][1] and "hummuss" not in g and len(entities.INGREDIENT_NAMES) == 140
    docs = spark.createDataFrame([(1, "Steak with black tea", ["Soy Sauce"])], "doc_id long, title string, ingredients array<string>")
    found = entities.link(docs, entities.ingredient_gazetteer(spark))
    assert sorted((r.start, r.surface) for r in found.filter(F.col("field") == "title").collect()) == [(1, "tea"), (17, "tea")]
