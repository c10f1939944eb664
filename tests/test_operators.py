"""Entities, crawl side, parsing, wiki, planner, files and streams on small fixtures."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from larder.functions import text
from larder.operators import crawl, entities, facets, parse, planner, wiki
from larder.plans import registry
from larder.sources import files
from larder.streaming import incremental

NAMES = ["egg", "eggs", "eggplant", "black pepper", "pepper", "tea"]


def spans(spark, text, **how):
    df = spark.createDataFrame([(text,)], "t string")
    return [(r.start, r.end, r.surface) for r in df.select(entities.spans(F.col("t"), NAMES, **how).alias("s")).first().s]


def test_spans(spark):
    text = "Black pepper eggplants steak"
    assert spans(spark, text) == [(0, 12, "black pepper"), (13, 16, "egg"), (24, 27, "tea")]
    assert spans(spark, text, mode="longest") == [(0, 12, "black pepper"), (13, 21, "eggplant"), (24, 27, "tea")]
    assert spans(spark, text, word_boundary=True) == [(0, 12, "black pepper")]
    assert spans(spark, None) == [] and spans(spark, "nothing") == []


@pytest.mark.parametrize("mode", ["earliest", "longest"])
@pytest.mark.parametrize("word_boundary", [False, True])
def test_spans_are_those_of_an_alternation(mode, word_boundary):
    """Leftmost, then shortest or longest, for thousands of names as for a few."""
    from larder.functions import automaton

    r = random.Random(4)
    for n in (5, 4000):
        names = sorted({"".join(r.choices("abc é", k=r.randint(1, 6 if n > 5 else 2))).strip() for _ in range(n)} - {""})
        body = "|".join(re.escape(x) for x in sorted(names, key=lambda x: (-len(x) if mode == "longest" else len(x), x)))
        want = re.compile(rf"(?<!\w)(?:{body})(?!\w)" if word_boundary else body)
        find = automaton.finder(names, mode, word_boundary)
        for _ in range(40):
            text = "".join(r.choices("abc é_,", k=60))
            assert [(s, e, names[i]) for s, e, i in find(text)] == [(m.start(), m.end(), m[0]) for m in want.finditer(text)]


def test_enrich(spark):
    gaz = entities.literal_gazetteer(spark, [("egg", "Egg", "ingredient"), ("thai", "Thai cuisine", "cuisine"), ("eggplant", "Eggplant", "ingredient")])
    assert gaz.filter("surface = 'eggs'").first().wiki_title == "Egg"
    info = spark.createDataFrame([("Egg", "An egg.", list("abcdefg"))], "title string, abstract string, categories array<string>")
    rows = spark.createDataFrame([(1, "Thai eggplant", ["egg"], ["cook"], [])], "doc_id long, title string, ingredients array<string>, instructions array<string>, cuisine array<string>")
    out = entities.enrich(rows, gaz, info).first()
    assert [x.wiki_title for x in out.wiki_links] == ["Thai cuisine", "Egg", "Eggplant"] and out.cuisine == ["Thai cuisine"]
    assert out.wiki_links[1].abstract == "An egg." and len(out.wiki_links[1].categories) == 5
    assert entities.grouped_links(entities.enrich(rows, gaz, info), n=1).count() == 2


def test_quota_is_the_sequential_fold(spark):
    for seed in range(3):
        r = random.Random(seed)
        rows = [(i, r.choice("abc"), r.choice("xy"), r.choice("pqr")) for i in range(200)]
        quotas = {"a": {"a": 9, "b": 4}, "b": {"x": 5, "y": 3}, "c": {"p": 2, "q": 30}}
        counts, want = {}, []
        for row in rows:
            keys = list(zip("abc", row[1:]))
            if len(want) < 40 and any(counts.get(k, 0) < quotas[k[0]].get(k[1], 0) for k in keys):
                want.append(row[0])
                for k in keys:
                    counts[k] = counts.get(k, 0) + 1
        df = spark.createDataFrame(rows, "seq int, a string, b string, c string")
        assert [x.seq for x in crawl.quota_sample(df, quotas, "seq", 40).collect()] == want


def test_urls(spark):
    urls = ["https://www.food.com/recipe/a-b-12", "https://www.food.com/recipe/a-13/x", "https://www.food.com/recipe/a-14?ref=home", "https://www.food.com/about/x-1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls[:1])], "seq int, url string")
    assert [r.url for r in crawl.filter_urls(df).orderBy("seq").collect()] == urls[:2] + urls[:1]
    assert crawl.dedupe_urls(df, "seq").count() == 4
    seen = crawl.dedupe_urls(df.limit(1), "seq")
    assert crawl.dedupe_urls(df, "seq", seen=seen).count() == 3
    assert [r[0] for r in df.select(crawl.document_id(F.col("url"))).limit(4).collect()] == ["12", "13", "14", ""]
    page = spark.createDataFrame([("http://h/a/b?x", '<link href="/c" rel="canonical">', "http://h/c"), ("http://h/a/b", "<link rel=canonical href='c'>", "http://h/a/c"), ("http://h/a", "<p>", "http://h/a")], "url string, html string, want string")
    assert page.filter(crawl.canonical_url(F.col("url"), F.col("html")) != F.col("want")).count() == 0


ROBOTS = "User-agent: *\nDisallow: /private/*\nDisallow: /exact\nUser-agent: other\nDisallow: /other\nSitemap: http://h/s.xml\nUser-agent: OurBot\nDisallow: /bot # note\n"


def test_robots_and_sitemaps(spark):
    lines = spark.createDataFrame([("h", i, x) for i, x in enumerate(ROBOTS.split("\n"))], "host string, line_no int, line string")
    rules, maps = crawl.parse_robots(lines, agents=("*", "ourbot"))
    assert {r.pattern for r in rules.collect()} == {"/private/*", "/exact", "/bot"} and maps.first().sitemap == "http://h/s.xml"
    urls = spark.createDataFrame([("http://h/private/1",), ("http://h/exact",), ("http://h/exact/more",), ("http://h/x?/bot",)], "url string")
    assert {r.url for r in crawl.allowed_urls(urls, rules).collect()} == {"http://h/exact/more", "http://h/x?/bot"}
    assert {r.url for r in crawl.allowed_urls(urls, rules, rfc=True).collect()} == {"http://h/x?/bot"}
    xml = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc> http://h/1 </loc></url><url><loc>http://h/2</loc></url></urlset>'
    got = crawl.sitemap_locations(spark.createDataFrame([(xml,)], "xml string")).collect()
    assert [(r.is_index, r.loc) for r in got] == [(False, "http://h/1"), (False, "http://h/2")]


def test_child_sitemaps_and_rules_by_host(spark):
    one = lambda kind, tag, locs: f"<{kind}>" + "".join(f"<{tag}><loc>{x}</loc></{tag}>" for x in locs) + f"</{kind}>"
    maps = spark.createDataFrame([("http://h/root.xml", one("sitemapindex", "sitemap", ["http://h/a.xml", "http://h/b.xml"])), ("http://h/a.xml", one("urlset", "url", ["http://h/1", "http://h/2"])), ("http://h/b.xml", one("urlset", "url", ["http://h/2"])), ("http://h/other.xml", one("urlset", "url", ["http://h/9"]))], "url string, xml string")
    assert sorted(r.url for r in crawl.all_locations(maps, spark.createDataFrame([("http://h/root.xml",)], "url string")).collect()) == ["http://h/1", "http://h/2"]
    urls = spark.createDataFrame([("http://A/x/1",), ("http://b/x/1",), ("http://c/x/1",)], "url string")
    rules = spark.createDataFrame([("a", "/x/*"), ("b", "/y/*"), ("b", "/x")], "host string, pattern string")
    assert sorted(r.url for r in crawl.allowed_urls(urls, rules).collect()) == ["http://b/x/1", "http://c/x/1"]
    order = [r.url for r in crawl.shuffled(urls, 3).collect()]
    assert sorted(order) == sorted(r.url for r in urls.collect()) and order == [r.url for r in crawl.shuffled(urls.repartition(3), 3).collect()]
    assert crawl.enough_ratings(spark.range(4), F.col("id")).count() == 2


def test_files_and_reports(spark, tmp_path):
    import gzip

    at = lambda name: str(tmp_path / name)
    (tmp_path / "r.jsonl").write_text('{"id": "1"}\n\nnot json\n{"id": "2"}\n{"id": "3"}\n')
    assert files.count_lines(spark, at("r.jsonl")).first().n == 4 and files.read_recipes(spark, at("r.jsonl"), limit=2).count() == 2
    assert files.read_static_json(spark, at("none.json"), "id string").count() == 0
    (tmp_path / "map.json").write_text('[{"id": "a"}, {"id": "b"}]')
    assert files.read_static_json(spark, at("map.json"), "id string").count() == 2
    bodies = spark.createDataFrame([(1, bytearray(gzip.compress("ä<x>".encode()))), (2, bytearray(b"<y>")), (3, bytearray(b"\x1f\x8bcut")), (4, None)], "i int, b binary")
    got = {r.i: r.t for r in bodies.select("i", files.decode_body(F.col("b")).alias("t")).collect()}
    assert got[1] == "ä<x>" and got[2] == "<y>" and got[3].endswith("cut") and got[4] is None
    pages = spark.createDataFrame([(1, "http://h/1", "<p>", "en"), (2, "http://h/2", "<q>", "de")], "page_id long, url string, html string, lang string")
    for _ in range(2):
        files.write_pages(pages, at("pages"))
        files.append_log(pages.agg(F.count("*").alias("n")), at("log"))
    assert spark.read.parquet(at("pages")).count() == 4 and spark.read.json(at("log")).filter("n = 2 and logged_at is not null").count() == 2
    files.write_selection(pages, at("chosen"), ["lang"])
    assert files.read_seeds(spark, at("chosen/urls")).count() == 2 and spark.read.json(at("chosen/distribution")).filter("value = 'de' and n = 1").count() == 1
    files.write_report(pages.agg(F.count("*").alias("pages")), at("report"))
    assert "| pages | 2 |" in [r.value for r in spark.read.text(at("report")).collect()]
    options = spark.createDataFrame([("Tex Mex",), ("Thai",)], "value string")
    assert facets.matching_options(options, "tEx").count() == 1 and facets.matching_options(options, "").count() == 2


def ld(**more):
    data = {"@context": "http://schema.org", "@type": "Recipe", "name": "Pie", "recipeIngredient": ["flour", "egg"], "recipeInstructions": [{"text": "Mix"}, "Bake"], "prepTime": "PT10M", "cookTime": "PT1H", "keywords": "Easy,Italian,Tex Mex,Dessert", "author": {"name": "Ann"}, "nutrition": {"calories": "12"}, "image": "http://img/recipes/1.jpg"}
    return f'<script type="application/ld+json"><!-- {json.dumps(data | more)} --></script>'


def test_json_ld(spark):
    rows = [("http://x/recipe/pie-7", ld()), ("http://x/recipe/8", ld(author="Bob", recipeCategory="Dessert", totalTime="PT5M")), ("http://x/recipe/c-9", ld(**{"@context": "https://schema.org"}))]
    got = {r.recipe_id: r for r in parse.parse_json_ld(spark.createDataFrame(rows, "url string, html string")).collect()}
    a, b, c = got["7"], got["8"], got["9"]
    assert a.title == "Pie" and a.ingredients == ["flour", "egg"] and a.instructions == ["Mix", "Bake"] and a.author == "Ann" and b.author == "Bob"
    assert (a.times.prep, a.times.cook, a.times.total, b.times.total) == (10, 60, 70, 5) and a.cuisine == ["Italian", "Tex Mex"] and a.category == ["Easy", "Dessert"] and b.category == ["Dessert", "Easy"]
    assert a.difficulty == "easy" and a.nutrition.calories == "12" and a.ratings is None and a.image == "http://img/recipes/1.jpg"
    assert c.title == "" and parse.parse_json_ld(spark.createDataFrame(rows[2:], "url string, html string"), lenient=True).first().title == "Pie"


def test_html_fallback(spark):
    html = "<title>Site</title><h1>Plum Cake</h1><ul><li>1 plum<li>flour</li><li>salt</li></ul><p>Prep Time: 1 hr 5 mins</p><ol><li>Mix the whole thing.</li><li>Bake the whole thing.</li></ol><p>Serves: 4</p>"
    rows = [("http://x/recipe/a-1", html), ("http://x/recipe/a-2", "<p>no title</p>"), ("http://x/recipe/a-3", ld()), (None, None)]
    got = {r.recipe_id: r for r in parse.parse_pages(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert set(got) == {"1", "3"} and got["3"].parser == "json-ld"
    a = got["1"]
    assert a.title == "Plum Cake" and a.ingredients == ["1 plum", "flour", "salt"] and len(a.instructions) == 2 and (a.times.prep, a.times.total) == (65, 65) and getattr(a, "yield") == "4"
    links = parse.ingredient_links(spark.createDataFrame([('<a href="/about/egg-142">Egg</a><a href="/about/egg-142">egg</a>',)], "html string")).collect()
    assert [(r.ingredient_id, r.slug, r.name) for r in links] == [("142", "egg", "egg")]


def test_images(spark):
    df = spark.createDataFrame([("http://a/recipe/1.jpg", True), ("http://a/recipe/logo.png", False), ("http://img.sndimg.com/x/c_thumb/1", True), ("http://a/x.jpg", False), ("", False), (None, False)], "u string, want boolean")
    assert df.filter(parse.is_recipe_image(F.col("u")) != F.col("want")).count() == 0
    one = spark.range(1).select(parse.distinct_images(F.array(F.lit("http://a/food/1.jpg?w_10"), F.lit("http://a/food/1.jpg"))).alias("x")).first().x
    assert one == ["http://a/food/1.jpg?w_10"]


def test_list_items_keep_their_digits(spark):
    """trim takes a second argument, which transform would fill with an item's place."""
    df = spark.createDataFrame([("a0, b1 ,c2", "[[Category: x0]] [[Category:y1]]")], "k string, w string")
    row = df.select(text.split_keywords(F.col("k")).alias("k"), wiki.categories(F.col("w")).alias("w")).first()
    assert row.k == ["a0", "b1", "c2"] and row.w == ["x0", "y1"]


def test_wiki(spark):
    got = {r.title: r for r in wiki.extract_entities(spark.createDataFrame(registry.WIKI_PAGES, "title string, text string")).collect()}
    assert set(got) == {"Black Pepper", "Italian Cuisine"}
    a = got["Black Pepper"]
    assert a.type == "ingredient" and a.abstract == "Black pepper is a spice." and a.country == "India" and a.origin_category == "India"
    assert a.region == "[[Kerala"  # a value ends at a bar
    more = wiki.extract_entities(spark.createDataFrame(registry.WIKI_PAGES, "title string, text string"), binomials=False)
    assert {r.title: r.type for r in more.collect()}["Caesar salad"] == "dish"
    cut = {"== Head ==\nlater": "", "{{Infobox\n== not a heading ==\n}}\nlead [[a|b]]\n==H==\nlater": "lead b", "one {{x}}\n|rest\n* item\ntwo\n== H": "one two", "": ""}
    rows = spark.createDataFrame([(t,) for t in cut], "t string").select("t", wiki.abstract(F.col("t")).alias("a")).collect()
    assert {r.t: r.a for r in rows} == cut
    short = spark.range(1).select(wiki.abstract(F.lit("One two three. Four five six seven eight."), 20).alias("x")).first().x
    assert short == "One two three."


def test_planner(spark):
    profile = spark.createDataFrame([("male", 30, 180, 80, "moderate", "lose")], "gender string, age int, height_cm int, weight_kg int, activity string, goal string")
    t = planner.daily_targets(profile).first()
    assert (round(t.bmr, 3), t.calories, t.protein, t.carbs, t.fat) == (1853.632, 2442, 214, 214, 81)
    meals = {r.meal: r.meal_calories for r in planner.meal_targets(planner.daily_targets(profile)).collect()}
    assert meals == {"breakfast": 611, "lunch": 855, "dinner": 733, "snacks": 244}
    assert profile.filter(planner.valid_profile()).count() == 1


def test_greedy_is_the_loop(spark):
    r = random.Random(4)
    rows = []
    for i in range(60):
        items = sorted((abs(c - 500.0), j, float(c)) for j, c in enumerate(r.choices(range(60, 700), k=8)))
        picked, total = [], 0.0
        for _, j, c in items:
            if len(picked) < 3 and total < 450 and total + c <= 650:
                picked, total = [*picked, j], total + c
        rows.append((i, items, picked))
    df = spark.createDataFrame(rows, "i int, items array<struct<d:double,food_id:int,calories:double>>, want array<bigint>")
    got = df.select("want", planner.greedy_pick(F.col("items"), F.lit(500.0))["picked"].alias("got")).collect()
    assert all(x.want == x.got for x in got)


def test_facets(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "p string, q string")
    got = {(r.dimension, r.value): (r.n, r.progress) for r in facets.distribution(df, ["p", "q"], {"a": 4}).collect()}
    assert got == {("p", "a"): (2, 50.0), ("p", "b"): (1, None), ("q", "x"): (2, None), ("q", "y"): (1, None)}


def test_files(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "1", "title": "A", "nutrition": {"calories": 5}}\n\nbroken\n{"id": "2"}\n')
    rows = files.read_recipes(spark, str(tmp_path / "r.jsonl")).cache()
    good, errors = files.split_corrupt(rows)
    assert good.count() == 2 and errors.first().errors == 1 and good.filter("id = '1'").first().nutrition.calories == "5"
    (tmp_path / "h/x").mkdir(parents=True)
    (tmp_path / "h/x/7.html").write_text("<p>é")
    assert [(r.name, r.html) for r in files.read_html_folder(spark, str(tmp_path / "h")).collect()] == [("7", "<p>é")]
    (tmp_path / "d.xml").write_text('<mediawiki xmlns="http://m/"><page><title>T</title><ns>0</ns><revision><text bytes="3">abc</text></revision></page></mediawiki>')
    assert [(r.title, r.text) for r in files.read_wiki_dump(spark, str(tmp_path / "d.xml")).collect()] == [("T", "abc")]
    files.write_tsv(spark.createDataFrame([("q1", "b", 2), ("q1", "a", 1)], "qid string, docId string, rel int"), str(tmp_path / "t"), "docId")
    assert [r.docId for r in files.read_tsv(spark, str(tmp_path / "t"), "qid string, docId string, rel int").collect()] == ["a", "b"]
    (tmp_path / "s.txt").write_text(" http://a \n\nhttp://b\n")
    assert files.read_seeds(spark, str(tmp_path / "s.txt")).count() == 2 and files.sample_rows(spark).count() == 20
    last = files.last_per_key(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, seq int, v string"), "k", "seq")
    assert last.first().v == "y"


def test_stream_index(spark, tmp_path):
    schema = "doc_id long, title string, ingredients array<string>, instructions array<string>"
    for i, row in enumerate(['{"doc_id": 1, "title": "lemon tart"}', '{"doc_id": 2, "title": "lemon"}', '{"doc_id": 1, "title": "plum"}']):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in/{i}.json").write_text(row)
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        incremental.stream_index(stream, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    ix = incremental.load_stream_index(spark, str(tmp_path / "ix"))
    assert {(r.term, r.doc_id) for r in ix.postings.collect()} == {("lemon", 2), ("plum", 1)} and ix.stats.first().n_docs == 2
