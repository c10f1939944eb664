"""The index, its scores, filters and metrics on hand-made fixtures."""

import re

import pytest
from pyspark.sql import functions as F

from larder.engine import Engine
from larder.functions import text
from larder.operators import evaluate, filters, recipes, search
from larder.operators.index import Index, build_field_index, build_index, load_tsv

ROWS = [
    (1, "Lemon Chicken", ["chicken breast", "lemon juice"], ["grill chicken", "squeeze lemon"]),
    (2, "Chicken Soup", ["chicken", "carrot", "onion"], ["simmer chicken broth"]),
    (3, "Lemon Tart", ["lemon", "butter", "flour"], ["bake tart shell"]),
    (4, "Green Salad", ["lettuce", "onion"], ["toss salad"]),
]
SCHEMA = "doc_id long, title string, ingredients array<string>, instructions array<string>"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def index(table):
    return build_index(table)


def hits(df):
    return [(r.doc_id, round(r.score, 6)) for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize(("query", "bm25", "tfidf"), [
    ("lemon chicken", [(3, -1.565331), (2, -3.389040), (1, -5.091291)], [(1, 1.603567), (2, 1.404869), (3, 0.668619)]),
    ("chicken", [(1, -3.283982), (2, -3.389040)], [(1, 1.603567), (2, 1.603567)]),
    ("onion tart", [(3, 3.931100), (4, 1.999900), (2, 1.862502)], [(3, 0.894427), (2, 0.707107), (4, 0.707107)]),
])
def test_scores(index, query, bm25, tfidf):
    near = lambda got, want: all(a[0] == b[0] and abs(a[1] - b[1]) < 5e-6 for a, b in zip(got, want, strict=True))
    assert near(hits(search.search(index, query)), bm25)
    assert near(hits(search.search(index, query, "tfidf")), tfidf)


def test_impacts_give_the_same_scores(index, table):
    fast, some = index.with_impacts(), table.filter("doc_id <> 2").select("doc_id")
    for metric in ("bm25", "tfidf"):
        for query in ("lemon chicken", "onion tart tart", "zzz"):
            for allowed in (None, some):
                assert hits(search.search(fast, query, metric, allowed=allowed)) == hits(search.search(index, query, metric, allowed=allowed))


def test_index_tables(index):
    df = {r.term: r.df for r in index.terms.collect()}
    assert (df["chicken"], df["lemon"], df["onion"], df["tart"]) == (6, 5, 2, 2)
    assert index.stats.first().n_docs == 4 and index.stats.first().avg_len == 8.0


def test_batch_count_pages_and_empty(spark, index, table):
    queries = spark.createDataFrame([(1, "lemon chicken"), (2, "onion tart"), (3, "nothing known")], "qid int, query string")
    batch = search.search_batch(index, queries, 2)
    assert [(r.qid, r.doc_id) for r in batch.orderBy("qid", "rank").collect()] == [(1, 3), (1, 2), (2, 3), (2, 4)]
    assert search.count_hits(index, "lemon chicken").first().total == 3
    assert [x for x, _ in hits(search.search(index, "lemon chicken", k=2, offset=1))] == [2, 1]
    assert search.search(index, "the and").count() == 0
    some = table.filter("doc_id > 2").select("doc_id")
    assert hits(search.search(index, "", allowed=some)) == [(3, 1.0), (4, 1.0)]
    assert [x for x, _ in hits(search.search(index, "lemon", allowed=some))] == [3]
    assert search.page_numbers(21, 3, 10) == {"offset": 20, "total_pages": 3}


def test_an_index_of_the_asked_terms_scores_like_the_whole(spark, index, table):
    words = ["lemon", "chicken", "nowhere"]
    for only in (words, spark.createDataFrame([(w,) for w in words], "term string")):
        few = build_index(table, only=only)
        assert {r.term for r in few.postings.collect()} == {"lemon", "chicken"} == {r.term for r in few.terms.collect()}
        assert few.stats.collect() == index.stats.collect() and sorted(few.docmeta.collect()) == sorted(index.docmeta.collect())
        for metric in ("bm25", "tfidf"):
            assert hits(search.search(few, "lemon chicken", metric)) == hits(search.search(index, "lemon chicken", metric))


def test_field_search(table):
    ix = build_field_index(table)
    for kind in ("bm25", "classic"):
        got = search.field_search(ix, "Tart, onion!", similarity=kind).collect()
        assert got[0].doc_id == 3 and {r.doc_id for r in got} == {2, 3, 4}
    assert search.field_search(ix, "  ").count() == 0


def test_index_round_trips(spark, index, tmp_path):
    index.write(str(tmp_path / "ix"))
    again = Index.load(spark, str(tmp_path / "ix"))
    assert hits(search.search(again, "onion tart")) == hits(search.search(index, "onion tart"))
    index.export_tsv(str(tmp_path / "tsv"))
    assert hits(search.search(load_tsv(spark, str(tmp_path / "tsv")), "onion tart")) == hits(search.search(index, "onion tart"))


@pytest.mark.parametrize(("raw", "want"), [
    ("Crème brûlée 2cups foo_bar don't x ab &amp;cd; Ñandú naïve Kelvin ok", ["don", "ab", "cd", "kelvin", "ok"]),
    ("A&B salt-and-pepper", ["salt", "pepper"]), ("straße süß the Thé", []), ("e\u0301clair cafe\u0301 tart", ["clair", "cafe", "tart"]), ("\u00e9clair tart", ["tart"]), (None, []), ("", []),
])
def test_tokenizer(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "t string")
    got = df.select(text.tokenize(F.col("t")).alias("x")).first().x
    assert got == text.py_tokenize(raw)
    assert got == want


def test_functions(spark):
    row = spark.range(1).select(
        text.clean_abstract(F.lit("A (, ; ) b |key=x")).alias("a"), text.clean_abstract(F.lit("A" * 300)).alias("b"), text.clean_abstract(F.lit("")).alias("c"),
        text.slugify(F.lit("Crème & Co!"), F.lit(5)).alias("d"), text.iso_minutes(F.lit("PT1H30M")).alias("e"), text.iso_minutes(F.lit("P1D")).alias("f"),
        text.normalize_ingredient(F.lit("2 1/2 cups fresh Basil leaves (packed), chopped")).alias("g"), text.normalize_ingredient(F.lit("12")).alias("h"),
        text.leading_number(F.lit("12 g")).alias("i"), text.safe_double(F.lit("12 g")).alias("j"), text.safe_double(F.lit(" 450.5 ")).alias("k"),
        text.snippet(F.lit("The Lemon tart"), F.lit(3), ["lemon"]).alias("l"), text.snippet(F.lit(""), F.lit(3), ["lemon"]).alias("m"), text.format_duration(F.lit(90)).alias("n"),
    ).first()
    assert row.a == "A b x" and row.b == "A" * 200 + "..." and row.c == "N/A" and row.d == "cr-me-co-5" and (row.e, row.f) == (90, 0)
    assert row.g == "basil" and row.h is None and (row.i, row.j, row.k) == (12.0, 0.0, 450.5)
    assert row.l == "The **lemon** tart" and row.m == "Document 3" and row.n == "1.5m"


def recipe(**values):
    return {f: None for f in recipes.SCHEMA.names} | {"id": "1", "title": "T"} | values


@pytest.mark.parametrize(("values", "settings", "passes"), [
    ({"nutrition": None}, {"max_calories": 100}, True), ({"nutrition": None}, {"min_calories": 1}, False), ({"nutrition": {"calories": "12 g"}}, {"min_calories": 1}, False),
    ({"times": {"total": 0}}, {"max_total_minutes": 5}, True), ({"yield": ""}, {"min_yield": 4}, True), ({"yield": "a few"}, {"min_yield": 4}, False), ({"yield": "a few"}, {"max_yield": 4}, True),
    ({"yield": "12 cookies"}, {"min_yield": 4, "max_yield": 12}, True), ({"cuisine": ["Italian"]}, {"cuisine": "italian"}, True), ({"cuisine": ["Italian"]}, {"cuisine": ["ital"]}, False),
    ({"cuisine": []}, {"cuisine": 0}, True), ({"publication_date": "soon"}, {"min_publication_date": "2020-01-01"}, True), ({"date_published": "2019-05-01"}, {"min_publication_date": "2020-01-01"}, False),
    ({"date_published": "2021-05-01T10:00:00Z"}, {"date_from": "2020-01-01", "date_to": "2022-01-01"}, True), ({"image": "  "}, {"has_image": True}, False), ({"ratings": {"rating": "4.5", "review_count": "7.9"}}, {"min_rating": 4.5, "min_review_count": 7}, True),
    ({"ratings": {"average": "3", "rating": "5"}}, {"min_rating": 4}, False), ({"keywords": ["Easy"]}, {"keywords": ["easy"]}, True), ({"description": "so easy"}, {"keywords": ["easy"]}, True),
    ({"tools": ["Pan"]}, {"required_tools": ["pan"]}, True), ({"ingredients": ["a", "b"]}, {"min_ingredients": 2, "max_ingredients": 2}, True), ({"times": {"prep": 3}}, {"min_prep_minutes": 5}, False),
    ({"nutrition": {"sodium": "9"}}, {"min_sodium": 5}, True), ({"nutrition": {"carbs": "9", "carbohydrates": "1"}}, {"min_carbs": 5}, True), ({"author": "Ann Lee"}, {"author": "lee"}, True),
    ({"instructions": ["Grill it"]}, {"cooking_method": ["grill"]}, True), ({"title": "Vegan pie"}, {"dietary": ["vegan"], "meal_type": ["pie"]}, True), ({"difficulty": "Very Easy"}, {"difficulty": ["easy"]}, True),
])
def test_filters(spark, values, settings, passes):
    df = spark.createDataFrame([recipe(**values)], recipes.SCHEMA)
    assert filters.apply_filters(df, settings).count() == passes


def test_filter_then_search_is_search_then_filter(index, table):
    some = table.filter("doc_id <> 3").select("doc_id")
    first = {r.doc_id: r.score for r in search.bm25_scores(index, "lemon onion", some).collect()}
    last = {r.doc_id: r.score for r in search.bm25_scores(index, "lemon onion").collect() if r.doc_id != 3}
    assert first == last


def test_metrics(spark):
    run = spark.createDataFrame([(1, i, d) for i, d in enumerate("abcde", 1)], "qid int, rank int, doc_id string")
    qrels = spark.createDataFrame([(1, "a", 2), (1, "c", 1), (1, "x", 2), (1, "d", 0)], "qid int, doc_id string, rel int")
    m = evaluate.evaluate(run, qrels, (5,)).first()
    assert [round(x, 6) for x in (m.p_5, m.r_5, m.ap, m.ndcg_5)] == [0.4, 0.666667, 0.555556, 0.649015]
    both = evaluate.with_macro(evaluate.evaluate(run, qrels, (5,))).collect()
    assert [r.qid for r in both] == ["1", "ALL"] and both[0].ap == both[1].ap


def test_engine(spark):
    engine = Engine.from_documents(spark, "/root/testdata/sf0.001/documents.parquet").cache()
    answer = engine.page("tion ther", page=2, per_page=5, settings={"max_total_minutes": 200})
    assert answer["total_pages"] == -(-answer["total"] // 5) and len(answer["results"]) <= 5
    assert [r["rank"] for r in answer["results"]] == list(range(6, 6 + len(answer["results"])))
    assert engine.stats().first().queries_processed == 1 and engine.cuisines().count() >= 2
    assert engine.recipe(3).count() == 1 and engine.health()["status"] == "healthy"
    with pytest.raises(ValueError, match="positive"):
        engine.search("x", k=0)


def test_stopwords_are_words():
    assert all(re.fullmatch("[a-z]+", w) for w in text.STOPWORDS)


def test_neighbours_and_turns_of_a_whole_table(spark):
    """As one sorted list tells them, whatever the partitions."""
    import random

    from larder.operators import crawl, facets

    r = random.Random(4)
    rows = [(i, r.randint(0, 10**6), r.choice(["a", "a", "b", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v long, s string").repartition(7)
    order = [k for k, v, _ in sorted(rows, key=lambda x: (-x[1], x[0]))]
    want = {k: (order[i - 1], order[(i + 1) % len(order)]) for i, k in enumerate(order)}
    assert {x.k: (x.prev_id, x.next_id) for x in facets.neighbours(df, "k", [F.desc("v"), "k"]).collect()} == want
    one = facets.neighbours(spark.createDataFrame([(7,)], "k long"), "k", ["k"]).first()
    assert (one.k, one.prev_id, one.next_id) == (7, 7, 7)
    assert facets.neighbours(df.limit(0), "k", ["k"]).count() == 0
    got = [(x.turn, x.s, x.k) for x in crawl.round_robin(df, "s", "k").collect()]
    turns = {}
    for k, _, s in rows:
        turns.setdefault(s, []).append(k)
    assert sorted(got, key=str) == sorted(((i + 1, s, k) for s, ks in turns.items() for i, k in enumerate(ks)), key=str)
    assert [t for t, _, _ in got] == sorted(t for t, _, _ in got)


def test_words_are_the_runs_that_are_terms(spark):
    """One pattern against splitting and testing, with letters beyond the basic plane beside words, digits, _ and entities."""
    import random

    from pyspark.sql import functions as F

    from larder.functions import text as x

    r = random.Random(3)
    pieces = ["ab", "Egg", "THE", "a", "é", "ß", "İ", "K", "_", "9", "٣", "Ⅷ", "𝒳", "😀", "́", " ", "-", "\n", "&amp;", "&", ";", "中", "zz"]
    texts = ["".join(r.choices(pieces, k=r.randint(0, 14))) for _ in range(1500)] + [None, "", "𝒳ab", "😀ab", "ab𝒳", "ab😀cd"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("t", F.filter(x.words(F.col("t")), lambda w: x.is_kept(w)).alias("a"), F.filter(x.runs(F.col("t")), lambda w: x.is_term(w)).alias("b")).collect()
    assert all(g.a == g.b for g in got), [g for g in got if g.a != g.b][:3]
    assert sum(len(g.a) for g in got) > 300


def test_terms_are_counted_where_their_text_is(spark):
    """No shuffle has a row for each term of a document; ids that repeat are one document."""
    from larder.operators.index import build_index, term_counts

    rows = [(1, "egg Pie", ["egg"], ["bake egg", "cool pie"]), (1, "egg", [], []), (2, "Pie", None, ["x pie"]), (None, "egg", [], []), (3, None, [], [])]
    recipes = spark.createDataFrame(rows, "doc_id long, title string, ingredients array<string>, instructions array<string>")
    counts, postings = term_counts(recipes), build_index(recipes).postings
    assert {tuple(c) for c in counts.collect()} == {("egg", 1, 4), ("pie", 2, 4), ("bake", 1, 1), ("cool", 1, 1)}
    assert {tuple(c) for c in postings.collect()} >= {("egg", "title", 1, 2), ("egg", "ingredients", 1, 1), ("pie", "instructions", 2, 1)}
    plan = term_counts(recipes)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc_id#" in plan and "hashpartitioning(term#" in plan and plan.count("Exchange hashpartitioning") == 2


def test_postings_of_ids_that_do_not_repeat_are_not_shuffled(spark):
    """A row's terms are counted in the row; only ids that repeat are added up. Both give what exploding and grouping gives."""
    import random

    from pyspark.sql import functions as F

    from larder.functions import text as x

    r = random.Random(5)
    pieces = ["egg ", "Egg", "pie ", "THE ", "é", "&amp;", "&", "K", "_", "9", "𝒳", " ", "-", "\n", "bake ", "zz "]
    make = lambda: "".join(r.choices(pieces, k=r.randint(0, 30)))
    rows = [(i, make() if i % 7 else None, [make(), None, make()] if i % 5 else None, [make()] * (i % 3)) for i in range(200)]
    schema = "doc_id long, title string, ingredients array<string>, instructions array<string>"
    more = [(i % 40 if i % 9 else None, *row[1:]) for i, row in enumerate(rows)]  # 0 to 39 repeat, also with themselves

    def plain(recipes):
        texts = F.array(*(F.struct(F.lit(f).alias("field"), (F.array_join(f, " ") if f != "title" else F.col(f)).alias("text")) for f in ("title", "ingredients", "instructions")))
        fields = recipes.filter("doc_id IS NOT NULL").select("doc_id", F.explode(texts).alias("f"))
        return fields.select("doc_id", "f.field", F.explode(x.tokenize(F.col("f.text"))).alias("term")).groupBy("term", "field", "doc_id").count()

    for given in (rows, rows + more):
        recipes = spark.createDataFrame(given, schema)
        index = build_index(recipes)
        got = index.postings
        held = [tuple(p) for p in got.collect()]
        assert len(held) == len(set(held)) > 500 and sorted(held) == sorted(map(tuple, plain(recipes).collect()))
        assert index.stats.first().avg_len * index.stats.first().n_docs == pytest.approx(sum(p[3] for p in held))
        ran = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "isFinalPlan=true" in ran and ("hashpartitioning(term#" in ran) == (given is not rows)
