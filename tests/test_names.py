"""Names of a large dictionary: what the automaton finds, found by joins."""

import random

import pytest
from pyspark.sql import functions as F

from larder.operators import entities, names

DOCS = "doc_id long, title string, ingredients array<string>, instructions array<string>, cuisine array<string>, extra string"
ALPHABET = "abcé 𝒳ß-"


def tables(spark, seed, n=60):
    r = random.Random(seed)
    text = lambda k: "".join(r.choices(ALPHABET, k=r.randint(0, k)))
    docs = [(i // 2, r.choice([None, text(30)]), [text(20), text(5)], [text(200)], r.choice([None, [], ["x"]]), "e") for i in range(n)] + [(99, "a" * 300, [], None, None, None), (None, "ab a", None, [], [], None)]
    known = {text(4) for _ in range(60)} | {text(12) for _ in range(40)} | {"a", "aa", "aaa", "𝒳", "nowhere to be found"}
    gaz = [(s, f"T{len(s)}{i % 3}", r.choice(["dish", "cuisine"]), s if i % 5 else "ab") for i, s in enumerate(sorted(known))] + [("ab", "second", "tool", "ab"), ("ab", "Ab", "cuisine", "ab")]
    return spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(gaz, "surface string, wiki_title string, type string, norm string")


@pytest.mark.parametrize("seed, mode, boundary, portion", [(0, "earliest", False, 1), (1, "longest", False, 1 << 20), (2, "longest", True, 300)])
def test_links_are_the_automatons(spark, monkeypatch, seed, mode, boundary, portion):
    monkeypatch.setattr(names, "PORTION", portion)
    docs, gaz = tables(spark, seed)
    rows = lambda large: sorted(map(str, entities.link(docs, gaz, mode=mode, word_boundary=boundary, large=large).collect()))
    assert rows(0) == rows(10_000) and len(rows(0)) > 50


def test_enrichment_is_the_automatons(spark):
    docs, gaz = tables(spark, 5)
    told = spark.createDataFrame([("T20", "about", list("abcdefg")), ("T31", None, None), ("T20", "zz", None), ("other", "x", [])], "title string, abstract string, categories array<string>")
    rows = lambda large, info: sorted((str(r) for r in entities.enrich(docs, gaz, info, large=large).collect()))
    for info in (None, told):
        assert rows(0, info) == rows(10_000, info)
    full = entities.enrich(docs, gaz, told, large=0)
    links = [x for r in full.collect() for x in r.wiki_links]
    assert any(x.abstract == "about" and x.categories == list("abcde") for x in links) and full.columns == [*docs.columns, "wiki_links"]


def test_every_occurrence(spark):
    texts = spark.createDataFrame([(1, "aaaa", None), (2, "", "xaax")], "doc_id long, f string, g string")
    known = spark.createDataFrame([("aa",), ("aaa",), ("",), ("zz",)], "name string")
    assert sorted(tuple(r) for r in names.occurrences(texts, known).collect()) == [(1, 0, 0, 2, "aa"), (1, 0, 0, 3, "aaa"), (1, 0, 1, 3, "aa"), (1, 0, 1, 4, "aaa"), (1, 0, 2, 4, "aa"), (2, 1, 1, 3, "aa")]
    assert names.occurrences(texts.limit(0), known).count() == 0 and names.occurrences(texts, known.limit(0)).count() == 0


def test_filter_lets_few_through(spark):
    """Texts without any of many names send hardly anything to the join."""
    known = spark.range(50_000).select(F.concat(F.lit("name"), F.col("id").cast("string")).alias("name"))
    texts = spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(200)), lambda i: F.concat(F.lit("word"), (F.col("id") * 1000 + i).cast("string")))).alias("f"))
    found = names.occurrences(texts.unionByName(spark.createDataFrame([(999, "xname77y")], "doc_id long, f string")), known)
    assert sorted((r.doc_id, r.name) for r in found.collect()) == [(999, "name7"), (999, "name77")]


def test_two_titles_of_many_surfaces(spark):
    """One surface with two titles among many: no scan of all rows for each."""
    gaz = spark.range(30_000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("surface"), F.lit("t").alias("wiki_title"))
    gaz = gaz.unionByName(spark.createDataFrame([("n5", "u")], "surface string, wiki_title string"))
    docs = spark.createDataFrame([(1, "n5 and n29999")], "doc_id long, title string")
    assert sorted((r.surface, r.wiki_title) for r in entities.link(docs, gaz, mode="longest").collect()) == [("n29999", "t"), ("n5", "t"), ("n5", "u")]


def test_kept_spans_across_batches():
    """Rows one by one and in batches of any size keep the same as a plain walk, whatever overlaps."""
    import random

    import pyarrow as pa

    from larder.operators import names

    r = random.Random(5)
    rows = sorted((d, f, a, a + r.randint(1, 6)) for d in (1, 2, 3) for f in (0, 1) for a in r.choices(range(60), k=40))
    want, last, at = [], None, 0
    for d, f, a, b in rows:
        at = at if (d, f) == last else 0
        last = (d, f)
        if a >= at:
            want.append((d, f, a, b))
            at = b
    columns = list(zip(*rows))
    for doc in (pa.array(columns[0]), pa.array([{"id": None, "row": d} for d in columns[0]], pa.struct([("id", pa.int64()), ("row", pa.int64())]))):
        whole = pa.RecordBatch.from_arrays([doc, *(pa.array(c, pa.int32()) for c in columns[1:])], names=["doc_id", "nth", "start", "end"])
        for size in (1, 3, 7, 1000):
            got = [tuple(x.values()) for b in names._kept(whole.slice(i, size) for i in range(0, len(rows), size)) for x in b.to_pylist()]
            assert [(d["row"] if isinstance(d, dict) else d, *x) for d, *x in got] == want


def test_pieces_lose_no_text(spark):
    """More texts in a batch than a task holds at once: all are enriched and linked."""
    import pyarrow as pa

    from larder.operators import entities

    n = 2 * entities.PIECE + 7
    pieces = list(entities._pieces([pa.RecordBatch.from_pydict({"a": list(range(n))})]))
    assert max(p.num_rows for p in pieces) == entities.PIECE and [x for p in pieces for x in p.column(0).to_pylist()] == list(range(n))
    rows = spark.range(n).selectExpr("id AS doc_id", "concat('salt ', id) AS title").coalesce(1)
    given = entities.literal_gazetteer(spark, [("salt", "Salt", "ingredient")])
    enriched = {r.doc_id: [x.wiki_title for x in r.wiki_links] for r in entities.enrich(rows, given).select("doc_id", "wiki_links").collect()}
    assert enriched == {i: ["Salt"] for i in range(n)}
    assert sorted(r.doc_id for r in entities.link(rows, given).select("doc_id").collect()) == list(range(n))


def shuffled(spark, run):
    """What run() gives, and how many rows were shuffled for it."""

    def total():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    return run(), total() - before


def test_places_of_grown_names_are_not_shuffled(spark, tmp_path):
    """Few different words, and texts that have them very often: no row a place is shuffled or kept on disk. Ids that repeat are added up."""
    from collections import Counter

    from larder.plans.names_plans import entity_links_grown

    r = random.Random(1)
    vocabulary = [f"word{i}" for i in range(40)] + ["né", "straße", "x_y", "no"]
    docs = [(i if i % 50 else 7, " ".join(r.choices(vocabulary, k=400)) + r.choice([" ", ".", ""])) for i in range(200)] + [(None, "word1 Word2"), (None, "word1,word3"), (500, None), (501, "")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    said = [(1, 0, "user", "word0 word1, WORD2 straße no x_y"), (1, 1, "bot", " ".join(vocabulary[4:30])), (2, 0, "user", None)]
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    known = {"word0", "word1", "word2", "straße", *vocabulary[4:30]}
    want = Counter((d, w) for d, t in docs for w in (t or "").lower().replace(",", " ").replace(".", " ").split() if w in known)
    got, rows = shuffled(spark, lambda: entity_links_grown(spark, str(tmp_path)).collect())
    assert {(x.doc_id, x.surface): x.n for x in got} == want and len(got) == len(want) and want[None, "word1"] == 2
    assert sum(want.values()) > 50_000 and rows < 5_000


@pytest.mark.parametrize("listed", [0, 200_000])
@pytest.mark.parametrize("mode, boundary", [("earliest", False), ("longest", True), ("earliest", True)])
def test_what_the_filter_lets_through_wrongly(spark, monkeypatch, listed, mode, boundary):
    """A filter that lets much through: whether that is listed or meets the dictionary in a join, links and counts are the automaton's."""
    monkeypatch.setattr(names, "SALTS", (1,))
    monkeypatch.setattr(names, "LISTED", listed)
    docs, gaz = tables(spark, 3)
    gaz = gaz.select("surface", F.col("surface").alias("wiki_title")).distinct()
    texts = docs.select("doc_id", F.lower(F.array_join("instructions", " ")))
    known = names._dictionary(gaz.select(F.col("surface").alias("name")))
    wrong = names._wrong(texts, known, names._filter_of(known), boundary)
    assert wrong is None if listed == 0 else len(wrong) > 5
    link = lambda large: entities.link(docs, gaz, mode=mode, word_boundary=boundary, large=large)
    assert sorted(map(str, link(0).collect())) == sorted(map(str, link(10_000).collect()))
    want = link(10_000).groupBy("doc_id", "field", "surface").agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(str, entities.surface_counts(docs, gaz, mode=mode, word_boundary=boundary).collect())) == sorted(map(str, want.collect()))


def test_inner_ends_of_names(spark):
    """Names of several words, and ones that begin or end with no word character, between word boundaries."""
    docs = spark.createDataFrame([(1, "a-b c d, -a b. (x) a--b"), (2, "b c"), (3, "-"), (4, "ab c-")], "doc_id long, title string")
    gaz = spark.createDataFrame([(s, s) for s in ("a", "b c", "-a", "b c d,", "c d, -a b. (x)", "(x)", "-", "a--b", ".", "c-", ", ", "nowhere")], "surface string, wiki_title string")
    for mode in ("earliest", "longest"):
        rows = lambda large: sorted(map(str, entities.link(docs, gaz, mode=mode, word_boundary=True, large=large).collect()))
        assert rows(0) == rows(100) and len(rows(0)) > 5


def test_places_of_a_name_meet_its_titles_together(spark):
    """Titles are joined to a row a name and portion of text, not to a row a place."""
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.expr("repeat('salt, pepper oil ', 100)").alias("title")).coalesce(2)
    gaz = spark.createDataFrame([("salt", "Salt"), ("salt", "Sodium chloride"), ("pepper oil", "Oil"), ("pepper", "Pepper")], "surface string, wiki_title string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, rows = shuffled(spark, lambda: entities.link(docs, gaz, mode="longest", word_boundary=True, large=0).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(map(str, got)) == sorted(map(str, entities.link(docs, gaz, mode="longest", word_boundary=True).collect()))
    assert len(got) == 30_000 and rows < 1_000
