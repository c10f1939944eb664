"""Boolean and phrase search against a plain evaluation in Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from larder.operators import boolean as b
from larder.operators.boolean import Bool, Phrase, Range, Term

SCHEMA = "doc_id long, title string, ingredients array<string>, instructions array<string>, cuisine array<string>, times struct<total:int, prep:int>, url string"


def recipes(seed=0, n=40):
    r = random.Random(seed)
    text = lambda m: " ".join(r.choices("a b c d Éa".split(), k=r.randint(0, m)))
    rows = [(i, text(4), [text(3), text(2)], [text(30)], r.choice([[], ["x"], ["x", "Y"]]), (r.randint(0, 90), 0), f"u{i}") for i in range(n)]
    long = (n, "a", ["a b"], [" ".join(r.choices("ab", k=400))], ["x"], (5, 3), "u")
    return [*rows, long, (n + 1, None, None, None, None, None, None), (None, "a b", ["a"], ["a b"], ["x"], (1, 1), "no id")]


def words(text):
    return [t for t in text.lower().split() if t]


class Plain:
    def __init__(self, rows):
        self.docs = {}
        for i, title, ing, ins, cuisine, times, _ in rows:
            if i is not None:
                self.docs[i] = ({"title": words(title or ""), "ingredients": words(" ".join(ing or [])), "instructions": words(" ".join(ins or [])), "cuisine_kw": cuisine or []}, times[0] if times else 0)

    def part(self, field, count, doc, idf):
        toks = self.docs[doc][0][field]
        lens = [len(d[field]) for d, _ in self.docs.values() if d[field]]
        return idf * count / (count + 1.2 * (0.25 + 0.75 * len(toks) / (sum(lens) / len(lens))))

    def idf(self, field, term):
        n, df = sum(bool(d[field]) for d, _ in self.docs.values()), sum(term in d[field] for d, _ in self.docs.values())
        return math.log(1 + (n - df + 0.5) / (df + 0.5))

    def score(self, node, doc):
        """None without a match."""
        fields, total = self.docs[doc]
        if isinstance(node, Term):
            n = fields.get(node.field, []).count(node.text)
            n = min(n, 1) if node.field == "cuisine_kw" else n
            return node.boost * self.part(node.field, n, doc, self.idf(node.field, node.text)) if n else None
        if isinstance(node, Phrase):
            t, m = fields[node.field], len(node.terms)
            n = sum(tuple(t[i : i + m]) == node.terms for i in range(len(t)))
            return node.boost * self.part(node.field, n, doc, sum(self.idf(node.field, x) for x in node.terms)) if n else None
        if isinstance(node, Range):
            return 1.0 if node.low <= total <= node.high else None
        must, should = [self.score(c, doc) for c in node.must], [s for c in node.should if (s := self.score(c, doc)) is not None]
        if None in must or any(self.score(c, doc) is None for c in node.filters) or any(self.score(c, doc) is not None for c in node.without) or len(should) < node.needed:
            return None
        return sum(must) + sum(should)

    def all(self, tree):
        return {d: round(s, 6) for d in self.docs if (s := self.score(tree, d)) is not None}


def random_tree(r, depth=0):
    kind = r.choice(["term", "term", "phrase", "range", "bool", "bool"]) if 0 < depth < 3 else "bool" if not depth else r.choice(["term", "phrase", "range"])
    field = r.choice(["title", "ingredients", "instructions"])
    if kind == "term":
        return r.choice([Term(field, r.choice("abcdz"), r.choice([1.0, 2.0])), Term("cuisine_kw", r.choice(["x", "Y", "y"]))])
    if kind == "phrase":
        return Phrase(field, tuple(r.choices("abc", k=r.randint(2, 3))))
    if kind == "range":
        return Range("total_minutes", r.randint(0, 40), r.randint(30, 90))
    some = lambda n: tuple(random_tree(r, depth + 1) for _ in range(r.randint(0, n)))
    return Bool(must=some(2), should=some(3), without=some(1), filters=some(1), least=r.choice([None, None, 0, 2]))


@pytest.fixture(scope="module")
def index(spark):
    ix = b.build_positional_index(spark.createDataFrame(recipes(), SCHEMA).repartition(3))
    ix.postings, ix.fields, ix.docs = ix.postings.cache(), ix.fields.cache(), ix.docs.cache()
    return ix


@pytest.mark.parametrize("seed", range(6))
def test_trees(index, seed):
    tree = random_tree(random.Random(seed))
    got = {x.doc_id: round(x.score, 6) for x in b.scored(index, tree).collect()}
    assert got == pytest.approx(Plain(recipes()).all(tree), abs=2e-6)


def test_an_index_of_the_asked_terms_scores_like_the_whole(spark, index):
    tree = Bool(should=(Term("title", "a"), Phrase("instructions", ("a", "b", "a")), Term("cuisine_kw", "x")), without=(Term("ingredients", "d"),))
    few = b.build_positional_index(spark.createDataFrame(recipes(), SCHEMA).repartition(3), only=b.asked_terms(tree))
    assert b.asked_terms(tree) == ["a", "b", "d", "x"] and {r.term for r in few.postings.select("term").distinct().collect()} == {"a", "b", "d", "x"}
    assert sorted(few.fields.collect()) == sorted(index.fields.collect())
    assert b.scored(few, tree).orderBy("doc_id").collect() == b.scored(index, tree).orderBy("doc_id").collect()


def test_more_slots_than_a_mask_holds(index):
    each = tuple(Bool(must=(Term(f, t, float(i)),)) for i, (f, t) in enumerate([(f, t) for f in ("title", "ingredients", "instructions") for t in "abcd"] * 6))
    tree = Bool(should=each, least=20)
    got = {x.doc_id: round(x.score, 6) for x in b.scored(index, tree).collect()}
    assert got == pytest.approx(Plain(recipes()).all(tree), abs=2e-6) and got


def test_positions_round_trip(spark):
    lists = [sorted(random.Random(n).sample(range(5000), n)) for n in (1, 2, 63, 64, 65, 129, 700)]
    df = spark.createDataFrame([(x,) for x in lists], "p array<int>").select("p", b.decode_positions(b.encode_positions(F.col("p"))).alias("q"), F.size(b.encode_positions(F.col("p"))).alias("runs"))
    for r in df.collect():
        assert r.p == r.q and r.runs == -(-len(r.p) // 64)


def test_ingredients_change_the_ranking(index):
    """What settings ask for adds to the score: it isn't only a filter."""
    plain = [(r.doc_id, r.score) for r in b.search(index, b.settings_clause("a b", {}), 5).collect()]
    asked = [(r.doc_id, r.score) for r in b.search(index, b.settings_clause("a b", {"include_ingredients": '"c d", a', "cuisine": "x, Y", "max_total_minutes": 90}), 5).collect()]
    want = Plain(recipes()).all(b.settings_clause("a b", {"include_ingredients": '"c d", a', "cuisine": "x, Y", "max_total_minutes": 90}))
    assert [d for d, _ in asked] == sorted(want, key=lambda d: (-want[d], d))[:5] and asked != plain
    assert b.settings_clause("", {}) is None and b.search(index, None).count() == 0


def test_text_clauses():
    assert b.text_clause("title", 'red "hot Chili" x') == Bool(should=(Term("title", "red"), Phrase("title", ("hot", "chili")), Term("title", "x")))
    assert b.text_clause("title", '"one"') == Bool(should=(Term("title", "one"),)) and b.text_clause("title", " - ") is None


def test_write_load_and_hits(spark, index, tmp_path):
    index.write(str(tmp_path), buckets=2)
    again = b.PositionalIndex.load(spark, str(tmp_path))
    tree = b.settings_clause("a b", {"include_ingredients": '"a b"'})
    assert b.scored(again, tree).orderBy("doc_id").collect() == b.scored(index, tree).orderBy("doc_id").collect()
    rows = b.hits(again, b.search(again, tree, 50)).collect()
    raw = {x[0]: x for x in recipes()}
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows
    for r in rows:
        x = raw[int(r.docId)]
        assert (r.title, r.title_text, r.ingredients, r.cuisine) == (x[1].strip(), x[1].strip(), " ".join(x[2]), ", ".join(x[4]))
        assert r.total_minutes == (x[5][0] or None) and r.url == x[6] and r.description == "" and r.prep_minutes == (str(x[5][1]) if x[5][1] else "")


def test_empty_index(spark):
    ix = b.build_positional_index(spark.createDataFrame([], SCHEMA))
    assert b.scored(ix, Bool(should=(Term("title", "a"), Phrase("title", ("a", "b"))))).count() == 0
