"""Facts of pages and quotas against plain rules in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from larder.operators import crawl

#: page -> rating, review count, cuisine, difficulty
GOLDEN = {
    "": (None, None, None, None),
    "nothing here": (None, None, None, None),
    '"ratingValue": "4.5" "reviewCount":"12"': (4.5, 12, None, None),
    '"ratingValue": 4 "reviewCount": 0 and 17 Ratings': (4.0, 17, None, None),
    'Recipe rated 3 stars. 0 rating, 9 reviews "ratingValue": 1': (3.0, 9, None, None),
    'Recipe rated 3.5 star. 6 rating data-rating="1.2.3"': (3.5, 6, None, None),
    '"ratingValue": 4 data-rating="1.2.3"': (None, None, None, None),
    '"ratingValue": . Recipe rated 3.5 star. 6 rating': (None, None, None, None),
    '"ratingValue": 4 data-rating="2" rating": 3. stars\': .5': (0.5, 0, None, None),
    '"reviewCount": 5': (None, None, None, None),
    '"ratingValue": 0 44 reviews': (0.0, 0, None, None),
    '"recipeCuisine": " Tex-Mex! " Difficulty: simple as that': (None, None, "Tex-Mex", "easy"),
    'cuisine\': "Café_9" "recipeCuisine": "!!" Level: HARDLY': (None, None, "Café_9", "hard"),
    '"recipeCuisine": "' + "x" * 50 + '" Category: Soup <b>': (None, None, "Soup", None),
    '<span id="a" class="my cuisine">Ελλάδα</span> "difficulty": "' + "z" * 20 + '" data-difficulty="Z z"': (None, None, "Ελλάδα", "z z"),
    "some GARAM masala and pasta": (None, None, "italian", None),
    "jalapeño, wok": (None, None, "mexican", None),
    "quick, 15 min, moderate": (None, None, None, "easy"),
    "quick, 30 min": (None, None, None, "medium"),
    "quick, 2 hour": (None, None, None, None),
    "advanced, complex, easy": (None, None, None, "hard"),
    '"difficulty": "medium-hard"': (None, None, None, "medium"),
}


def test_golden_pages(spark):
    df = spark.createDataFrame([(i, h) for i, h in enumerate([*GOLDEN, None])], "page_id long, html string")
    got = {r.html: (r.rating, r.review_count, r.cuisine, r.difficulty) for r in crawl.page_facts(df).collect()}
    assert got == GOLDEN | {None: (None, None, None, None)}


def test_patterns_read_as_python_reads_them(spark):
    """First matches of every pattern on random scraps are those of Python's re."""
    r = random.Random(3)
    scraps = ['"ratingValue":', '"', "4.5", " ", "\n", "rating':", 'stars":', "cuisine", '"recipeCuisine": "', "x y", "<", "</span>", '<span class="a cuisine b">', "Level:", "Category:", "12 Reviews", "é", "'"]
    pages = ["".join(r.choices(scraps, k=12)) for _ in range(150)]
    patterns = [(p, False) for p in crawl.RATING_PATTERNS.values()] + [(p, True) for p in (*crawl.COUNT_PATTERNS, *crawl.CUISINE_PATTERNS, *crawl.DIFFICULTY_PATTERNS)]
    df = spark.createDataFrame([(p,) for p in pages], "h string").select("h", *(crawl._first(F.col("h"), p, any_case=c).alias(f"c{i}") for i, (p, c) in enumerate(patterns)))
    for row in df.collect():
        for i, (p, c) in enumerate(patterns):
            m = re.search(p, row.h, re.IGNORECASE if c else 0)
            assert row[f"c{i}"] == (m[1] if m else None), (p, row.h)


def folded(rows, quotas, target, other):
    counts, out = {}, []
    for row in rows:
        keys = [(c, row[c] if row[c] in t else other.get(c)) for c, t in quotas.items()]
        if len(out) < target and any(counts.get(k, 0) < quotas[k[0]].get(k[1], 0) for k in keys):
            out.append(row["seq"])
            for k in keys:
                counts[k] = counts.get(k, 0) + 1
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_quotas_in_portions(spark, parts, monkeypatch):
    monkeypatch.setattr(crawl, "FAN_IN", 3)
    r = random.Random(parts)
    rows = [{"seq": i, "a": r.choice(["p", "p", "p", "q", None, "z"]), "b": r.choice(["s", "t"]), "tags": [str(i)] if i % 3 else None} for i in range(800)]
    quotas, other = {"a": {"p": 20, "q": 7, "rest": 3}, "b": {"s": 11, "t": 30}}, {"a": "rest"}
    df = spark.createDataFrame(rows, "seq long, a string, b string, tags array<string>").repartition(parts)
    for target in (10, 45, 500):
        got = crawl.quota_sample(df, quotas, "seq", target, other).collect()
        assert [x.seq for x in got] == folded(rows, quotas, target, other)
        assert all(x.tags == rows[x.seq]["tags"] for x in got)
    assert crawl.quota_sample(df.limit(0), quotas, "seq", 5).count() == 0


def test_no_window_over_a_bucket(spark):
    df = spark.range(100).select(F.col("id").alias("seq"), F.lit("p").alias("a"))
    plan = crawl.quota_sample(df, {"a": {"p": 5}}, "seq", 5)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan


def test_selected_pages(spark):
    pages = spark.createDataFrame([(i, f"u{i}", h) for i, h in enumerate(list(GOLDEN) * 3)], "page_id long, url string, html string")
    kept = crawl.select_pages(pages, "page_id", quotas={"cuisine_bucket": {"other": 2}, "rating_bucket": {"excellent": 3, "very_good": 1}}).collect()
    assert [r.page_id for r in kept] == [2, 3, 2 + len(GOLDEN), 2 + 2 * len(GOLDEN)]
