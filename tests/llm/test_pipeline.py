"""The pipeline's stages take effect and agree with brute force."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    from larder.llm import decontamination, jaccard, packing, toxicity
    from test_llm import brute_groups, lower

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    scores = {r.doc_id: r.score for r in toxicity.score_documents(docs, labels).collect()}
    kept = [i for i in sorted(rows) if scores[i] < toxicity.THRESHOLD]
    first = {}
    for i in kept:
        first.setdefault(lower(rows[i]), i)
    kept = sorted(first.values())
    groups = brute_groups([rows[i] for i in kept], 5, 80, 100)
    kept = [i for n, i in enumerate(kept) if groups[n][1] == n]
    items = [decontamination.normalise(r.text) for r in bench.collect()]
    leaks = {i for i in kept if any(x in decontamination.normalise(rows[i]) for x in items)}
    stage = docs
    counts = {}
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, SF)
        assert stage.columns == docs.columns
        stage = jaccard.materialize(stage)
        counts[name] = stage.count()
    left = {r.doc_id for r in stage.collect()}
    assert left <= set(kept) - leaks and len(left) >= len(set(kept) - leaks) - 2  # edited leaks may go too
    assert counts["toxicity"] > counts["exact_dedup"] >= counts["jaccard_join"] >= counts["decontamination"] > 0.5 * len(rows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, stage, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == left
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == left
    assert packing.PIECE.split(", ")[0] == "doc_id long" and corpus_pipeline.ORACLE_SQL is None


def test_stages_on_odd_rows(spark):
    """Nulls, empty and very long texts, ties, repeated rows and clashing names: no text is lost, no row stays twice."""
    import random

    r = random.Random(9)
    long = " ".join(f"w{r.randint(0, 10**6)}" for _ in range(30000))
    near = [f"n{i}" for i in range(60)]
    rows = [(None, None), (1, None), (1, ""), (2, " "), (3, long), (3, long), (4, "One text, of some words"), (5, "ONE text, of some words"), (5, "one more text under that id"), (None, "no id at all here"), (None, "no id at all here"), (6, " ".join(near)), (7, " ".join([*near[:59], "x"])), (7, "seven's other text")]
    names = "doc_id long, text string, id string, key string, n int, class string, score string, __larder_9 string, start string"
    docs = spark.createDataFrame([(*x, "i", "k", 1, "c", "s", "l", "t") for x in rows], names).repartition(5)
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, SF)
        assert stage.columns == docs.columns
        assert f(spark, docs.limit(0), SF).count() == 0
    left = [(x.doc_id, x.text) for x in stage.collect()]
    assert sorted((str(i), (t or "")[:9]) for i, t in left) == [("1", ""), ("2", " "), ("3", long[:9]), ("4", "One text,"), ("5", "one more "), ("6", "n0 n1 n2 "), ("7", "seven's o"), ("None", "no id at ")]
    pieces = corpus_pipeline.STAGES[-1][1](spark, stage, SF).collect()
    assert {p.doc_id for p in pieces} == {1, 2, 3, 4, 5, 6, 7, None} and sum(p.length for p in pieces if p.doc_id == 3) > 30000
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_queries_are_registered(spark):
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [n for n in range(1, 11) if any(q.startswith(f"op{n}_") for q in names)] == list(range(1, 11)) and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
