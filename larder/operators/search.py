"""Ranked search over an index: BM25 and TF-IDF, filtered, paged and in batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import literals, py_tokenize, snippet, tokenize_all
from .index import BOOSTS, FIELDS, FieldIndex, Index

#: Field weights and constants of the fielded scores.
WEIGHTS = {"title": 3.0, "ingredients": 2.0, "instructions": 1.0}
K1, B = 1.2, 0.75


def _weight(field="field"):
    out = F.lit(1.0)
    for name, w in WEIGHTS.items():
        out = F.when(F.col(field) == name, F.lit(w)).otherwise(out)
    return out


def _length():
    out = F.lit(0)
    for name in FIELDS:
        out = F.when(F.col("field") == name, F.col(f"len_{name}")).otherwise(out)
    return out


def _ranked(score):
    """Nine decimals, so that equal scores don't hang on the order in which their parts were added."""
    return F.round(score, 9).alias("score")


def _hits(index: Index, terms: Sequence[str], allowed: DataFrame | None) -> DataFrame:
    """Postings of the query's terms with idf, cut to the allowed documents before anything is scored."""
    postings = index.postings.filter(F.col("term").isin(*terms))
    if allowed is not None:
        postings = postings.join(allowed.select("doc_id"), "doc_id", "left_semi")
    return postings.join(index.terms.filter(F.col("term").isin(*terms)).select("term", "idf"), "term")


def _bm25_part():
    tf = F.col("tf")
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * _length() / F.col("avg_len"))) * F.col("idf") * _weight()


def impacts(index: Index) -> DataFrame:
    """What each (term, document) adds to BM25, to the dot product of TF-IDF and to its squared norm:
    with these a query is a filter and one sum."""
    rows = index.postings.join(index.terms.select("term", "idf"), "term")
    rows = rows.join(index.docmeta.select("doc_id", *(f"len_{f}" for f in FIELDS)), "doc_id").crossJoin(F.broadcast(index.stats.select("avg_len")))
    d = F.col("tf") * F.col("idf") * _weight()
    return rows.groupBy("term", "doc_id").agg(F.sum(_bm25_part()).alias("bm25"), F.sum(d * F.col("idf")).alias("dot"), F.sum(d * d).alias("square"))


def _impacts_of(index: Index, terms: Sequence[str], allowed: DataFrame | None) -> DataFrame:
    rows = index.impacts.filter(F.col("term").isin(*terms))
    return rows if allowed is None else rows.join(allowed.select("doc_id"), "doc_id", "left_semi")


def bm25_scores(index: Index, query: str, allowed: DataFrame | None = None) -> DataFrame:
    """(doc_id, score): per posting tf (k1 + 1) / (tf + k1 (1 - b + b len_field / avg_len)) idf weight,
    with the average of the documents' whole lengths; a term counts once however often it is asked."""
    terms = sorted(set(py_tokenize(query, index.stopwords)))
    if not terms:
        return index.docmeta.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    if index.impacts is not None:
        return _impacts_of(index, terms, allowed).groupBy("doc_id").agg(_ranked(F.sum("bm25")))
    rows = _hits(index, terms, allowed).join(index.docmeta.select("doc_id", *(f"len_{f}" for f in FIELDS)), "doc_id").crossJoin(F.broadcast(index.stats.select("avg_len")))
    return rows.groupBy("doc_id").agg(_ranked(F.sum(_bm25_part())))


def tfidf_scores(index: Index, query: str, allowed: DataFrame | None = None) -> DataFrame:
    """(doc_id, score): per field the cosine of the query's and the document's tf-idf over the query's
    terms alone, added up over fields (so up to the square root of their number)."""
    asked = Counter(py_tokenize(query, index.stopwords))
    if not asked:
        return index.docmeta.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    terms = sorted(asked)
    times = F.lit(0)
    for t in terms:
        times = F.when(F.col("term") == t, F.lit(asked[t])).otherwise(times)
    own = index.terms.filter(F.col("term").isin(*terms))
    norm = own.agg(F.sqrt(F.sum(F.pow(times * F.col("idf"), 2))).alias("q_norm"))
    if index.impacts is not None:
        sums = _impacts_of(index, terms, allowed).groupBy("doc_id").agg(F.sum(times * F.col("dot")).alias("dot"), F.sqrt(F.sum("square")).alias("d_norm"))
        sums = sums.crossJoin(F.broadcast(norm)).filter("d_norm > 0 and q_norm > 0")
        return sums.select("doc_id", _ranked(F.col("dot") / (F.col("d_norm") * F.col("q_norm"))))
    rows = _hits(index, terms, allowed).withColumn("q", times * F.col("idf")).withColumn("d", F.col("tf") * F.col("idf") * _weight())
    sums = rows.groupBy("doc_id").agg(F.sum(F.col("q") * F.col("d")).alias("dot"), F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("d_norm"))
    sums = sums.crossJoin(F.broadcast(norm)).filter("d_norm > 0 and q_norm > 0")
    return sums.select("doc_id", _ranked(F.col("dot") / (F.col("d_norm") * F.col("q_norm"))))


SCORES = {"bm25": bm25_scores, "tfidf": tfidf_scores}


def search(index: Index, query: str, metric: str = "bm25", k: int = 10, allowed: DataFrame | None = None, offset: int = 0) -> DataFrame:
    """Hits offset+1 .. offset+k: rank, doc_id, score, snippet; ties by doc_id. A query without terms
    lists the allowed documents with score 1, or nothing if there is no filter. Titles are looked up
    after the cut."""
    terms = py_tokenize(query, index.stopwords)
    if not terms:
        if allowed is None:
            scored = index.docmeta.select("doc_id", F.lit(0.0).alias("score")).limit(0)
        else:
            scored = allowed.select("doc_id", F.lit(1.0).alias("score"))
    else:
        scored = SCORES[metric](index, query, allowed)
    top = scored.orderBy(F.desc("score"), "doc_id").offset(offset).limit(k) if offset else scored.orderBy(F.desc("score"), "doc_id").limit(k)
    # at most k rows, numbered in one place
    top = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "doc_id")) + offset)
    out = F.broadcast(top).join(index.docmeta.select("doc_id", "title"), "doc_id", "left") if not terms else index.docmeta.select("doc_id", "title").join(F.broadcast(top), "doc_id")
    return out.select("rank", "doc_id", "score", snippet(F.col("title"), F.col("doc_id"), list(dict.fromkeys(terms))).alias("snippet"))


def count_hits(index: Index, query: str, allowed: DataFrame | None = None) -> DataFrame:
    """One row: total, the documents that hold one of the query's terms."""
    terms = sorted(set(py_tokenize(query, index.stopwords)))
    if not terms:
        return (allowed if allowed is not None else index.docmeta.limit(0)).agg(F.count(F.lit(1)).alias("total"))
    return _hits(index, terms, allowed).agg(F.countDistinct("doc_id").alias("total"))


def page_numbers(total: int, page: int, per_page: int) -> dict[str, int]:
    return {"offset": (page - 1) * per_page, "total_pages": -(-total // per_page)}


def search_batch(index: Index, queries: DataFrame, k: int = 10, stop=None) -> DataFrame:
    """queries (qid, query) -> (qid, rank, doc_id, score), BM25, all queries in one job.

    Query terms are the small side of the join; the top k of each query is cut by a window that
    Spark limits before the shuffle (window group limit)."""
    from ..functions.text import tokenize

    asked = queries.select("qid", F.explode(F.array_distinct(tokenize(F.col("query"), stop or index.stopwords))).alias("term"))
    rows = index.postings.join(asked, "term").join(index.terms.select("term", "idf"), "term")
    rows = rows.join(index.docmeta.select("doc_id", *(f"len_{f}" for f in FIELDS)), "doc_id").crossJoin(F.broadcast(index.stats.select("avg_len")))
    scored = rows.groupBy("qid", "doc_id").agg(_ranked(F.sum(_bm25_part())))
    w = W.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("qid", "rank", "doc_id", "score")


def field_search(index: FieldIndex, query: str, k: int = 10, similarity: str = "bm25", allowed: DataFrame | None = None) -> DataFrame:
    """Boosted four-field search: 'bm25' with each field's own average length and
    idf = ln(1 + (N - df + 0.5) / (df + 0.5)), or 'classic' (sqrt(tf) idf^2 / sqrt(len))."""
    import regex

    terms = sorted({t for t in regex.split(r"[^\p{L}\p{N}]+", query.lower()) if t})
    if not terms:
        return index.docs.select(F.lit(0).alias("rank"), "doc_id", F.lit(0.0).alias("score")).limit(0)
    own = index.postings.filter(F.array_contains(literals(terms), F.col("term")) if len(terms) > 50 else F.col("term").isin(*terms))
    df = own.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))
    if allowed is not None:
        own = own.join(allowed.select("doc_id"), "doc_id", "left_semi")
    rows = own.join(df, ["term", "field"]).join(F.broadcast(index.fields), "field")
    boost = F.lit(1.0)
    for name, w in BOOSTS.items():
        boost = F.when(F.col("field") == name, F.lit(w)).otherwise(boost)
    tf, n, d = F.col("tf"), F.col("n_docs"), F.col("df")
    if similarity == "bm25":
        part = F.ln(1 + (n - d + 0.5) / (d + 0.5)) * tf / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    else:
        part = F.sqrt(tf) * F.pow(1 + F.ln((n + 1) / (d + 1)), 2) / F.sqrt("len")
    scored = rows.groupBy("doc_id").agg(_ranked(F.sum(part * boost))).orderBy(F.desc("score"), "doc_id").limit(k)
    return scored.select(F.row_number().over(W.orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", "score")


__all__ = ["bm25_scores", "count_hits", "field_search", "page_numbers", "search", "search_batch", "tfidf_scores", "tokenize_all"]
