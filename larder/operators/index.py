"""Fielded inverted index: terms, postings and document lengths as tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, ends_of_equal, is_kept, runs_all, words
from .store import by_own_ids

FIELDS = ("title", "ingredients", "instructions")


@dataclass
class Index:
    """postings (term, field, doc_id, tf); docmeta (doc_id, title, len_<field>..., len_total);
    terms (term, df, idf); stats (n_docs, avg_len), one row."""

    postings: DataFrame
    docmeta: DataFrame
    terms: DataFrame
    stats: DataFrame
    stopwords: Sequence[str] = STOPWORDS
    #: (term, doc_id, bm25, dot, square): what a term adds to a document's scores, whatever the query.
    impacts: DataFrame | None = None

    def with_impacts(self) -> Index:
        from .search import impacts

        return replace(self, impacts=impacts(self))

    def write(self, path: str, buckets: int = 64, impacts: bool = True) -> None:
        """Parquet tables; postings are dealt by term and sorted, so that a query's terms read few row groups. impacts make
        each query cheaper and the index dearer."""
        self.postings.repartition(buckets, "term").sortWithinPartitions("term", "field", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        for name in ("docmeta", "terms", "stats"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        if not impacts:
            return
        full = self if self.impacts is not None else self.with_impacts()
        full.impacts.repartition(buckets, "term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/impacts")

    @classmethod
    def load(cls, spark: SparkSession, path: str, stopwords: Sequence[str] = STOPWORDS) -> Index:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        held = root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(root, "impacts"))
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "docmeta", "terms", "stats")), stopwords, spark.read.parquet(f"{path}/impacts") if held else None)

    def export_tsv(self, path: str) -> None:
        """terms, postings and docmeta as sorted tab-separated files with a header; idf with six decimals."""
        write = lambda df, name: df.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").csv(f"{path}/{name}")
        write(self.terms.orderBy("term").select("term", "df", F.format_string("%.6f", "idf").alias("idf")), "terms")
        write(self.postings.orderBy("term", "doc_id", "field").select("term", "field", F.col("doc_id").alias("docId"), "tf"), "postings")
        plain = F.translate(F.coalesce("title", F.lit("")), "\t\n\r", "   ")
        write(self.docmeta.orderBy("doc_id").select(F.col("doc_id").alias("docId"), plain.alias("title"), *(f"len_{f}" for f in FIELDS)), "docmeta")


def load_tsv(spark: SparkSession, path: str, stopwords: Sequence[str] = STOPWORDS) -> Index:
    """An exported index; rows that don't fit the schema are skipped, postings of unknown terms dropped."""
    read = lambda name, schema: spark.read.option("sep", "\t").option("header", True).option("mode", "DROPMALFORMED").option("quote", "").schema(schema).csv(f"{path}/{name}")
    terms = read("terms", "term string, df long, idf double")
    postings = read("postings", "term string, field string, docId long, tf long").withColumnRenamed("docId", "doc_id").join(terms, "term", "left_semi")
    docmeta = read("docmeta", "docId long, title string, len_title int, len_ingredients int, len_instructions int").withColumnRenamed("docId", "doc_id")
    docmeta = docmeta.withColumn("len_total", sum((F.col(f"len_{f}") for f in FIELDS), F.lit(0)))
    return Index(postings, docmeta, terms, _stats(docmeta), stopwords)


def _fields(rows: DataFrame, id_col: str, texts: dict) -> DataFrame:
    """(doc_id, f: (field, text)): a row for each field of each row with an id."""
    pairs = F.array(*(F.struct(F.lit(f).alias("field"), text.alias("text")) for f, text in texts.items()))
    return rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.explode(pairs).alias("f"))


def _exploded(rows: DataFrame, id_col: str, texts: dict, split) -> DataFrame:
    """(doc_id, field, run): a row for each run of each field's text, so that what follows is compiled code."""
    return _fields(rows, id_col, texts).select("doc_id", F.col("f.field").alias("field"), F.explode(split(F.col("f.text"))).alias("term"))


def _row_counts(recipes: DataFrame, id_col: str, stopwords: Sequence[str]) -> DataFrame:
    """(doc_id, field, term, tf): each row's terms, counted in the row: its words are sorted, and where equal ones end tells how many
    there are. So no table of counts grows with the rows. Rows whose ids repeat are not added up."""
    once = lambda array: F.explode(F.array(array))  # noqa: E731  made once a row, however often it's read
    rows = _fields(recipes, id_col, {f: field_text(recipes, f) for f in FIELDS})
    rows = rows.select("doc_id", F.col("f.field").alias("field"), once(F.sort_array(words(F.col("f.text")))).alias("words"))
    rows = rows.select("doc_id", "field", "words", once(ends_of_equal(F.col("words"))).alias("ends"))
    # one start more than ends: its term is null and isn't kept
    columns = F.arrays_zip(F.transform("ends", lambda end: F.get("words", end - 1)), "ends", F.concat(F.array(F.lit(0)), "ends"))
    counts = rows.select("doc_id", "field", F.inline(columns)).toDF("doc_id", "field", "term", "end", "start")
    return counts.select("doc_id", "field", "term", (F.col("end") - F.col("start")).cast("long").alias("tf")).filter(is_kept(F.col("term"), stopwords))


def _postings(recipes: DataFrame, id_col: str, stopwords: Sequence[str]) -> DataFrame:
    """(term, field, doc_id, tf). The counts of a row whose id is its own are postings already: only its text is dealt, so that tasks are
    even however the rows are stored. Rows with the hash of an id that repeats are added up by term, field and document."""
    rows = recipes.select(id_col, *FIELDS).filter(F.col(id_col).isNotNull())
    own, shared = by_own_ids(rows, id_col)
    own = own.repartition(int(recipes.sparkSession.conf.get("spark.sql.shuffle.partitions")), id_col)
    added = _row_counts(shared, id_col, stopwords).groupBy("term", "field", "doc_id").agg(F.sum("tf").alias("tf"))
    return _row_counts(own, id_col, stopwords).select("term", "field", "doc_id", "tf").unionByName(added)


def _stats(docmeta: DataFrame) -> DataFrame:
    return docmeta.agg(F.count(F.lit(1)).alias("n_docs"), (F.sum("len_total") / F.count(F.lit(1))).alias("avg_len"))


def field_text(recipes: DataFrame, field: str):
    kind = dict(recipes.dtypes)[field]
    return F.array_join(F.coalesce(field, F.array().cast("array<string>")), " ") if kind.startswith("array") else F.coalesce(F.col(field), F.lit(""))


def term_counts(recipes: DataFrame, id_col: str = "doc_id", stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """(term, docs, n): each term's documents and occurrences, over all fields. Rows are dealt by document, so that what is counted by
    term and document is counted where the text is; only a task's sums by term are shuffled."""
    dealt = recipes.select(id_col, *FIELDS).repartition(id_col)
    terms = _exploded(dealt, id_col, {f: field_text(recipes, f) for f in FIELDS}, words).filter(is_kept(F.col("term"), stopwords))
    each = terms.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("n"))


def build_index(recipes: DataFrame, id_col: str = "doc_id", stopwords: Sequence[str] = STOPWORDS, df_mode: str = "field", keep=None, only: DataFrame | Sequence[str] | None = None) -> Index:
    """Index rows with an id and at least one term.

    df counts the (field, document) pairs of a term (df_mode 'field'), or its documents ('doc');
    idf = ln(documents / df), six decimals, so it may be negative. All terms are counted in their row, asked
    ones where they are partly counted before a shuffle by (term, field, document).
    keep: what to do with the postings before the rest is derived from them, such as to materialize them.
    only: terms (a list, or a column `term` without repeats) that will be asked. The index has the postings of these, and the
    lengths and statistics of all texts: other terms count together, so a document is a few rows from the start.
    """
    terms = _exploded(recipes, id_col, {f: field_text(recipes, f) for f in FIELDS}, words).filter(is_kept(F.col("term"), stopwords))
    if isinstance(only, DataFrame):
        terms = terms.join(only.select(F.col("term").alias("__asked")), F.col("term") == F.col("__asked"), "left").select("doc_id", "field", F.col("__asked").alias("term"))
    elif only is not None:
        terms = terms.withColumn("term", F.when(F.col("term").isin(*only), F.col("term")))
    counts = _postings(recipes, id_col, stopwords) if only is None else terms.groupBy("term", "field", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    counts = keep(counts) if keep else counts
    postings = counts if only is None else counts.filter(F.col("term").isNotNull())
    each = counts if keep else terms.withColumn("tf", F.lit(1))  # what isn't kept would be counted and shuffled again for its sums
    lens = each.groupBy("doc_id").agg(*(F.sum(F.when(F.col("field") == f, F.col("tf")).otherwise(0)).cast("int").alias(f"len_{f}") for f in FIELDS), F.sum("tf").cast("int").alias("len_total"))
    stats = _stats(lens)
    titles = recipes.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), "title")
    docmeta = titles.join(lens, "doc_id")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")) if df_mode == "field" else postings.groupBy("term").agg(F.countDistinct("doc_id").alias("df"))
    # one row of statistics
    terms = df.crossJoin(F.broadcast(stats.select("n_docs"))).select("term", "df", F.round(F.ln(F.col("n_docs") / F.col("df")), 6).alias("idf"))
    return Index(postings, docmeta, terms, stats, stopwords)


#: The boosted-field index: weight of each field, default constants of BM25.
BOOSTS = {"title": 2.0, "ingredients": 1.5, "instructions": 1.0, "wiki": 1.0}


@dataclass
class FieldIndex:
    """postings (term, field, doc_id, tf, len); fields (field, n_docs, avg_len); docs (doc_id)."""

    postings: DataFrame
    fields: DataFrame
    docs: DataFrame

    def write(self, path: str, buckets: int = 64) -> None:
        """Parquet tables; postings are dealt by term and sorted, so that a query's terms read few row groups."""
        self.postings.repartition(buckets, "term").sortWithinPartitions("term", "field", "doc_id").write.mode("overwrite").parquet(f"{path}/field_postings")
        self.fields.write.mode("overwrite").parquet(f"{path}/fields")
        self.docs.write.mode("overwrite").parquet(f"{path}/field_docs")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FieldIndex:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("field_postings", "fields", "field_docs")))


def detect_index_type(spark: SparkSession, path: str) -> str:
    """What kind of index a folder holds: 'field' (boosted fields), 'index' (tables), 'tsv' (an export), or 'none'."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    has = lambda name: store.exists(spark._jvm.org.apache.hadoop.fs.Path(root, name))
    if has("field_postings"):
        return "field"
    if not has("postings"):
        return "none"
    return "index" if has("stats") else "tsv"


def build_field_index(recipes: DataFrame, id_col: str = "doc_id") -> FieldIndex:
    """Terms of four fields with each field's own length; `wiki` joins the abstracts of the links."""
    abstracts = F.array_join(F.filter(F.transform("wiki_links", lambda x: x["abstract"]), lambda a: F.coalesce(a, F.lit("")) != ""), " ") if "wiki_links" in recipes.columns else F.lit("")
    rows = recipes.filter(F.col(id_col).isNotNull()).withColumn("wiki", abstracts)
    terms = _exploded(rows, id_col, {f: field_text(rows, f) for f in BOOSTS}, runs_all).filter("term <> ''")
    counts = terms.groupBy("term", "field", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    lens = counts.groupBy("doc_id", "field").agg(F.sum("tf").cast("int").alias("len"))
    fields = lens.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    return FieldIndex(counts.join(lens, ["doc_id", "field"]).select("term", "field", "doc_id", "tf", "len"), fields, rows.select(F.col(id_col).alias("doc_id")))


def keep_last(recipes: DataFrame, id_col: str, seq: str) -> DataFrame:
    """One row an id: the last by seq."""
    w = W.partitionBy(id_col).orderBy(F.desc(seq))
    return recipes.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
