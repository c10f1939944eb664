"""Boolean and phrase search: a clause tree over an index with positions, keywords, numbers and stored fields."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalize_lines, tokenize_all
from .index import BOOSTS, field_text

K1, B = 1.2, 0.75
#: Positions that share a base: decoding one adds so many deltas at most.
RUN = 64


# -- the tree --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Term:
    """Documents whose field has the term, or one of whose keywords it is; scores by BM25."""

    field: str
    text: str
    boost: float = 1.0


@dataclass(frozen=True)
class Phrase:
    """Documents whose field has the terms side by side in this order; scores by BM25 of the phrase's frequency,
    with the sum of the terms' idf."""

    field: str
    terms: tuple[str, ...]
    boost: float = 1.0


@dataclass(frozen=True)
class Range:
    """Documents whose stored number is in [low, high]; scores 1."""

    column: str
    low: float
    high: float


@dataclass(frozen=True)
class Bool:
    """All of must and filters, none of without, and at least `least` of should: by default 1 if there is
    neither must nor filter, else 0. Its score is the sum over what matches of must and should."""

    must: Sequence = ()
    should: Sequence = ()
    without: Sequence = ()
    filters: Sequence = ()
    least: int | None = None

    @property
    def needed(self) -> int:
        return self.least if self.least is not None else int(not self.must and not self.filters)


def text_clause(name: str, text: str, boost: float = 1.0):
    """A text asked in one field: quoted parts are phrases, other words terms, any of which will do; None without words."""
    parts = []
    for i, part in enumerate(text.split('"')):
        words = _words(part)
        if i % 2 and len(words) > 1:
            parts.append(Phrase(name, tuple(words), boost))
        else:
            parts += [Term(name, w, boost) for w in words]
    return Bool(should=tuple(parts)) if parts else None


def _words(text: str) -> list[str]:
    import regex

    return [t for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t]


def query_clause(text: str, boosts: dict[str, float] | None = None):
    """A query over all text fields, each with its boost. Words that repeat count each time."""
    own = [c for name, boost in (boosts or BOOSTS).items() if (c := text_clause(name, text, boost))]
    return Bool(should=tuple(leaf for c in own for leaf in c.should)) if own else None


def settings_clause(query: str, settings: dict, boosts: dict[str, float] | None = None):
    """A query with settings: every ingredient (a text asked in the ingredients), one of the cuisines as they are
    written, and the minutes must match, and all of them add to the score. A maximum holds from 0, a minimum alone up to 10,000."""
    parts = lambda v: [x.strip() for x in (v.split(",") if isinstance(v, str) else v or ()) if x and x.strip()]
    must = [c for c in (query_clause(query, boosts), *(text_clause("ingredients", v) for v in parts(settings.get("include_ingredients")))) if c]
    if cuisines := parts(settings.get("cuisine")):
        must.append(Bool(should=tuple(Term("cuisine_kw", c) for c in cuisines)))
    low, high = settings.get("min_total_minutes"), settings.get("max_total_minutes")
    if high is not None:
        must.append(Range("total_minutes", 0, int(high)))
    if low is not None:
        must.append(Range("total_minutes", int(low), int(high) if high is not None else 10_000))
    return Bool(must=tuple(must)) if must else None


# -- the index -------------------------------------------------------------------------------------


def encode_positions(positions: Column) -> Column:
    """Ascending positions -> runs of RUN: (base, deltas to the one before)."""
    n = F.size(positions)
    at = lambda i: F.element_at(positions, i)

    def run(r):
        first = r * RUN + 1
        more = F.least(F.lit(RUN), n - r * RUN) - 1
        deltas = F.transform(F.slice(positions, first + 1, more), lambda p, i: p - at((first + i).cast("int")))
        return F.struct(at(first.cast("int")).alias("base"), deltas.alias("deltas"))

    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / RUN).cast("int")), run)


def decode_positions(runs: Column) -> Column:
    def plain(r):
        added = F.transform(r["deltas"], lambda d, i: r["base"] + F.aggregate(F.slice(r["deltas"], 1, i + 1), F.lit(0), lambda a, x: a + x))
        return F.concat(F.array(r["base"]), added)

    return F.flatten(F.transform(runs, plain))


@dataclass
class PositionalIndex:
    """postings (term, field, doc_id, tf, len, positions), keywords among them (without positions, tf 1);
    fields (field, n_docs, avg_len); docs (doc_id, total_minutes, and what hits show)."""

    postings: DataFrame
    fields: DataFrame
    docs: DataFrame

    def write(self, path: str, buckets: int = 64) -> None:
        """Parquet tables; postings are dealt by term and sorted, so that a query's terms read few row groups."""
        self.postings.repartition(buckets, "term").sortWithinPartitions("term", "field", "doc_id").write.mode("overwrite").parquet(f"{path}/positional_postings")
        self.fields.write.mode("overwrite").parquet(f"{path}/positional_fields")
        self.docs.write.mode("overwrite").parquet(f"{path}/stored")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PositionalIndex:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("positional_postings", "positional_fields", "stored")))


#: Columns that hits show as they are, and lists that they show joined.
SHOWN = ("url", "description", "author", "date_published", "difficulty", "serving_size", "yield")
LISTS = ("category", "tools", "cuisine")
OBJECTS = ("nutrition", "ratings")


def stored_fields(recipes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, total_minutes, ...): what the index keeps of a recipe. Missing columns are empty texts, lists are joined,
    objects are JSON or an empty text, minutes of 0 an empty text but for the total."""
    types = dict(recipes.dtypes)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in types else F.lit("")
    listed = lambda c: F.array_join(F.filter(F.transform(c, lambda v: F.trim(v)), lambda v: v != ""), ", ") if types.get(c, "").startswith("array") else text(c)
    minutes = lambda c: F.coalesce(F.nullif(F.col(f"times.{c}").cast("string"), F.lit("0")), F.lit("")) if f"{c}:" in types.get("times", "") else F.lit("")
    total = F.coalesce(F.col("times.total").cast("int"), F.lit(0)) if "total:" in types.get("times", "") else F.lit(0)
    links = F.coalesce("wiki_links", F.array().cast(types["wiki_links"])) if "wiki_links" in types else F.array().cast("array<string>")
    return recipes.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), total.alias("total_minutes"), *(text(c).alias(c) for c in SHOWN), *(F.coalesce(listed(c), F.lit("")).alias(c) for c in LISTS),
        *((F.coalesce(F.when(F.to_json(c) != "{}", F.to_json(c)), F.lit("")) if c in types else F.lit("")).alias(c) for c in OBJECTS),
        minutes("prep").alias("prep_minutes"), minutes("cook").alias("cook_minutes"), F.trim(text("title")).alias("title_text"),
        *((F.coalesce(field_text(recipes, c), F.lit("")) if c in types else F.lit("")).alias(f"{c}_text") for c in ("ingredients", "instructions")), _abstracts(recipes).alias("wiki_abstracts"), links.alias("wiki_links"),
    )


def _abstracts(recipes: DataFrame) -> Column:
    if "wiki_links" not in recipes.columns:
        return F.lit("")
    return F.coalesce(F.array_join(F.filter(F.transform("wiki_links", lambda x: x["abstract"]), lambda a: F.coalesce(a, F.lit("")) != ""), " "), F.lit(""))


def asked_terms(tree) -> list[str]:
    """The terms whose postings a tree reads."""
    if isinstance(tree, Bool):
        return sorted({t for part in (tree.must, tree.should, tree.without, tree.filters) for c in part for t in asked_terms(c)})
    return sorted(set(tree.terms)) if isinstance(tree, Phrase) else [tree.text] if isinstance(tree, Term) else []


def build_positional_index(recipes: DataFrame, id_col: str = "doc_id", only: Sequence[str] | None = None, keep=None) -> PositionalIndex:
    """Terms of the text fields with their positions, whole ingredients and cuisines as keywords, total minutes as a number.

    Texts are read once: a row for each occurrence carries its field's length, and one shuffle by (term, field,
    document) gathers the positions of one term in one field of one document.
    only: terms that will be asked, such as asked_terms(tree). The index has the postings of these, and the lengths
    and statistics of all texts: a text keeps its first place for its length. keep: what to do with the postings before
    the rest is derived from them, such as to materialize them.
    """
    asked = lambda df: df if only is None else df.withColumn("term", F.when(F.col("term").isin(*only), F.col("term"))).filter(F.col("term").isNotNull() | (F.col("pos") == 0))
    rows = recipes.filter(F.col(id_col).isNotNull()).withColumn("wiki", _abstracts(recipes))
    types = dict(rows.dtypes)
    texts = F.array(*(F.struct(F.lit(f).alias("field"), tokenize_all(field_text(rows, f) if f in types else F.lit("")).alias("t")) for f in BOOSTS))
    each = rows.select(F.col(id_col).alias("doc_id"), F.explode(texts).alias("f"))
    each = each.select("doc_id", F.col("f.field").alias("field"), F.size("f.t").alias("len"), F.posexplode("f.t").alias("pos", "term"))
    postings = asked(each).groupBy("term", "field", "doc_id").agg(F.count(F.lit(1)).alias("tf"), F.max("len").alias("len"), F.sort_array(F.collect_list("pos")).alias("p"))
    postings = postings.select("term", "field", "doc_id", "tf", "len", encode_positions(F.col("p")).alias("positions"))
    values = {"cuisine_kw": F.filter(F.transform("cuisine", lambda c: F.trim(c)), lambda c: c != "") if "cuisine" in types else None, "ingredients_kw": normalize_lines(F.col("ingredients")) if "ingredients" in types else None}
    words = [F.struct(F.lit(f).alias("field"), v.alias("t")) for f, v in values.items() if v is not None]
    if words:
        kept = rows.select(F.col(id_col).alias("doc_id"), F.explode(F.array(*words)).alias("f"))
        kept = kept.select(F.posexplode(F.array_distinct("f.t")).alias("pos", "term"), F.col("f.field").alias("field"), "doc_id", F.lit(1).cast("long").alias("tf"), F.size("f.t").alias("len"))
        postings = postings.unionByName(asked(kept).drop("pos"), allowMissingColumns=True)
    postings = keep(postings) if keep else postings
    lens = postings.groupBy("field", "doc_id").agg(F.max("len").alias("len"))
    fields = lens.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    return PositionalIndex(postings if only is None else postings.filter(F.col("term").isNotNull()), fields, stored_fields(recipes, id_col))


# -- evaluation ------------------------------------------------------------------------------------


class _Slots:
    """Leaves of a tree that read postings. Terms that stand side by side in a should of which one is enough share a slot:
    the slot matches with any and scores the sum."""

    def __init__(self):
        self.terms: list[tuple[int, str, str, float]] = []
        self.phrases: list[tuple[int, Phrase]] = []
        self.count = 0

    def take(self, leaves) -> int:
        slot, self.count = self.count, self.count + 1
        for x in leaves:
            if isinstance(x, Phrase):
                self.phrases.append((slot, x))
            else:
                self.terms.append((slot, x.field, x.text, float(x.boost)))
        return slot


def _compile(node, slots: _Slots):
    """(match, score, can): Columns over the grouped row, and whether the node can match a document without any posting."""
    if isinstance(node, (Term, Phrase)):
        return _slot(slots.take([node]))
    if isinstance(node, Range):
        ok = F.coalesce(F.col(node.column).between(node.low, node.high), F.lit(False))
        return ok, F.when(ok, 1.0).otherwise(0.0), True
    should = list(node.should)
    if node.needed <= 1:
        leaves = [c for c in should if isinstance(c, (Term, Phrase))]
        should = [c for c in should if not isinstance(c, (Term, Phrase))]
        joint = [_slot(slots.take(leaves))] if leaves else []
    else:
        joint = []
    must, filters, without = ([_compile(c, slots) for c in part] for part in (node.must, node.filters, node.without))
    any_of = joint + [_compile(c, slots) for c in should]
    ok = reduce(lambda a, b: a & b, [m for m, _, _ in must + filters] + [~m for m, _, _ in without], F.lit(True))
    if node.needed == 1:
        ok = ok & reduce(lambda a, b: a | b, (m for m, _, _ in any_of), F.lit(False))
    elif node.needed > 1:
        ok = ok & (sum((m.cast("int") for m, _, _ in any_of), F.lit(0)) >= node.needed)
    score = sum((s for _, s, _ in must + any_of), F.lit(0.0))
    can = all(c for _, _, c in must + filters) and sum(c for _, _, c in any_of) >= node.needed
    return ok, F.when(ok, score).otherwise(0.0), can


def _slot(i: int):
    ok = F.coalesce(F.col(f"mask{i // 62}"), F.lit(0)).bitwiseAND(F.lit(1 << i % 62)) != 0
    return ok, F.coalesce(F.col(f"score{i}"), F.lit(0.0)), False


def _idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def _saturated(tf: Column) -> Column:
    return tf / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))


def _minus(positions: Column, n: int) -> Column:
    return F.transform(positions, lambda p: p - n)


def phrase_hits(index: PositionalIndex, phrase: Phrase) -> DataFrame:
    """(doc_id, freq, len): how often the phrase is in its field. Each place of the phrase shifts its term's positions to
    where the phrase would begin; what all places share is where it is."""
    places: dict[str, list[int]] = {}
    for i, t in enumerate(phrase.terms):
        places.setdefault(t, []).append(i)
    own = index.postings.filter((F.col("field") == phrase.field) & F.col("term").isin(*places))
    starts = F.lit(None)
    for t, at in places.items():
        here = decode_positions(F.col("positions"))
        shifted = reduce(F.array_intersect, (_minus(here, i) for i in at))
        starts = F.when(F.col("term") == t, shifted).otherwise(starts)
    # a document has as many rows here as the phrase has different terms
    met = own.groupBy("doc_id").agg(F.max("len").alias("len"), F.collect_list(starts).alias("s")).filter(F.size("s") == len(places))
    shared = F.aggregate(F.slice("s", 2, len(places)), F.element_at("s", 1), lambda a, b: F.array_intersect(a, b))
    return met.select("doc_id", F.size(shared).alias("freq"), "len").filter("freq > 0")


def scored(index: PositionalIndex, tree) -> DataFrame:
    """(doc_id, score) of what the tree matches: one grouped sum over the postings of its terms, with a bit for each
    slot that a document satisfies; the tree is a boolean expression of the bits and numbers, its score one of the slots' sums."""
    slots = _Slots()
    match, score, can = _compile(tree, slots)
    spark = index.postings.sparkSession
    parts = []
    wanted = sorted({t for _, _, t, _ in slots.terms} | {t for _, p in slots.phrases for t in p.terms})
    fields = F.broadcast(index.fields)  # a row for each field of the index
    if wanted:
        own = index.postings.filter(F.col("term").isin(*wanted))
        df = own.groupBy("term", "field").agg(F.count(F.lit(1)).alias("df"))  # as many rows as the query has terms
        if slots.terms:
            asked = spark.createDataFrame(slots.terms, "slot int, field string, term string, boost double")
            asked = asked.groupBy("slot", "field", "term").agg(F.sum("boost").alias("boost"))
            rows = own.join(F.broadcast(asked), ["term", "field"]).join(F.broadcast(df), ["term", "field"]).join(fields, "field")
            parts.append(rows.select("doc_id", "slot", (F.col("boost") * _idf(F.col("n_docs"), F.col("df")) * _saturated(F.col("tf"))).alias("part")))
        for slot, phrase in slots.phrases:
            times = spark.createDataFrame([(t,) for t in phrase.terms], "term string")
            idf = times.join(df.filter(F.col("field") == phrase.field), "term").join(fields, "field").agg(F.sum(_idf(F.col("n_docs"), F.col("df"))).alias("idf"))
            rows = phrase_hits(index, phrase).crossJoin(F.broadcast(idf)).crossJoin(F.broadcast(index.fields.filter(F.col("field") == phrase.field)))  # one row each
            parts.append(rows.select("doc_id", F.lit(slot).alias("slot"), (phrase.boost * F.col("idf") * _saturated(F.col("freq"))).alias("part")))
    docs = index.docs.select("doc_id", "total_minutes", *sorted(_numbers(tree) - {"total_minutes"}))
    if parts:
        rows = reduce(DataFrame.unionByName, parts)
        bit = lambda j: F.expr(f"if(slot div 62 = {j}, shiftleft(1L, slot % 62), 0L)")
        masks = [F.bit_or(bit(j)).alias(f"mask{j}") for j in range(-(-slots.count // 62))]
        sums = [F.sum(F.when(F.col("slot") == i, F.col("part"))).alias(f"score{i}") for i in range(slots.count)]
        grouped = rows.groupBy("doc_id").agg(*masks, *sums)
        grouped = docs.join(grouped, "doc_id", "left") if can else grouped.join(docs, "doc_id") if _numbers(tree) else grouped
    else:
        grouped = docs if can else docs.limit(0)
    return grouped.filter(match).select("doc_id", F.round(score, 9).alias("score"))


def _numbers(node) -> set[str]:
    if isinstance(node, Range):
        return {node.column}
    if isinstance(node, Bool):
        return set().union(*(_numbers(c) for part in (node.must, node.should, node.without, node.filters) for c in part))
    return set()


def search(index: PositionalIndex, tree, k: int = 10) -> DataFrame:
    """(rank, doc_id, score) of the k best, ties by id; nothing for an empty tree."""
    found = scored(index, tree) if tree is not None else index.docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    top = found.orderBy(F.desc("score"), "doc_id").limit(k)
    return top.select(F.row_number().over(W.orderBy(F.desc("score"), "doc_id")).alias("rank"), "doc_id", "score")  # k rows


def hits(index: PositionalIndex, top: DataFrame) -> DataFrame:
    """top (rank, doc_id, score) with all that is stored, under each name that callers use; a total of 0 minutes is null."""
    rows = index.docs.join(F.broadcast(top), "doc_id")  # k rows
    minutes = F.when(F.col("total_minutes") != 0, F.col("total_minutes"))
    names = {"title": "title_text", "ingredients": "ingredients_text", "instructions": "instructions_text"}
    return rows.select(
        "rank", "score", F.col("doc_id").cast("string").alias("docId"), *SHOWN, *LISTS, *OBJECTS, *(F.col(v).alias(k) for k, v in names.items()), *names.values(), "wiki_abstracts",
        minutes.alias("total_minutes"), "prep_minutes", "cook_minutes", "wiki_links",
    ).orderBy("rank")

