"""Gazetteer matching, entity links and enrichment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.automaton import finder, first_ends
from ..functions.text import normalize_surface
from . import names
from .index import field_text
from .store import materialize

FIELDS = ("title", "ingredients", "instructions", "description")
#: Common ingredients as surface, wiki title, normalised name.
INGREDIENT_NAMES = (
    ("chicken", "Chicken", "chicken"), ("beef", "Beef", "beef"), ("pork", "Pork", "pork"), ("fish", "Fish", "fish"), ("salmon", "Salmon", "salmon"),
    ("turkey", "Turkey (bird)", "turkey"), ("lamb", "Lamb and mutton", "lamb"), ("shrimp", "Shrimp", "shrimp"), ("crab", "Crab", "crab"), ("lobster", "Lobster", "lobster"),
    ("onion", "Onion", "onion"), ("garlic", "Garlic", "garlic"), ("tomato", "Tomato", "tomato"), ("potato", "Potato", "potato"), ("carrot", "Carrot", "carrot"),
    ("celery", "Celery", "celery"), ("pepper", "Bell pepper", "bell pepper"), ("mushroom", "Mushroom", "mushroom"), ("spinach", "Spinach", "spinach"), ("lettuce", "Lettuce", "lettuce"),
    ("broccoli", "Broccoli", "broccoli"), ("cauliflower", "Cauliflower", "cauliflower"), ("cabbage", "Cabbage", "cabbage"), ("cucumber", "Cucumber", "cucumber"), ("zucchini", "Zucchini", "zucchini"),
    ("eggplant", "Eggplant", "eggplant"), ("asparagus", "Asparagus", "asparagus"), ("artichoke", "Artichoke", "artichoke"),
    ("apple", "Apple", "apple"), ("banana", "Banana", "banana"), ("orange", "Orange (fruit)", "orange"), ("lemon", "Lemon", "lemon"), ("lime", "Lime (fruit)", "lime"),
    ("strawberry", "Strawberry", "strawberry"), ("blueberry", "Blueberry", "blueberry"), ("raspberry", "Raspberry", "raspberry"), ("grape", "Grape", "grape"), ("cherry", "Cherry", "cherry"),
    ("peach", "Peach", "peach"), ("pear", "Pear", "pear"), ("plum", "Plum", "plum"), ("mango", "Mango", "mango"), ("pineapple", "Pineapple", "pineapple"),
    ("watermelon", "Watermelon", "watermelon"), ("cantaloupe", "Cantaloupe", "cantaloupe"),
    ("milk", "Milk", "milk"), ("cheese", "Cheese", "cheese"), ("butter", "Butter", "butter"), ("cream", "Cream", "cream"), ("yogurt", "Yogurt", "yogurt"),
    ("sour cream", "Sour cream", "sour cream"), ("cottage cheese", "Cottage cheese", "cottage cheese"), ("ricotta", "Ricotta", "ricotta"), ("mozzarella", "Mozzarella", "mozzarella"), ("cheddar", "Cheddar cheese", "cheddar cheese"),
    ("parmesan", "Parmesan cheese", "parmesan cheese"), ("feta", "Feta", "feta cheese"), ("goat cheese", "Goat cheese", "goat cheese"), ("blue cheese", "Blue cheese", "blue cheese"), ("swiss cheese", "Swiss cheese", "swiss cheese"),
    ("rice", "Rice", "rice"), ("pasta", "Pasta", "pasta"), ("bread", "Bread", "bread"), ("flour", "Flour", "flour"), ("oats", "Oat", "oats"),
    ("quinoa", "Quinoa", "quinoa"), ("barley", "Barley", "barley"), ("wheat", "Wheat", "wheat"), ("corn", "Maize", "corn"), ("potato", "Potato", "potato"),
    ("sweet potato", "Sweet potato", "sweet potato"), ("yam", "Yam (vegetable)", "yam"),
    ("almond", "Almond", "almond"), ("walnut", "Walnut", "walnut"), ("pecan", "Pecan", "pecan"), ("cashew", "Cashew", "cashew"), ("pistachio", "Pistachio", "pistachio"),
    ("hazelnut", "Hazelnut", "hazelnut"), ("peanut", "Peanut", "peanut"), ("sunflower seed", "Sunflower seed", "sunflower seed"), ("sesame seed", "Sesame", "sesame seed"), ("chia seed", "Chia seed", "chia seed"),
    ("flax seed", "Flax", "flax seed"),
    ("basil", "Basil", "basil"), ("oregano", "Oregano", "oregano"), ("thyme", "Thyme", "thyme"), ("rosemary", "Rosemary", "rosemary"), ("sage", "Sage", "sage"),
    ("parsley", "Parsley", "parsley"), ("cilantro", "Coriander", "cilantro"), ("dill", "Dill", "dill"), ("mint", "Mint", "mint"), ("chives", "Chives", "chives"),
    ("ginger", "Ginger", "ginger"), ("cinnamon", "Cinnamon", "cinnamon"), ("nutmeg", "Nutmeg", "nutmeg"), ("cloves", "Clove", "cloves"), ("cardamom", "Cardamom", "cardamom"),
    ("cumin", "Cumin", "cumin"), ("coriander", "Coriander", "coriander"), ("paprika", "Paprika", "paprika"), ("cayenne", "Cayenne pepper", "cayenne pepper"), ("black pepper", "Black pepper", "black pepper"),
    ("salt", "Salt", "salt"),
    ("olive oil", "Olive oil", "olive oil"), ("vegetable oil", "Vegetable oil", "vegetable oil"), ("canola oil", "Canola oil", "canola oil"), ("coconut oil", "Coconut oil", "coconut oil"), ("sesame oil", "Sesame oil", "sesame oil"),
    ("avocado oil", "Avocado oil", "avocado oil"), ("lard", "Lard", "lard"), ("shortening", "Shortening", "shortening"),
    ("bean", "Bean", "bean"), ("black bean", "Black bean", "black bean"), ("kidney bean", "Kidney bean", "kidney bean"), ("chickpea", "Chickpea", "chickpea"), ("lentil", "Lentil", "lentil"),
    ("soybean", "Soybean", "soybean"), ("pea", "Pea", "pea"), ("green bean", "Green bean", "green bean"),
    ("egg", "Egg (food)", "egg"), ("honey", "Honey", "honey"), ("sugar", "Sugar", "sugar"), ("brown sugar", "Brown sugar", "brown sugar"), ("maple syrup", "Maple syrup", "maple syrup"),
    ("vanilla", "Vanilla", "vanilla"), ("chocolate", "Chocolate", "chocolate"), ("cocoa", "Cocoa bean", "cocoa"), ("coffee", "Coffee", "coffee"), ("tea", "Tea", "tea"),
    ("vinegar", "Vinegar", "vinegar"), ("soy sauce", "Soy sauce", "soy sauce"), ("worcestershire sauce", "Worcestershire sauce", "worcestershire sauce"), ("ketchup", "Ketchup", "ketchup"), ("mustard", "Mustard (condiment)", "mustard"),
    ("mayonnaise", "Mayonnaise", "mayonnaise"), ("salsa", "Salsa (sauce)", "salsa"), ("pesto", "Pesto", "pesto"), ("hummus", "Hummus", "hummus"), ("tahini", "Tahini", "tahini"),
)


def build_gazetteer(given: DataFrame) -> DataFrame:
    """given (surface, wiki_title[, type], seq) -> (surface, wiki_title, type, norm): lower-cased, each
    with its plural in s unless it ends in one; of equal surfaces the last by seq."""
    kind = F.col("type") if "type" in given.columns else F.lit("ingredient")
    rows = given.select(F.lower(F.trim("surface")).alias("surface"), "wiki_title", kind.alias("type"), "seq")
    plural = rows.filter(~F.col("surface").endswith("s")).withColumn("surface", F.concat("surface", F.lit("s")))
    both = rows.unionByName(plural).groupBy("surface").agg(F.max_by(F.struct("wiki_title", "type"), "seq").alias("m"))
    return both.select("surface", "m.wiki_title", "m.type", normalize_surface(F.col("surface")).alias("norm"))


def by_norm(gazetteer: DataFrame, seq: str) -> DataFrame:
    """One row a normalised name: the first title and type, all its surfaces."""
    return gazetteer.groupBy("norm").agg(F.min_by(F.struct("wiki_title", "type"), seq).alias("m"), F.sort_array(F.collect_set("surface")).alias("variants")).select("norm", "m.wiki_title", "m.type", "variants")


SPANS = "array<struct<start:int,end:int,surface:string>>"


def spans(text: Column, known: Sequence[str], mode: str = "earliest", word_boundary: bool = False) -> Column:
    """array<struct<start, end, surface>> of names in the lower-cased text, 0-based, end exclusive,
    none overlapping: leftmost first, of those that begin together the one that ends first ('earliest')
    or last ('longest'). Any number of names: an automaton passes each text once."""
    known = sorted(set(known))

    @F.pandas_udf(SPANS)
    def found(texts):
        import pandas as pd

        find = finder(known, mode, word_boundary)
        return pd.Series([[{"start": a, "end": b, "surface": known[i]} for a, b, i in find(t)] for t in texts])

    return found(F.lower(F.coalesce(text, F.lit(""))))


def _dictionary(gazetteer: DataFrame, *columns: str) -> list:
    """The rows of a gazetteer: a stated dictionary, which the driver and each task hold."""
    return sorted(map(tuple, gazetteer.select(*columns).distinct().collect()), key=lambda r: tuple(x if isinstance(x, (str, list)) else "" for x in r[:2]))


#: Texts that a task holds as Python objects at once, with what is found in them.
PIECE = 200


def _pieces(batches):
    """The batches' rows in batches of at most PIECE."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            yield batch.slice(at, PIECE)


def link(recipes: DataFrame, gazetteer: DataFrame, id_col: str = "doc_id", mode: str = "earliest", word_boundary: bool = False, large: int = names.LARGE) -> DataFrame:
    """(doc_id, field, start, end, surface, wiki_title) of title, ingredients, instructions and description.

    Up to `large` surfaces are an automaton in each task; more are found by names.links, so that neither a task nor
    the driver holds the dictionary."""
    table = gazetteer.filter("surface <> ''").select("surface", "wiki_title").distinct()
    fields = [f for f in FIELDS if f in recipes.columns]
    if table.count() > large:
        return _link_large(recipes, table, id_col, fields, mode, word_boundary)
    rows = _dictionary(table, "surface", "wiki_title")
    known, titles = sorted({r[0] for r in rows}), {}
    for surface, title in rows:
        titles.setdefault(surface, []).append(title)

    def run(batches):
        import pyarrow as pa

        find = finder(known, mode, word_boundary)
        for batch in _pieces(batches):
            ids, out = [], []
            for doc, *texts in zip(*(c.to_pylist() for c in batch.columns)):
                new = [(f, a, b, known[i], title) for f, text in zip(fields, texts) for a, b, i in find(text) for title in titles[known[i]]]
                out += new
                ids += [doc] * len(new)
            cols = list(zip(*out)) if out else [()] * 5
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "field", "start", "end", "surface", "wiki_title"])

    kind = dict(recipes.dtypes)[id_col]
    return _texts(recipes, id_col, fields).mapInArrow(run, f"doc_id {kind}, field string, start int, end int, surface string, wiki_title string")


def _texts(recipes, id_col, fields) -> DataFrame:
    return recipes.select(F.col(id_col).alias("doc_id"), *(F.lower(field_text(recipes, f)).alias(f) for f in fields))


def _field(fields):
    return F.element_at(F.array(*map(F.lit, fields)), F.col("nth") + 1).alias("field")


def _link_large(recipes, table, id_col, fields, mode, word_boundary) -> DataFrame:
    found = names.links(_texts(recipes, id_col, fields), table.select(F.col("surface").alias("name")), mode, word_boundary)
    titled = names.places(found.join(table, F.col("name") == F.col("surface")))
    return titled.select("doc_id", _field(fields), "start", "end", "surface", "wiki_title")


def surface_counts(recipes: DataFrame, surfaces: DataFrame, id_col: str = "doc_id", mode: str = "earliest", word_boundary: bool = False) -> DataFrame:
    """(doc_id, field, surface, n): how often link() finds each surface of a dictionary that may grow with the data. Titles aren't asked
    for, so places needn't meet the dictionary: they are counted in their text."""
    fields = [f for f in FIELDS if f in recipes.columns]
    found = names.counts(_texts(recipes, id_col, fields), surfaces.select(F.col("surface").alias("name")), mode, word_boundary)
    return found.select("doc_id", _field(fields), F.col("name").alias("surface"), "n")


LINK = "struct<surface:string,wiki_title:string,type:string,norm:string,abstract:string,categories:array<string>>"


def enrich(recipes: DataFrame, gazetteer: DataFrame, entities: DataFrame | None = None, large: int = names.LARGE) -> DataFrame:
    """recipes with wiki_links: every name that a field holds anywhere, one link a wiki title, in the
    order title, ingredients, instructions, cuisine and of the names' first ends; an empty cuisine is
    filled from links of type cuisine. entities (title, abstract, categories) adds an abstract and
    at most five categories, in a join by title after matching. Up to `large` names are an automaton in
    each task, more are found by names.occurrences."""
    table = gazetteer.select("surface", "wiki_title", "type", "norm").filter("norm <> ''").distinct()
    fields = [f for f in ("title", "ingredients", "instructions", "cuisine") if f in recipes.columns]
    out = _links_large(recipes, table, fields) if table.count() > large else _links(recipes, table, fields)
    if entities is not None:
        out = _with_facts(out, entities)
    if "cuisine" in recipes.columns:
        told = F.transform(F.filter("wiki_links", lambda x: x["type"] == "cuisine"), lambda x: x["wiki_title"])
        out = out.withColumn("cuisine", F.when(F.size(F.coalesce("cuisine", F.array().cast("array<string>"))) == 0, told).otherwise(F.col("cuisine")))
    return out


def _links_large(recipes: DataFrame, table: DataFrame, fields: list[str]) -> DataFrame:
    rows = materialize(recipes.withColumn("__row", F.monotonically_increasing_id()))  # numbers stay if a task runs again
    texts = rows.select(F.col("__row").alias("doc_id"), *(F.lower(field_text(recipes, f)).alias(f) for f in fields))
    found = names.occurrences(texts, table.select(F.col("norm").alias("name")))
    first = found.groupBy("doc_id", "nth", "name").agg(F.min("end").alias("end"))
    texts = {c: F.coalesce(c, F.lit("")) for c in ("surface", "wiki_title", "type")}
    hits = first.join(table, F.col("name") == F.col("norm")).select("doc_id", "nth", "end", *(v.alias(c) for c, v in texts.items()), "norm")
    one = hits.groupBy("doc_id", "wiki_title").agg(F.min(F.struct("nth", "end", "surface", "type", "norm")).alias("m"))
    each = one.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("m.nth", "m.end", "m.surface", "wiki_title", "m.type", "m.norm"))).alias("l"))
    bare = F.transform("l", lambda x: F.struct(x["surface"].alias("surface"), x["wiki_title"].alias("wiki_title"), x["type"].alias("type"), x["norm"].alias("norm"), F.lit("").alias("abstract"), F.array().cast("array<string>").alias("categories")))
    links = each.select(F.col("doc_id").alias("__doc"), bare.cast(f"array<{LINK}>").alias("wiki_links"))
    out = rows.join(links, F.col("__row") == F.col("__doc"), "left").drop("__row", "__doc")
    return out.withColumn("wiki_links", F.coalesce("wiki_links", F.array().cast(f"array<{LINK}>")))


def _with_facts(out: DataFrame, entities: DataFrame) -> DataFrame:
    """wiki_links with the abstract and categories of their titles; of an entity that comes twice the smaller abstract."""
    info = entities.groupBy(F.col("title").alias("__title")).agg(F.min(F.struct(F.coalesce("abstract", F.lit("")).alias("a"), F.slice(F.coalesce("categories", F.array().cast("array<string>")), 1, 5).alias("c"))).alias("__f"))
    rows = materialize(out.withColumn("__row", F.monotonically_increasing_id()))
    each = rows.select("__row", F.posexplode("wiki_links").alias("__at", "__l")).join(info, F.col("__l.wiki_title") == F.col("__title"), "left")
    full = F.struct(*(F.col(f"__l.{c}").alias(c) for c in ("surface", "wiki_title", "type", "norm")), F.coalesce("__f.a", F.lit("")).alias("abstract"), F.coalesce("__f.c", F.array().cast("array<string>")).alias("categories"))
    links = each.groupBy(F.col("__row").alias("__doc")).agg(F.array_sort(F.collect_list(F.struct("__at", full.alias("l")))).alias("__links"))
    met = rows.drop("wiki_links").join(links, F.col("__row") == F.col("__doc"), "left")
    return met.withColumn("wiki_links", F.coalesce(F.transform("__links", lambda x: x["l"]), F.array().cast(f"array<{LINK}>"))).select(*out.columns)


def _links(recipes: DataFrame, table: DataFrame, fields: list[str]) -> DataFrame:
    known = _dictionary(table, "surface", "wiki_title", "type", "norm")
    norms, of = sorted({r[3] for r in known}), {}
    for r in known:
        of.setdefault(r[3], []).append(r)

    @F.arrow_udf(f"array<{LINK}>", F.ArrowUDFType.SCALAR_ITER)
    def links(batches):
        import pyarrow as pa

        find = first_ends(norms)
        names = ("surface", "wiki_title", "type", "norm", "abstract")
        kind = pa.list_(pa.struct([*((n, pa.string()) for n in names), ("categories", pa.list_(pa.string()))]))

        def of_row(row):
            found = [(o, end, g) for o, text in enumerate(row) for i, end in find(text).items() for g in of[norms[i]]]
            seen = {}
            for _, _, g in sorted(found, key=lambda x: (x[0], x[1], x[2][0] or "", x[2][1] or "")):
                seen.setdefault(g[1], {"surface": g[0] or "", "wiki_title": g[1] or "", "type": g[2] or "", "norm": g[3], "abstract": "", "categories": []})
            return list(seen.values())

        for texts in batches:
            texts = texts if isinstance(texts, tuple) else (texts,)  # one field comes by itself
            for at in range(0, len(texts[0]), PIECE):
                yield pa.array([of_row(row) for row in zip(*(t.slice(at, PIECE).to_pylist() for t in texts))], kind)

    return recipes.withColumn("wiki_links", links(*(F.lower(field_text(recipes, f)) for f in fields)))


def link_stats(enriched: DataFrame) -> DataFrame:
    """(type, links) of all recipes."""
    return enriched.select(F.explode("wiki_links").alias("l")).groupBy(F.col("l.type").alias("type")).agg(F.count(F.lit(1)).alias("links"))


def enrichment_stats(enriched: DataFrame) -> DataFrame:
    n = F.size("wiki_links")
    return enriched.agg(F.count(F.lit(1)).alias("recipes"), F.count_if(n > 0).alias("enriched"), F.sum(n).cast("long").alias("links"), F.avg(n).alias("mean_links"))


def grouped_links(enriched: DataFrame, id_col: str = "doc_id", n: int = 5) -> DataFrame:
    """(doc_id, type, wiki_title, place): at most n links of each type, in order."""
    rows = enriched.select(F.col(id_col).alias("doc_id"), F.posexplode("wiki_links").alias("at", "l")).select("doc_id", "at", "l.type", "l.wiki_title")
    from .facets import top_per_group

    return top_per_group(rows, ["doc_id", "type"], ["at"], n)


def literal_gazetteer(spark: SparkSession, pairs: Sequence[tuple[str, str, str]]) -> DataFrame:
    return build_gazetteer(spark.createDataFrame([(*p, i) for i, p in enumerate(pairs)], "surface string, wiki_title string, type string, seq int"))


def ingredient_gazetteer(spark: SparkSession) -> DataFrame:
    """INGREDIENT_NAMES and their plurals in s: (surface, wiki_title, type, norm), a plural with the norm of its name. Where a name and
    a plural are the same text, the later one in the list counts."""
    rows = {}
    for surface, title, norm in INGREDIENT_NAMES:
        rows[surface] = (title, norm)
        if not surface.endswith("s"):
            rows[surface + "s"] = (title, norm)
    return spark.createDataFrame([(k, t, "ingredient", n) for k, (t, n) in rows.items()], "surface string, wiki_title string, type string, norm string")
