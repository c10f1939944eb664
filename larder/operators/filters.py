"""Recipe filters: a dict of settings becomes one predicate that Catalyst can push down."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import literals, safe_double

def _list(value) -> list[str]:
    """A list as it is; a text cut at commas."""
    parts = value.split(",") if isinstance(value, str) else value
    return [str(v).strip() for v in parts if str(v).strip()]


class _Row:
    """Columns of a recipe table as filters see them: missing ones are empty."""

    def __init__(self, df: DataFrame):
        self.types = dict(df.dtypes)
        self.df = df

    def field(self, path: str) -> Column | None:
        top, _, below = path.partition(".")
        if top not in self.types:
            return None
        if below and below not in [f.name for f in getattr(self.df.schema[top].dataType, "fields", [])]:
            return None
        return F.col(path)

    def text(self, *paths: str) -> Column:
        """The first of the columns that isn't null, as text."""
        found = [c.cast("string") for p in paths if (c := self.field(p)) is not None]
        return F.coalesce(*found, F.lit(""))

    def array(self, path: str) -> Column:
        c = self.field(path)
        return F.array().cast("array<string>") if c is None else F.coalesce(c, F.array().cast("array<string>"))

    def lower(self, path: str) -> Column:
        return F.transform(self.array(path), F.lower)

    def number(self, *paths: str) -> Column:
        found = [c for p in paths if (c := self.field(p)) is not None]
        return safe_double(F.coalesce(*(c.cast("string") for c in found))) if found else F.lit(0.0)

    def joined(self, *paths: str) -> Column:
        parts = [F.array_join(self.array(p), " ") if self.types.get(p, "").startswith("array") else self.text(p) for p in paths]
        return F.lower(F.concat_ws(" ", *parts))


#: key -> column of a list that must hold one of the values, in any case
EXACT = {"cuisine": "cuisine", "ingredients": "ingredients", "category": "category", "tools": "tools", "required_tools": "tools"}
#: key -> columns whose joined text must hold one of the values
WITHIN = {
    "difficulty": ("difficulty",), "author": ("author",), "author_location": ("author_location",),
    "meal_type": ("title", "description", "keywords"), "dietary": ("title", "description", "keywords", "ingredients"),
    "cooking_method": ("title", "description", "instructions"),
}
#: key -> number: (columns, least-missing default is 0)
NUMBERS = {
    "total_minutes": ("times.total",), "prep_minutes": ("times.prep",), "cook_minutes": ("times.cook",),
    "rating": ("ratings.average", "ratings.rating", "ratings.score"), "calories": ("nutrition.calories",), "protein": ("nutrition.protein",),
    "carbs": ("nutrition.carbs", "nutrition.carbohydrates"), "fat": ("nutrition.fat",), "fiber": ("nutrition.fiber",), "sugar": ("nutrition.sugar",), "sodium": ("nutrition.sodium",),
}
SIZES = {"ingredients": "ingredients", "instructions": "instructions"}


def predicates(df: DataFrame, settings: dict) -> list[Column]:
    """One predicate a setting that is on; a setting is off if its value is empty, 0 or False."""
    row, out = _Row(df), []
    on = {k: v for k, v in settings.items() if v}
    for key, path in EXACT.items():
        if key in on:
            out.append(F.arrays_overlap(row.lower(path), literals(v.lower() for v in _list(on[key]))))
    for key, paths in WITHIN.items():
        if key in on:
            text = row.joined(*paths)
            out.append(reduce(or_, (text.contains(v.lower()) for v in _list(on[key]))))
    for key, paths in NUMBERS.items():
        if f"max_{key}" in on:
            out.append(row.number(*paths) <= float(on[f"max_{key}"]))
        if f"min_{key}" in on:
            out.append(row.number(*paths) >= float(on[f"min_{key}"]))
    if "min_review_count" in on:
        out.append(F.floor(row.number("ratings.review_count", "ratings.count")) >= int(on["min_review_count"]))
    for low, high in (("min_yield", "max_yield"), ("min_servings", "max_servings")):
        if low in on or high in on:
            text = row.text("yield")
            n = F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
            ok = F.lit(True)
            if low in on:
                ok = F.coalesce(n >= float(on[low]), F.lit(False))
            if high in on:
                ok = ok & F.coalesce(n <= float(on[high]), F.lit(True))
            out.append((text == "") | ok)
    for low, high in (("min_publication_date", "max_publication_date"), ("date_from", "date_to")):
        when = F.try_to_timestamp(F.nullif(row.text("publication_date", "date_published"), F.lit("")))
        if low in on:
            out.append(F.coalesce(when >= F.try_to_timestamp(F.lit(on[low])), F.lit(True)))
        if high in on:
            out.append(F.coalesce(when <= F.try_to_timestamp(F.lit(on[high])), F.lit(True)))
    if "has_image" in on:
        out.append(F.length(F.trim(row.text("image"))) > 0)
    if "keywords" in on:
        words, text = row.lower("keywords"), row.joined("title", "description")
        out.append(reduce(or_, (F.array_contains(words, v.lower()) | text.contains(v.lower()) for v in _list(on["keywords"]))))
    for key, path in SIZES.items():
        if f"min_{key}" in on:
            out.append(F.size(row.array(path)) >= int(on[f"min_{key}"]))
        if f"max_{key}" in on:
            out.append(F.size(row.array(path)) <= int(on[f"max_{key}"]))
    return out


def apply_filters(df: DataFrame, settings: dict) -> DataFrame:
    """Rows that pass all settings."""
    found = predicates(df, settings)
    return df.filter(reduce(and_, found)) if found else df


def apply_index_filters(df: DataFrame, settings: dict) -> DataFrame:
    """The boosted-field index's own filters: cuisine as written, total minutes by presence of the
    key (so 0 counts, and a minimum alone reaches to 10000), ingredient terms that all must occur."""
    from ..functions.text import tokenize_all

    row, out = _Row(df), []
    if settings.get("include_ingredients"):
        terms = tokenize_all(F.array_join(row.array("ingredients"), " "))
        for value in _list(settings["include_ingredients"]):
            for word in value.lower().split():
                out.append(F.array_contains(terms, word))
    if settings.get("cuisine"):
        out.append(F.arrays_overlap(row.array("cuisine"), literals(_list(settings["cuisine"]))))
    total = row.number("times.total")
    most = settings.get("max_total_minutes")
    if settings.get("min_total_minutes") is not None:
        out.append(total.between(float(settings["min_total_minutes"]), float(most or 10000)))
    elif most is not None:
        out.append(total.between(0.0, float(most)))
    return df.filter(reduce(and_, out)) if out else df
