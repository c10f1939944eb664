"""Text functions, Column to Column: tokenizer, snippets, cleaning, slugs, durations, ingredients."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default stop words; pass another list where a corpus or a comparison needs one.
STOPWORDS = tuple(sorted(set("""
a about above after again all also am an and any are as at be because been before being below between both but by can could did do
does doing down during each few for from further had has have having he her here hers him his how i if in into is it its just me
more most my no nor not now of off on once only or other our out over own same she should so some such than that the their them then
there these they this those through to too under until up very was we were what when where which while who whom why will with would you your
add cut get keep make put serve set take use
""".split())))  # fmt: skip

ENTITY, SPLIT, WORD = "&[a-zA-Z0-9#]+;", r"[^\p{L}\p{N}_]+", "^[a-z]+$"


def literals(values: Iterable[str]) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast("array<string>")


def runs(text: Column) -> Column:
    """Lower-cased runs of letters, digits and _; entities count as white space."""
    return F.split(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), ENTITY, " ")), SPLIT)


def is_term(run: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Whether a run is an index term: ASCII letters only, more than one, no stop word (a hash lookup)."""
    return (F.length(run) > 1) & run.rlike(WORD) & ~run.isin(*stopwords)


#: A run that is a word (the group), else the whole run: each match begins where a run does.
ASCII_WORD = r"([a-z]{2,}+)(?![\p{L}\p{N}_])|[\p{L}\p{N}_]++"


def words(text: Column) -> Column:
    """The runs of a text that are two or more ASCII letters, in order, and an empty string for each other run: one pass of one
    pattern tells what `runs` and the pattern of `is_term` do."""
    text = F.coalesce(text, F.lit(""))
    plain = F.when(text.contains("&"), F.regexp_replace(text, ENTITY, " ")).otherwise(text)  # most texts have no entity
    return F.regexp_extract_all(F.lower(plain), F.lit(ASCII_WORD), F.lit(1))


def is_kept(word: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Whether one of `words` is an index term (a hash lookup)."""
    return (word != "") & ~word.isin(*stopwords)


def ends_of_equal(values: Column) -> Column:
    """Where each stretch of equal values of an array ends, counted from 1."""
    return F.array_compact(F.transform(values, lambda v, i: F.when(F.coalesce(F.get(values, i + 1) != v, F.lit(True)), i + 1)))


def tokenize(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Index terms of a text, in order. A null text has none. For whole tables it's faster to explode
    `words` and filter by `is_kept`."""
    return F.filter(runs(text), lambda t: is_term(t, stopwords))


def runs_all(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")


def tokenize_all(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, digits kept: the analyzer of the boosted-field index."""
    return F.filter(runs_all(text), lambda t: t != "")


def py_tokenize(text: str, stopwords: Sequence[str] = STOPWORDS) -> list[str]:
    """tokenize() of a query, on the driver."""
    import regex

    runs = regex.split(r"[^\p{L}\p{N}_]+", regex.sub(ENTITY, " ", text or "").lower())
    stop = set(stopwords)
    return [t for t in runs if re.fullmatch("[a-z]+", t) and len(t) > 1 and t not in stop]


def snippet(title: Column, doc_id: Column, terms: Sequence[str]) -> Column:
    """The title with each query term, in any case, as **term**; without a title, Document <id>."""
    out = F.when(F.coalesce(title, F.lit("")) == "", F.concat(F.lit("Document "), doc_id.cast("string"))).otherwise(title)
    for t in terms:
        out = F.regexp_replace(out, rf"(?i)\b{re.escape(t)}\b", f"**{t}**")
    return out


def clean_abstract(text: Column, most: int = 200) -> Column:
    """Drop emptied brackets and |key= rests, fold white space, cut at `most` with dots; empty is N/A."""
    out = F.coalesce(text, F.lit(""))
    for gone in ("(, ; )", "(; )", "(, )", "()"):
        out = F.replace(out, F.lit(gone), F.lit(""))
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"\|[a-z\-]+=", " "), r"\s+", " "))
    out = F.when(F.length(out) > most, F.concat(F.substring(out, 1, most), F.lit("..."))).otherwise(out)
    return F.when(out == "", "N/A").otherwise(out)


def normalize_lines(lines: Column) -> Column:
    """Lower-cased, trimmed, white space folded, empty lines dropped."""
    return F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " "))), lambda x: x != "")


def normalize_surface(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s-]", ""))


def slugify(title: Column, doc_id: Column) -> Column:
    dashed = F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", "-")
    return F.concat(F.regexp_replace(dashed, "^-+|-+$", ""), F.lit("-"), doc_id.cast("string"))


def split_keywords(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def iso_minutes(text: Column) -> Column:
    """Minutes of an ISO-8601 duration that begins with PT: hours and minutes; days and seconds don't count."""
    hours = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, r"(\d+)H", 1), F.lit("")), F.lit("999999999")), F.lit(0))
    minutes = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, r"(\d+)M", 1), F.lit("")), F.lit("999999999")), F.lit(0))
    return F.when(text.startswith("PT"), (hours * 60 + minutes).cast("int")).otherwise(0)


def format_duration(seconds: Column) -> Column:
    return (
        F.when(seconds < 60, F.format_string("%.1fs", seconds.cast("double")))
        .when(seconds < 3600, F.format_string("%.1fm", seconds / 60))
        .otherwise(F.format_string("%.1fh", seconds / 3600))
    )


def safe_double(value: Column, default: float = 0.0) -> Column:
    """A number written out in full, else the default."""
    return F.coalesce(value.cast("string").try_cast("double"), F.lit(default))


def leading_number(value: Column) -> Column:
    """The number that a text begins with, else 0."""
    return F.coalesce(F.regexp_extract(value.cast("string"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1).try_cast("double"), F.lit(0.0))


#: What is dropped from an ingredient line, in this order.
MEASURES = (
    "cups?|c\\.?", "tablespoons?|tbsps?|tbs?|tb", "teaspoons?|tsps?|ts", "fluid\\s+ounces?|fl\\.?\\s*ozs?",
    "milliliters?|mls?", "liters?|ls?", "pints?|pts?", "quarts?|qts?", "gallons?|gals?", "pounds?|lbs?",
    "ounces?|ozs?", "grams?|gs?", "kilograms?|kgs?", "packages?|pkgs?", "envelopes?", "packets?", "cans?",
    "jars?", "bottles?", "boxes?", "bags?", "containers?", "bunches?", "cloves?", "pinchs?|pinches?",
    "dashs?|dashes?", "handfuls?", "slices?", "pieces?", "stalks?", "heads?", "sprigs?", "lea(?:f|ves)",
    "strips?",
)
DESCRIPTIONS = (
    "chopped|minced|diced|sliced|shredded|grated|crushed|ground|peeled",
    "cubed|julienned|halved|quartered|crumbled|mashed|pureed|pressed",
    "separated|divided|pitted|seeded|deveined|skinned|boned|trimmed",
    "finely|coarsely|roughly|thinly|thickly|lightly",
    "fresh|freshly|dried|frozen|canned|jarred|bottled|packaged",
    "raw|cooked|roasted|grilled|toasted|fried|boiled|steamed",
    "large|medium|small|extra|mini|jumbo|giant|sized?", "thick|thin|heavy|light|lean",
    "low|reduced|fat|free|non", "optional|additional|more|less",
    "room\\s+temperature|softened|melted|beaten|whipped", "unsalted|salted|sweetened|unsweetened",
    "whole|half|halves|quarter", "ripe|unripe|firm|soft|hard", "organic|natural|artificial",
    "regular|extra|super", "approx(?:imate)?|about|up", "total|combined|mixed", "aged|old|new|young",
    "pure|real|imitation", "instant|active|quick|rapid|reg",
)
PHRASES = ("to taste|for serving|for garnish|as needed|as desired", "cut into|drained?|rinsed?|washed?|trimmed?")
PUNCTUATION = ",-–—.;:&!@#$%^*()[]{}|\\/\"'`~+=%\t\n"
NOT_FOOD = (r"^\d+\s*\.", r"^\.", r"^\-", r"work\s*best", r"i\s*used?", "depending", r"may\s*need", "preferably", r"markets?")


def ingredient_steps() -> list[tuple[str, str]]:
    """(pattern, replacement) in order: the line without amounts, measures and descriptions."""
    return [
        (r"\([^)]*\)", ""), (r"\[[^\]]*\]", ""), (r",[\s\S]*$", ""), (r"\s+(?:or|plus|&)\s+[\s\S]*$", ""), (r"^\s*\d+[\d\s/.\-–—%]*", ""),
        *((rf"(?i)\b(?:{m})\b", " ") for m in MEASURES), *((rf"(?i)\b(?:{d})\b", " ") for d in DESCRIPTIONS), *((rf"(?i)\b(?:{p})\b", "") for p in PHRASES),
        (r"(?i)\b(?:known as|found in|equilavents?|listed)\b.*$", ""), (r"(?i)\b(?:weighs?|measure)\b", ""),
        (r"\b\d+\s*[-–—]\s*\d+\b", ""), (r"(?i)\b\d+\s*count\b", ""), (r"\d+g\b", ""), (r"\s+", " "),
    ]


def normalize_ingredient(text: Column) -> Column:
    """The core name of an ingredient line, or null where nothing that looks like one is left."""
    out = F.trim(F.lower(text))
    for pattern, to in ingredient_steps():
        out = F.regexp_replace(out, pattern, to)
    out = F.btrim(F.btrim(out), F.lit(PUNCTUATION))
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)^(?:a|an|the|of|for|to|in|on|at|with|by)\s+", ""), r"^\d+[\s.\-/]*", "")
    out = F.btrim(out, F.lit(PUNCTUATION + " "))
    bad = (F.length(out) < 3) | out.rlike(r"^[\d\s\-–—/.,;:!@#$%^&*()+=]+$")
    for pattern in NOT_FOOD:
        bad = bad | out.rlike(f"(?i){pattern}")
    return F.when(~bad, out)
