"""SQL pieces that the queries' statements in DuckDB share."""

from __future__ import annotations

from ..functions.text import STOPWORDS

STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def tokens(text: str) -> str:
    """The tokenizer of a text expression."""
    runs = rf"string_split_regex(lower(regexp_replace(coalesce({text}, ''), '&[a-zA-Z0-9#]+;', ' ', 'g')), '[^\p{{L}}\p{{N}}_]+')"
    return f"list_filter({runs}, lambda t: regexp_full_match(t, '[a-z]+') AND length(t) > 1 AND NOT list_contains({STOP}, t))"


#: Documents as recipes: title, ing, instr.
RECIPES = """
lines AS (SELECT doc_id, lang, source, n_chars, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
rec AS (SELECT doc_id, lang, source, n_chars, l[1] AS title, coalesce(l[2], '') AS ing, array_to_string(l[3:], ' ') AS instr, l FROM lines)
"""

#: The index: docmeta m, postings p, terms t, statistics s.
INDEX = f"""
{RECIPES},
tok AS (SELECT doc_id, title, {tokens("title")} AS a, {tokens("ing")} AS b, {tokens("instr")} AS c FROM rec),
m AS (SELECT doc_id, title, len(a)::INT AS len_title, len(b)::INT AS len_ingredients, len(c)::INT AS len_instructions,
             (len(a) + len(b) + len(c))::INT AS len_total FROM tok WHERE len(a) + len(b) + len(c) > 0),
u AS (SELECT doc_id, 'title' AS field, unnest(a) AS term FROM tok UNION ALL
      SELECT doc_id, 'ingredients', unnest(b) FROM tok UNION ALL SELECT doc_id, 'instructions', unnest(c) FROM tok),
p AS (SELECT term, field, doc_id, count(*) AS tf FROM u GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, sum(len_total) / count(*)::DOUBLE AS avg_len FROM m),
t AS (SELECT term, count(*) AS df, round(ln(any_value(n_docs) / count(*)::DOUBLE), 6) AS idf FROM p, s GROUP BY term)
"""

_W = "CASE field WHEN 'title' THEN 3.0::DOUBLE WHEN 'ingredients' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END"
_L = "CASE field WHEN 'title' THEN len_title WHEN 'ingredients' THEN len_ingredients ELSE len_instructions END"
BM25_PART = f"tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * {_L} / avg_len)) * idf * {_W}"


def bm25(terms: list[str], where: str = "true") -> str:
    inside = ", ".join(f"'{t}'" for t in terms)
    return f"sc AS (SELECT p.doc_id, round(sum({BM25_PART}), 9) AS score FROM p JOIN t USING (term) JOIN m USING (doc_id), s WHERE term IN ({inside}) AND ({where}) GROUP BY p.doc_id)"


def tfidf(asked: dict[str, int]) -> str:
    q = "CASE term " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in asked.items()) + " END"
    inside = ", ".join(f"'{k}'" for k in asked)
    return f"""qn AS (SELECT sqrt(sum(pow({q} * idf, 2))) AS q FROM t WHERE term IN ({inside})),
sc AS (SELECT doc_id, round(sum({q} * idf * tf * idf * {_W}) / (any_value(q) * sqrt(sum(pow(tf * idf * {_W}, 2)))), 9) AS score
       FROM p JOIN t USING (term), qn WHERE term IN ({inside}) GROUP BY doc_id HAVING sum(pow(tf * idf * {_W}, 2)) > 0)"""


def top(k: int, offset: int = 0, score: str = "round(score, 6)") -> str:
    return f"SELECT row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank, doc_id, {score} AS score FROM sc ORDER BY score DESC, doc_id LIMIT {k} OFFSET {offset}"
