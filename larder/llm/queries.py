"""Driver queries of the training-data operators, with their SQL where DuckDB can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import read
from .reputation import TWO_LABEL_SUFFIXES

def _moments_sql(src: str, by: str, name: str, good: str, n: str) -> str:
    """The prior's mean and strength of reputation._moments in SQL."""
    mean = "((g + 0.5::DOUBLE) / (n + 1.0::DOUBLE))"
    return f"""{name} AS (SELECT {by}, g AS {name}_good, n AS {name}_n,
  least(greatest({mean} * (1 - {mean}) / greatest(r2 / greatest(n, 1e-9::DOUBLE) - {mean} * {mean} - {mean} * (1 - {mean}) * k / greatest(n, 1e-9::DOUBLE), 1e-6::DOUBLE) - 1, 2.0::DOUBLE), 200.0::DOUBLE) AS {name}_m
  FROM (SELECT {by}, sum({good}) AS g, sum({n}) AS n, sum({n} * ({good} / {n}) * ({good} / {n})) AS r2, count(*) AS k FROM {src} GROUP BY {by}))"""


_TWO = "regexp_extract(host, '([^.]*\\.?[^.]*)$', 1)"
_LONG = f"{_TWO} IN ({', '.join(repr(s) for s in TWO_LABEL_SUFFIXES)})"
_DOMAIN = f"CASE WHEN {_LONG} THEN regexp_extract(host, '((?:[^.]*\\.)?[^.]*\\.[^.]*)$', 1) ELSE {_TWO} END"
_SUFFIX = f"CASE WHEN {_LONG} THEN {_TWO} ELSE regexp_extract(host, '([^.]*)$', 1) END"
OP9_SQL = f"""
WITH h AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM h
), o AS (
  SELECT host, (quality = 1 AND toxic = 0) AS good FROM p LEFT JOIN labels ON page_id = doc_id
), u AS (
  SELECT host, {_DOMAIN} AS domain, {_SUFFIX} AS suffix, count(good)::DOUBLE AS n, coalesce(sum(good::INT), 0)::DOUBLE AS g, greatest(count(good)::DOUBLE, 1e-9::DOUBLE) AS told FROM o GROUP BY host
), {_moments_sql("u", "suffix, domain", "d", "u.g", "u.told")}, {_moments_sql("d", "suffix", "s", "d_good", "d_n")},
t AS (SELECT (sum(s_good) + 0.5::DOUBLE) / (sum(s_n) + 1.0::DOUBLE) AS whole FROM s),
sm AS (SELECT suffix, s_m, (s_good + s_m * whole) / (s_n + s_m) AS s_mean FROM s, t),
dm AS (SELECT suffix, domain, d_m, (d_good + s_m * s_mean) / (d_n + s_m) AS d_mean FROM d JOIN sm USING (suffix)),
b AS (SELECT host, g + d_m * d_mean AS a, n - g + d_m * (1 - d_mean) AS b FROM u JOIN dm USING (suffix, domain)),
l AS (SELECT host, 1 / (1 + exp(-(ln(a / (a + b) / (1 - a / (a + b))) - 1.645::DOUBLE * sqrt(1 / a + 1 / b)))) AS low FROM b),
r AS (SELECT p.*, low,
  CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/7%' THEN 'example.com/en/7' WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/de/8%' THEN 'example.net/de/8'
       WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/en/%' THEN 'com/en/' WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/de/%' THEN 'net/de/' WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/es/%' THEN 'org/es/' END AS rule
  FROM p JOIN l USING (host))
SELECT page_id, host, path, rule, CASE rule WHEN 'example.com/en/7' THEN 'allow' WHEN 'com/en/' THEN 'block' WHEN 'example.net/de/8' THEN 'block' WHEN 'net/de/' THEN 'block' WHEN 'org/es/' THEN 'block'
  ELSE CASE WHEN low >= 0.5 THEN 'allow' ELSE 'block' END END AS verdict, round(low, 6) AS good_low FROM r
"""

OP6_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w
), n AS (SELECT doc_id, len(sh) AS n FROM s), e AS (SELECT doc_id, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * m >= 90 * (p.n + q.n - m)),
k AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT k.y, r.root FROM r JOIN k ON k.x = r.doc_id)
SELECT doc_id, any_value(n)::BIGINT AS n_shingles, min(root) AS component_id FROM r JOIN n USING (doc_id) GROUP BY doc_id
"""

OP2_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""

_DIV = "floor({0}::DOUBLE / ({1})::DOUBLE)::BIGINT"
_K = ("k1", "k2", "k3", "k4")


def _fronts_sql(src: str, name: str, limit: int = 12) -> str:
    """CTEs {name}1 .. of the fronts of src (g, k1 .. k4), each of what the ones before leave, and {name} with all."""
    same = " AND ".join(f"b.{k} <= a.{k}" for k in _K)
    more = " OR ".join(f"b.{k} < a.{k}" for k in _K)
    out = []
    for i in range(1, limit + 1):
        left = src if i == 1 else f"{name}_left{i - 1}"
        out.append(f"{name}{i} AS MATERIALIZED (SELECT * FROM {left} a WHERE NOT EXISTS (SELECT 1 FROM {left} b WHERE b.g = a.g AND {same} AND ({more})))")
        out.append(f"{name}_left{i} AS MATERIALIZED (SELECT * FROM {left} EXCEPT SELECT * FROM {name}{i})")
    out.append(f"{name} AS (" + " UNION ALL ".join(f"SELECT *, {i} AS layer FROM {name}{i}" for i in range(1, limit + 1)) + ")")
    return ",\n".join(out)


OP11_SQL = f"""
WITH l AS (SELECT sale_id, item_id, vendor_id, quantity::BIGINT AS q, floor(100 * amount + 0.5::DOUBLE)::BIGINT AS c, floor(100 * discount + 0.5::DOUBLE)::BIGINT AS d, shipped_at::DATE AS day FROM sale_lines WHERE item_id IS NOT NULL AND vendor_id IS NOT NULL),
s AS (SELECT sale_id, min(sold_at::DATE) AS sold FROM sales WHERE sold_at IS NOT NULL GROUP BY sale_id),
m AS (SELECT l.item_id, vendor_id, sum(CASE WHEN c IS NOT NULL AND d IS NOT NULL AND q IS NOT NULL THEN c * (100 - d) END) AS paid, sum(CASE WHEN c IS NOT NULL AND d IS NOT NULL AND q IS NOT NULL THEN q END) AS units,
  sum(d) AS ds, count(d) AS dn, sum(date_diff('day', sold, day)) AS es, count(date_diff('day', sold, day)) AS en, max(q) AS quantity FROM l LEFT JOIN s USING (sale_id) GROUP BY ALL),
o AS MATERIALIZED (SELECT m.item_id, vendor_id, kind AS part_type, CASE WHEN floor(100 * i.price + 0.5::DOUBLE) >= 1 THEN {_DIV.format("paid", "floor(100 * i.price + 0.5::DOUBLE) * units")} END AS price,
  CASE WHEN dn > 0 THEN {_DIV.format("ds", "dn")} END AS discount, CASE WHEN en > 0 THEN {_DIV.format("es", "en")} END AS delay, quantity FROM m LEFT JOIN items i USING (item_id)),
v AS (SELECT *, coalesce('t' || part_type, '') AS g, coalesce(price, 9223372036854775807) AS k1, coalesce(-discount, 9223372036854775807) AS k2, coalesce(delay, 9223372036854775807) AS k3, coalesce(-quantity, 9223372036854775807) AS k4 FROM o),
t0 AS MATERIALIZED (SELECT DISTINCT g, k1, k2, k3, k4 FROM v),
{_fronts_sql("t0", "t")},
e0 AS MATERIALIZED (SELECT DISTINCT '' AS g, k1, k2, k3, k4 FROM t),
{_fronts_sql("e0", "e")}
SELECT item_id, vendor_id, part_type, price, discount, delay, quantity, coalesce(t.layer, 0)::BIGINT AS type_layer, coalesce(e.layer, 0)::BIGINT AS global_layer, count(*) OVER (PARTITION BY v.k1, v.k2, v.k3, v.k4) AS n_equal
FROM v LEFT JOIN t ON t.g = v.g AND t.k1 = v.k1 AND t.k2 = v.k2 AND t.k3 = v.k3 AND t.k4 = v.k4 LEFT JOIN e ON e.k1 = v.k1 AND e.k2 = v.k2 AND e.k3 = v.k3 AND e.k4 = v.k4
"""

#: What a source takes is whole passes over its blocks and the first blocks of one more.
OP12_SQL = """
WITH r AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS name, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
s AS (SELECT name, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY name) - 1 AS no FROM r GROUP BY name),
w AS (SELECT *, 1 + no % 3 AS weight, source_size * CASE no % 3 WHEN 0 THEN 18 WHEN 1 THEN 9 ELSE 6 END AS ratio FROM s),
a AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total, coalesce(sum(3 * source_size) OVER low, 0)::BIGINT AS below, (sum(weight) OVER () - coalesce(sum(weight) OVER low, 0))::BIGINT AS over FROM w WINDOW low AS (ORDER BY ratio GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, weight * (total - below)::HUGEINT > 3 * source_size::HUGEINT * over AS stops FROM a),
f AS (SELECT *, CASE WHEN stops THEN (3 * source_size)::DOUBLE ELSE (weight * (total - coalesce(sum(3 * source_size) FILTER (stops) OVER (), 0)::BIGINT))::DOUBLE / (sum(weight) FILTER (NOT stops) OVER ())::DOUBLE END AS target, greatest(least(2048, source_size // 512), 1) AS width FROM c),
b AS (SELECT *, (source_size + width - 1) // width AS blocks FROM f),
k AS (SELECT name, source_size, target, greatest(blocks, 1) AS blocks, CASE WHEN blocks > 0 THEN least(floor(target * blocks / source_size + 0.5::DOUBLE)::BIGINT, 3 * blocks) ELSE 0 END AS slots FROM b),
p AS (SELECT name, source_size, target, slots // blocks AS passes, (slots % blocks) * (source_size // blocks) + least(slots % blocks, source_size % blocks) AS rest FROM k),
d AS (SELECT *, (sum(size) OVER (PARTITION BY name ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS pos FROM r)
SELECT doc_id, size, source_size, target, (size * passes + greatest(0, least(pos + size, rest) - pos))::BIGINT AS taken FROM d JOIN p USING (name)
"""

_TERMS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP13_SQL = f"""
WITH q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
t AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM n),
p AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, nn),
g AS (SELECT doc_id, 50 + (50 * n * nn) // ll AS m FROM n, s),
c AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN g USING (doc_id) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM c WHERE score > 0 QUALIFY rank <= 50
"""


def _tok(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark, sf_dir):
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"), _tok("byte_bpe_50k.json"))


def op2_exact_dedup(spark, sf_dir):
    from .dedup import exact_groups

    return exact_groups(read(spark, sf_dir, "documents"))


def op3_secret_scan(spark, sf_dir):
    from .secrets import scan_secrets

    return scan_secrets(read(spark, sf_dir, "documents"), words=_tok("word_bpe_49k.json"))


def op4_toxicity(spark, sf_dir):
    from .toxicity import score_documents

    return score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_html_text(spark, sf_dir):
    from .wrappers import extract_text

    return extract_text(read(spark, sf_dir, "pages"))


def op10_lm_scores(spark, sf_dir):
    from .mixing import score_texts

    return score_texts(read(spark, sf_dir, "documents"))


def op6_jaccard_join(spark, sf_dir):
    from .jaccard import similar_groups

    return similar_groups(read(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    from .decontamination import find_leaks

    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_token_store(spark, sf_dir):
    from .tokenstore import round_trip

    return round_trip(read(spark, sf_dir, "documents"), _tok("word_bpe_49k.json"))


def op9_url_reputation(spark, sf_dir):
    from .reputation import judge_urls

    labels = read(spark, sf_dir, "labels")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return judge_urls(read(spark, sf_dir, "pages"), labels.select("doc_id", good)).withColumn("good_low", F.round("good_low", 6))



def op11_pareto(spark, sf_dir):
    from .pareto import offer_layers

    return offer_layers(*(read(spark, sf_dir, t) for t in ("sale_lines", "items", "sales")))


def op12_mix(spark, sf_dir):
    from .schedule import mix, taken_words

    return taken_words(mix(read(spark, sf_dir, "documents")))


def op13_search(spark, sf_dir):
    from .wand import search

    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_packing, op2_exact_dedup, op3_secret_scan, op4_toxicity, op5_html_text, op6_jaccard_join, op7_token_store, op8_decontamination, op9_url_reputation, op10_lm_scores, op11_pareto, op12_mix, op13_search)}
ORACLES = {"op2_exact_dedup": OP2_SQL, "op6_jaccard_join": OP6_SQL, "op9_url_reputation": OP9_SQL, "op11_pareto": OP11_SQL, "op12_mix": OP12_SQL, "op13_search": OP13_SQL}
