"""Toxicity: a linear classifier in numpy, fitted by non-negative positive-unlabelled risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import worker_cache

#: The fit's bounded sample: confirmed toxic texts and unlabelled ones. Features kept at most.
POSITIVES, UNLABELLED, FEATURES = 3000, 9000, 5000
#: Positives that a feature must be seen in.
LEAST = 3
THRESHOLD = 0.3
#: Words whose weight a scoring task remembers (others are weighed anew), and texts that are Python strings at once.
REMEMBERED, ROWS = 100_000, 500


def words(text: str | None):
    import re

    return set(re.findall(r"\w+", (text or "").lower()))


def features(word: str) -> list[int]:
    """Hashes of a word and of its first four to seven letters."""
    from zlib import crc32

    raw = word.encode()
    return [crc32(b"w" + raw), *(crc32(b"p" + word[:n].encode()) for n in (4, 5, 6, 7) if len(word) > n)]


def fit(samples: list, prior: float, steps: int = 400, rate: float = 0.1, l2: float = 2e-5):
    """samples: (1 if confirmed positive else 0, feature hashes as bytes) -> (bias, {hash: weight}).

    Minimises prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the sigmoid loss, whose bound
    keeps a few easy positives from outweighing all else, by Adam on all samples; where the
    corrected negative risk falls below zero its gradient is turned round, as in non-negative risk
    estimation.
    """
    import numpy as np

    samples = sorted(samples, key=lambda s: (s[0], s[1]))
    y = np.array([s[0] for s in samples], bool)
    if not len(samples) or not y.any() or y.all():
        return float(np.log((prior + 1e-3) / (1 - prior + 1e-3))), {}
    parts = [np.unique(np.frombuffer(s[1], "<u4")) for s in samples]
    keep = np.unique(np.concatenate(parts))

    def places(part, among):
        at = np.minimum(np.searchsorted(among, part), max(0, len(among) - 1))
        return at[among[at] == part] if len(among) else at[:0]

    found = [places(part, keep) for part in parts]
    row, col = np.repeat(np.arange(len(parts)), [len(f) for f in found]), np.concatenate(found)
    del parts, found
    w, b = np.zeros(len(keep)), np.log((prior + 1e-3) / (1 - prior + 1e-3))
    m, v = np.zeros(len(keep) + 1), np.zeros(len(keep) + 1)
    n_p, n_u = y.sum(), (~y).sum()
    for step in range(1, steps + 1):
        z = np.bincount(row, w[col], minlength=len(y)) + b
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        slope = p * (1 - p)
        grad = np.where(y, prior * slope / n_p, -slope / n_u)
        if p[~y].mean() >= prior * p[y].mean():
            grad = np.where(y, -2 * prior * slope / n_p, slope / n_u)
        g = np.append(np.bincount(col, grad[row], minlength=len(w)) + l2 * w, grad.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) * (1 - step / (steps + 1))
        w, b = w - move[:-1], b - move[-1]
    used = np.abs(w) > 1e-4
    return float(b), dict(zip(keep[used].tolist(), w[used].tolist()))


def chosen(known, times, prior: float, n_positive: int, n_unlabelled: int):
    """The features to fit. known: hashes; times: (2, hashes), the unlabelled and the positive texts that
    have each. Of those that at least LEAST positives have, and three times as often as negatives
    (their rate is that of the unlabelled less the prior's share of positives), the FEATURES ones that
    stand out most against chance."""
    import numpy as np

    of_p, of_u = times[1] / n_positive, times[0] / n_unlabelled
    # what the unlabelled texts show that aren't positive, at least half a text's worth
    of_n = np.maximum((of_u - prior * of_p) / (1 - prior), 0.5 / n_unlabelled)
    score = (of_p - of_n) / np.sqrt(of_p * (1 - of_p) / n_positive + of_n / n_unlabelled + 1e-12)
    score = np.where((of_p >= 3 * of_n) & (times[1] >= LEAST), score, 0.0)
    return known[np.sort(np.argsort(-score, kind="stable")[: min(FEATURES, int((score > 2).sum()))])]


def _tally(batches):
    """(hash, y, texts): how many of a task's texts of each kind have a feature."""
    import numpy as np
    import pyarrow as pa

    for batch in _hashes()(batches):
        y = np.array(batch.column(0).to_pylist(), np.uint64)
        sets = [np.frombuffer(h, "<u4").astype(np.uint64) for h in batch.column(1).to_pylist()]
        if sets:
            keys, n = np.unique(np.concatenate([s * np.uint64(2) + k for s, k in zip(sets, y)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((keys >> np.uint64(1)).astype(np.int64)), pa.array((keys & np.uint64(1)).astype(np.int32)), pa.array(n)], names=["hash", "y", "n"])


def _hashes(known=None):
    """Feature hashes of each text, of the known ones if they are given."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        worker_cache()
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            raw = []
            for t in batch.column(1).to_pylist():
                own = np.unique(np.array([h for w in words(t) for h in features(w)], "<u4"))
                if known is not None:
                    own = own[np.isin(own, known, assume_unique=True)]
                raw.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["y", "hashes"])

    return run


def learnable(id_col):
    """Rows whose labels may be learnt from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4 != 2


def _sample(ids: DataFrame, most: int) -> DataFrame:
    """At most `most` ids, the same whatever the partitions; few rows beyond them are sorted."""
    n = ids.count()
    h = F.xxhash64("__id", F.lit(17))
    if n > 4 * most:
        ids = ids.filter(F.pmod(h, F.lit(1 << 20)) < int((1 << 20) * 2 * most / n))
    return ids.orderBy(h, "__id").limit(most)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[float, dict[int, float]]:
    """Fit on a bounded sample (POSITIVES, UNLABELLED) of the learnable rows.

    Positives are texts whose label is toxic; unlabelled ones are drawn from all texts, whatever
    their label. The class prior is the toxic share of the learnable labels. Without a positive
    the classifier is that prior. Labels that are null or without a text are ignored.
    """
    told = labels.select(F.col("doc_id").alias("__id"), F.col("toxic").alias("__toxic")).filter(F.col("__id").isNotNull() & F.col("__toxic").isNotNull() & learnable(F.col("__id")))
    n, positive = told.agg(F.count(F.lit(1)), F.sum((F.col("__toxic") == 1).cast("long"))).first()
    prior = min(0.9, max(0.001, (positive or 0) / n)) if n else 0.001
    ids = docs.select(F.col(id_col).alias("__id")).filter(F.col("__id").isNotNull() & learnable(F.col("__id"))).distinct()
    picked = _sample(told.filter(F.col("__toxic") == 1).select("__id").distinct(), POSITIVES).withColumn("__y", F.lit(1))
    picked = picked.unionByName(_sample(ids, UNLABELLED).withColumn("__y", F.lit(0)))
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"))
    # at most POSITIVES + UNLABELLED pairs of numbers
    rows = rows.join(F.broadcast(picked), F.col("__doc") == F.col("__id")).select("__y", "__text")
    import numpy as np

    # the driver sees the features that at least LEAST positives have, then the FEATURES chosen ones of each text
    n_of = {r["y"]: r["n"] for r in rows.groupBy(F.col("__y").alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = n_of.get(1, 0), n_of.get(0, 0)
    known = np.zeros(0, np.uint32)
    if n_p and n_u:
        tally = rows.mapInArrow(_tally, "hash long, y int, n long").groupBy("hash").agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("u"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("p"))
        told = sorted((r["hash"], r["u"], r["p"]) for r in tally.filter(F.col("p") >= LEAST).collect())
        if told:
            hashes, u, p = (np.array(x) for x in zip(*told))
            known = chosen(hashes.astype(np.uint32), np.stack([u, p]).astype(float), prior, n_p, n_u)
    got = rows.mapInArrow(_hashes(known), "y int, hashes binary").collect()
    return fit([(r["y"], bytes(r["hashes"])) for r in got], prior)


def scorer(model: tuple[float, dict[int, float]]):
    """A column function: text -> score in [0, 1]."""
    bias, weights = model

    @F.arrow_udf("double")
    def score(texts):
        import numpy as np
        import pyarrow as pa

        worker_cache()
        known: dict[str, float] = {}

        def weigh(word):
            w = sum(weights.get(h, 0.0) for h in features(word))
            if len(known) < REMEMBERED:
                known[word] = w
            return w

        find = known.get
        out = []
        for text in (t for at in range(0, len(texts), ROWS) for t in texts.slice(at, ROWS).to_pylist()):
            total = bias
            for word in words(text):
                w = find(word)
                total += weigh(word) if w is None else w
            out.append(total)
        return pa.array(1 / (1 + np.exp(-np.clip(np.array(out, float), -40, 40))))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    Inputs of a score are the text's words alone, all of them however long it is. Null and empty texts get
    the bias's score; repeated rows and ties each get their row; a null id is not held out; an empty table gives no
    rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    score = scorer(train(rows, labels, "doc_id", "text"))
    out = rows.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, with docs' columns, whatever their names.

    Null and empty texts get the bias's score, which is below the threshold unless most labels are
    toxic; very long texts are read whole; repeated rows and tied ids are each judged by their own text; an empty table gives no
    rows; without a toxic label all rows stay.
    """
    score = scorer(train(docs, labels, id_col, text_col))
    return docs.filter(score(F.col(text_col)) < threshold)
