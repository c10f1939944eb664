"""Ranked lexical search: WAND over shards of documents, whose heaps are merged."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Best documents of an item.
TOP = 50
#: Postings of a shard, and documents of it among which candidates are found at once.
SHARD = 1_500_000
STEP = 1024
#: Bytes of query texts whose terms are held against all documents in one pass.
QUERY_BYTES = 16 << 20
#: Parts whose heaps are merged before these meet in one task an item.
MERGE = 32


# -- terms -----------------------------------------------------------------------------------------


def _table() -> bytes:
    """A-Z to a-z; ASCII that is neither letter nor digit to a space. Bytes of other characters stay."""
    keep = lambda b: b > 127 or chr(b).isalnum()
    return bytes((b + 32 if 65 <= b <= 90 else b) if keep(b) else 32 for b in range(256))


def terms_of(text: str | None, table: bytes) -> list[bytes]:
    return (text or "").encode().translate(table).split(b" ") if text else []


def _counted(vocab: dict[bytes, int]):
    """Per task: documents with a term (id -1, n) and their terms with repeats (id -2), and the documents of each known term."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table, df, n, total = _table(), np.zeros(len(vocab), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = [t for t in terms_of(text, table) if t]
                n, total = n + bool(found), total + len(found)
                ids = [vocab[t] for t in vocab.keys() & set(found)]
                df[ids] += 1
        ids = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[ids, -1, -2]), pa.array(np.r_[df[ids], n, total])], names=["id", "n"])

    return run


# -- a shard ---------------------------------------------------------------------------------------


class Shard:
    """Documents in ascending order of id with the postings of the known terms: numbers of documents and impacts by term."""

    def __init__(self, weights, n_docs: int, n_terms: int, top: int):
        self.weights, self.n_docs, self.n_terms, self.top = weights, n_docs, n_terms, top
        self.clear()

    def clear(self) -> None:
        self.ids, self.lengths, self.sizes, self.terms, self.counts, self.held = [], [], [], [], [], 0

    def add(self, doc_id, length: int, terms, counts) -> None:
        self.ids.append(doc_id)
        self.lengths.append(length)
        self.sizes.append(len(terms))
        self.terms.append(terms)
        self.counts.append(counts)
        self.held += len(terms)

    def close(self) -> None:
        """Sort postings by term and document, and take each term's greatest impact."""
        import numpy as np

        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        at = np.repeat(np.arange(len(order)), np.array(self.sizes, np.int64)[order])
        term, tf = (np.concatenate([x[i] for i in order] or [np.zeros(0, np.int64)]).astype(np.int64) for x in (self.terms, self.counts))
        norm = 50 + (50 * np.array(self.lengths, np.int64)[order] * self.n_docs) // max(1, self.n_terms)
        impact = self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm[at]))
        by = np.argsort(term, kind="stable")
        self.doc, self.impact = at[by].astype(np.int32), impact[by]
        self.first = np.searchsorted(term[by], np.arange(len(self.weights) + 1))
        self.own_ids = [self.ids[i] for i in order]
        self.most = np.zeros(len(self.weights), np.int64)
        there = np.flatnonzero(np.diff(self.first))
        if len(there):
            self.most[there] = np.maximum.reduceat(self.impact, self.first[there])

    def search(self, asked, heap: list) -> list:
        """The best of heap [(score, id)], an item's so far, and of this shard: highest score, then smallest id.

        Terms are ordered by their greatest impact. The pivot is the first at which the sum of these beats the heap's least
        score: a document without the pivot or a term after it can't enter, and is skipped unseen. Of the rest, in steps of
        document numbers, the bound of the terms that each has is taken, and only documents whose bound beats the
        threshold are scored. It rises from step to step, and so does the pivot.
        """
        import numpy as np

        asked = asked[self.most[asked] > 0]
        asked = asked[np.argsort(self.most[asked], kind="stable")]
        bounds = np.cumsum(self.most[asked])
        if not len(asked):
            return heap
        lists = [(self.doc[self.first[t] : self.first[t + 1]], self.impact[self.first[t] : self.first[t + 1]]) for t in asked]
        cursors = np.zeros(len(asked), np.int64)
        for low in range(0, len(self.own_ids), STEP):
            least = heap[-1][0] - 1 if len(heap) == self.top else 0  # an equal score may have a smaller id
            pivot = int(np.searchsorted(bounds, least, side="right"))
            if pivot == len(asked):
                break  # no document of what is left can enter
            n = min(STEP, len(self.own_ids) - low)
            bound, seen = np.zeros(n, np.int64), np.zeros(n, bool)
            parts = []
            for i in range(len(asked) - 1, -1, -1):
                docs, impact = lists[i]
                if i < pivot and not seen.any():
                    break
                begin = cursors[i] + int(np.searchsorted(docs[cursors[i] :], low)) if cursors[i] < len(docs) and docs[cursors[i]] < low else int(cursors[i])
                end = begin + int(np.searchsorted(docs[begin:], low + n))
                cursors[i] = end
                here = docs[begin:end] - low
                if i >= pivot:
                    seen[here] = True
                bound[here] += self.most[asked[i]]
                parts.append((here, impact[begin:end]))
            ready = seen & (bound > least)
            if not ready.any():
                continue
            score = np.zeros(n, np.int64)
            for here, impact in parts:
                score[here] += impact
            ready &= score > least
            found = np.flatnonzero(ready)
            if len(found) > self.top:  # the best, all of the last one's score included; the sort cuts these
                found = found[score[found] >= np.partition(score[found], -self.top)[-self.top]]
            heap = sorted([*heap, *((int(score[d]), self.own_ids[low + d]) for d in found)], key=_place)[: self.top]
        return heap


def _place(hit):
    score, doc_id = hit
    return -score, doc_id is None, doc_id or 0


def _ranked(vocab: dict[bytes, int], weights: list[int], asked: list[list[int]], n_docs: int, n_terms: int, top: int, shard_size: int):
    """A task's documents in shards of some shard_size postings; heaps go from shard to shard, so thresholds do too."""

    def run(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        table, shard = _table(), Shard(np.array(weights, np.int64), n_docs, n_terms, top)
        items = [np.array(a, np.int64) for a in asked]
        heaps: list[list] = [[] for _ in items]

        def searched():
            shard.close()
            for i, own in enumerate(items):
                heaps[i] = shard.search(own, heaps[i])
            shard.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = Counter(terms_of(text, table))
                counts.pop(b"", None)
                known = vocab.keys() & counts.keys()
                if known:
                    shard.add(doc_id, counts.total(), np.array([vocab[t] for t in known]), np.array([counts[t] for t in known]))
                if shard.held >= shard_size:
                    searched()
        if shard.held:
            searched()
        hits = [(i, doc_id, score) for i, heap in enumerate(heaps) for score, doc_id in heap]
        part = TaskContext.get().partitionId()
        if hits:
            no, ids, scores = zip(*hits)
            yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64()), pa.array([part] * len(no), pa.int64())], names=["no", "doc_id", "score", "part"])

    return run


# -- all shards ------------------------------------------------------------------------------------


def _blocks(items: DataFrame, id_col: str, text_col: str):
    """The stated queries in blocks of QUERY_BYTES: [(id, texts)], an id once."""
    block: dict = {}
    held = 0
    for row in items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).orderBy("id").toLocalIterator():
        if held > QUERY_BYTES and row["id"] not in block:
            yield block
            block, held = {}, 0
        block.setdefault(row["id"], []).append(row["text"])
        held += len(row["text"] or "")
    if block:
        yield block


def _merged(hits: DataFrame, key: str, top: int) -> DataFrame:
    """The best `top` of each key: parts are merged in MERGE bundles an item first, then these."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(*order))
    some = hits.withColumn("part", F.col("part") % MERGE).withColumn("__r", rank(key, "part")).filter(F.col("__r") <= top)
    return some.withColumn("rank", rank(key)).filter(F.col("rank") <= top).select(key, F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, item_col: str = "item_id", query_col: str = "text", id_col: str = "doc_id", text_col: str = "text", shard_size: int = SHARD) -> DataFrame:
    """Per item its `top` best documents with a score above 0: item id, rank, doc_id, score.

    Items are a stated query set: the driver reads their terms in blocks of some 16 MB, and each block is held against all
    documents in two passes. The first counts documents, terms, and the documents of each known term; the
    driver gets these counts, as many as the block has terms. The second makes shards of each task's documents and searches them
    by WAND (Shard.search); a task gives `top` rows an item at most, merged in two steps. Texts are read whole and never
    shuffled, and memory holds one shard's postings.

    Null texts have no terms; items without known terms have no rows; texts of a repeated item id are one query; repeated rows
    are documents each; equal scores go by ascending id, null ids last. An empty table on either side gives no rows.
    Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = None
    table = _table()
    for block in _blocks(items, item_col, query_col):
        ids = list(block)
        own = [sorted({t for text in texts for t in terms_of(text, table) if t}) for texts in block.values()]
        vocab = {t: i for i, t in enumerate(sorted({t for terms in own for t in terms}))}
        counts = rows.select("text").mapInArrow(_counted(vocab), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
        df = dict(counts.collect())  # as many as the block has terms, and two
        n_docs, n_terms = df.get(-1, 0), df.get(-2, 0)
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(vocab))]
        asked = [[vocab[t] for t in terms] for terms in own]
        hits = rows.mapInArrow(_ranked(vocab, weights, asked, n_docs, n_terms, top, shard_size), "no long, doc_id long, score long, part long")
        best = _merged(hits, "no", top)
        names = docs.sparkSession.createDataFrame(list(enumerate(ids)), f"no long, {item_col} {dict(items.dtypes)[item_col]}")
        best = materialize(best.join(names, "no").select(item_col, "rank", "doc_id", "score"))
        found = best if found is None else found.unionByName(best)
    if found is None:
        kind = dict(items.dtypes)[item_col]
        return docs.sparkSession.createDataFrame([], f"{item_col} {kind}, rank int, doc_id long, score long")
    return found



