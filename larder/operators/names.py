"""Names of a dictionary that may grow with the data, found in texts without any task or the driver holding it.

Each place of a text is hashed at the lengths that names have, or that the words there have; a filter of bounded size lets
through what may be a name. What it lets through wrongly is found out by a join of the different texts that it lets through
with the dictionary, and told to all tasks if it is little, so that texts and places stay in their task. If it is much,
places meet the dictionary in an equi-join on the name itself. So a join decides, not the hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import by_own_ids, materialize

#: Names up to which one automaton in each task is the better way.
LARGE = 200_000
#: Bits of the filter for a name, and at most (16 MB), however many names there are.
BITS, MOST_BITS = 16, 27
#: A name has a bit in the filter for each of these.
SALTS = (1, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: Texts that aren't names although the filter lets them through, as many as each task is told.
LISTED = 200_000
#: A factor that has an inverse among 64-bit numbers; a code point that no text has.
FACTOR, BETWEEN = 0x9E3779B97F4A7C15, 0x110000
_INVERSE = pow(FACTOR, -1, 1 << 64)
#: Code points that are hashed together.
PORTION = 1 << 20


def _powers(base: int, n: int):
    import numpy as np

    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _hashes(points):
    """A function of lengths (one or many), and places if not all of them, that gives the hash of the code points there; hashes of
    equal stretches are equal."""
    import numpy as np

    x = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(x * _powers(FACTOR, len(x)), dtype=np.uint64)])
    back = _powers(_INVERSE, len(x))

    def at(length, places=None):
        if places is None:
            h = (sums[length:] - sums[: len(sums) - length]) * back[: len(sums) - length]
        else:
            h = (sums[places + length] - sums[places]) * back[places]
        h = (h ^ (h >> np.uint64(29))) * (np.asarray(length).astype(np.uint64) * np.uint64(2) + np.uint64(FACTOR))
        return h ^ (h >> np.uint64(32))

    return at


def _points(text: str):
    import numpy as np

    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _bit_of(h, bits: int, salt: int):
    """A bit of each hash in the filter."""
    import numpy as np

    return ((h * np.uint64(salt)) >> np.uint64(64 - bits)).astype(np.int64)


def _marks(bits: int):
    """Names -> (word of the filter, its bits), and (-2 - 2 * length, 0), (-1 - 2 * inner ends, 0) for what lengths and inner ends
    names have. An inner end is a character behind the first that isn't of a word: there a stretch could end too."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        marks = _word_marks()
        for batch in batches:
            names = batch.column(0).to_pylist()
            if not names:
                continue
            size = np.array([len(n) for n in names])
            start = np.cumsum(size) - size
            points = _points("".join(names))
            h = _hashes(points)(size, start)
            at = np.unique(np.concatenate([_bit_of(h, bits, salt) for salt in SALTS]))
            word, first = np.unique(at >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), first).view(np.int64)
            outside = np.concatenate([[0], np.cumsum(~marks(points))])
            inner = outside[start + size] - outside[start + 1]
            shape = np.concatenate([-2 - 2 * np.unique(size), -1 - 2 * np.unique(inner)])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([shape, word])), pa.array(np.concatenate([np.zeros(len(shape), np.int64), value]))], names=["word", "value"])

    return run


def _filter_of(names: DataFrame):
    """(lengths of names, their inner ends, words of the filter, its bits): all that the driver sees of the dictionary."""
    import numpy as np

    bits = min(MOST_BITS, max(10, (BITS * names.count()).bit_length()))
    marked = names.mapInArrow(_marks(bits), "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
    word, value = marked["word"].to_numpy(np.int64), marked["value"].to_numpy(np.int64)
    shape = sorted(-1 - word[word < 0])
    filter_words = np.zeros(1 << (bits - 6), np.int64)
    filter_words[word[word >= 0]] = value[word >= 0]
    return [int(x) // 2 for x in shape if x % 2], [int(x) // 2 for x in shape if x % 2 == 0], filter_words, bits


def _candidates(known, n_fields: int, boundary: bool):
    """Batches of (doc, one text a field) -> (type of docs, docs, fields, number of the text, start, end, name) of the places that the
    filter lets through, for PORTION code points at once."""
    lengths, inner_ends, filter_words, bits = known

    def run(batches):
        import numpy as np

        mask, marks = filter_words.view(np.uint64), _word_marks()
        is_length = np.zeros(max(lengths, default=0) + 2, bool)
        is_length[lengths] = True

        def hits(h):
            hit = None
            for salt in SALTS:
                at = _bit_of(h if hit is None else h[hit], bits, salt)
                passed = np.flatnonzero((mask[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1))
                hit = passed if hit is None else hit[passed]
            return hit

        def found(docs, fields, texts, kind):
            parts = [np.append(_points(t), np.uint32(BETWEEN)) for t in texts]
            starts = np.cumsum([0, *map(len, parts)])
            points = np.concatenate(parts)
            hashes = _hashes(points)
            where, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            if boundary:  # only places that no word character is before, up to places that none is behind
                outside = ~marks(points)
                open_at = np.flatnonzero(np.concatenate([[True], outside[:-1]]))
                ends = np.flatnonzero(np.append(outside, True))
                following = np.cumsum(outside)[open_at]  # the first end behind each
                for n in inner_ends:
                    place = open_at[: np.searchsorted(following, len(ends) - n)]
                    size = ends[following[: len(place)] + n] - place
                    fits = is_length[np.minimum(size, len(is_length) - 1)]
                    place, size = place[fits], size[fits]
                    hit = hits(hashes(size, place))
                    where.append(place[hit])
                    sizes.append(size[hit])
            else:
                for n in lengths:
                    if n > len(points):
                        break
                    where.append(hits(hashes(n)))
                    sizes.append(np.full(len(where[-1]), n))
            place, size = np.concatenate(where), np.concatenate(sizes)
            own = np.searchsorted(starts, place, side="right") - 1
            begin = place - starts[own]
            ok = place + size < starts[own + 1]  # a text's last point is the mark behind it
            own, begin, end = own[ok], begin[ok], (begin + size)[ok]
            names = [texts[i][a:b] for i, a, b in zip(own.tolist(), begin.tolist(), end.tolist())]
            return kind, docs, fields, own, begin, end, names

        for batch in batches:
            docs, fields, texts, held = [], [], [], 0
            kind = batch.schema.field(0).type
            for doc, *own in zip(*(c.to_pylist() for c in batch.columns)):
                for i, text in enumerate(own[:n_fields]):
                    if text:
                        docs.append(doc), fields.append(i), texts.append(text)
                        held += len(text)
                if held >= PORTION:
                    yield found(docs, fields, texts, kind)
                    docs, fields, texts, held = [], [], [], 0
            if texts:
                yield found(docs, fields, texts, kind)

    return run


def _names_of(candidates):
    """The different names among candidates, once a portion."""

    def run(batches):
        import pyarrow as pa

        for *_, names in candidates(batches):
            yield pa.RecordBatch.from_arrays([pa.array(list(set(names)), pa.string())], names=["name"])

    return run


def _places_of(candidates):
    """(doc_id, nth, start, end, name) of all candidates."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for kind, docs, fields, own, begin, end, names in candidates(batches):
            columns = [pa.array(docs, kind).take(pa.array(own)), pa.array(np.array(fields, np.int32)[own]), pa.array(begin, pa.int32()), pa.array(end, pa.int32()), pa.array(names, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "nth", "start", "end", "name"])

    return run


def _spans_of(candidates, wrong, mode: str, counted: bool):
    """Candidates that aren't wrong and don't overlap an earlier one of the text: (name, doc_ids, nths, starts), a name's places together once
    a portion; or how often each name is left in a text, (doc_id, nth, name, n)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for kind, docs, fields, own, begin, end, names in candidates(batches):
            names = np.array(names, object)
            order = np.lexsort((-end if mode == "longest" else end, begin, own))
            if wrong:
                order = order[~np.fromiter((n in wrong for n in names[order]), bool, len(order))]
            rows = pa.RecordBatch.from_arrays([pa.array(x) for x in (own[order], np.zeros(len(order), np.int64), begin[order], end[order], order)], names=["doc_id", "nth", "start", "end", "at"])
            at = np.concatenate([b.column("at").to_numpy() for b in _kept([rows])] or [order])
            own, begin, names = own[at], begin[at], pa.array(names[at], pa.string()).dictionary_encode()
            number = names.indices.to_numpy()
            if counted:
                groups, n = np.unique((own << 32) | number, return_counts=True)
                own, names = groups >> 32, names.dictionary.take(pa.array(groups & 0xFFFFFFFF))
            text = [pa.array(docs, kind).take(pa.array(own)), pa.array(np.array(fields, np.int32)[own])]
            if counted:
                yield pa.RecordBatch.from_arrays([*text, names, pa.array(n, pa.int64())], names=["doc_id", "nth", "name", "n"])
                continue
            together = pa.array(np.argsort(number, kind="stable"))
            bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(number, minlength=len(names.dictionary)))]), pa.int32())
            places = [pa.ListArray.from_arrays(bounds, x.take(together)) for x in (*text, pa.array(begin, pa.int32()))]
            yield pa.RecordBatch.from_arrays([names.dictionary, *places], names=["name", "doc_ids", "nths", "starts"])

    return run


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def _word_marks():
    """A function that tells which code points are word characters; it looks at each different one once."""
    import numpy as np

    unknown = 2
    table = np.full(BETWEEN + 1, unknown, np.uint8)
    table[BETWEEN] = 0

    def marks(points):
        for p in np.unique(points[table[points] == unknown]).tolist():
            table[p] = _is_word(chr(p))
        return table[points] == 1

    return marks


def _dictionary(names: DataFrame) -> DataFrame:
    return materialize(names.select("name").filter("name <> ''").distinct())  # read several times


def occurrences(texts: DataFrame, names: DataFrame, word_boundary: bool = False) -> DataFrame:
    """texts (doc_id, one column a field), names (name), distinct -> (doc_id, nth field, start, end, name): every
    occurrence of every name, overlapping ones too; null texts have none. The driver sees the lengths that names
    have and a filter of at most MOST_BITS bits. All places that the filter lets through are shuffled by name."""
    names = _dictionary(names)
    return _occurrences(texts, names, _filter_of(names), word_boundary)


def _occurrences(texts: DataFrame, names: DataFrame, known, word_boundary: bool) -> DataFrame:
    kind = dict(texts.dtypes)["doc_id"]
    found = texts.mapInArrow(_places_of(_candidates(known, len(texts.columns) - 1, word_boundary)), f"doc_id {kind}, nth int, start int, end int, name string")
    return found.join(names, "name", "left_semi").select("doc_id", "nth", "start", "end", "name")


def _wrong(texts: DataFrame, names: DataFrame, known, word_boundary: bool) -> frozenset | None:
    """What the filter lets through of the texts although it isn't a name; None if that is more than LISTED."""
    seen = texts.mapInArrow(_names_of(_candidates(known, len(texts.columns) - 1, word_boundary)), "name string").distinct()
    wrong = seen.join(names, "name", "left_anti").limit(LISTED + 1).collect()
    return frozenset(r["name"] for r in wrong) if len(wrong) <= LISTED else None


def links(texts: DataFrame, names: DataFrame, mode: str = "earliest", word_boundary: bool = False) -> DataFrame:
    """occurrences() without overlaps in a text: leftmost first, of those that begin together the one that ends first
    ('earliest') or last ('longest'). Each row has places of a name, (name, doc_ids, nths, starts), so that joins by name are cheap;
    places() tells them apart. texts are read twice, and must be the same then."""
    names = _dictionary(names)
    known = _filter_of(names)
    wrong = _wrong(texts, names, known, word_boundary)
    if wrong is None:
        found = _met(texts, names, known, mode, word_boundary)
        return found.select("name", F.array("doc_id").alias("doc_ids"), F.array("nth").alias("nths"), F.array("start").alias("starts"))
    kind = dict(texts.dtypes)["doc_id"]
    run = _spans_of(_candidates(known, len(texts.columns) - 1, word_boundary), wrong, mode, False)
    return texts.mapInArrow(run, f"name string, doc_ids array<{kind}>, nths array<int>, starts array<int>")


def places(found: DataFrame) -> DataFrame:
    """A row (doc_id, nth, start, end, and the other columns) for each place of links()."""
    others = [c for c in found.columns if c not in ("doc_ids", "nths", "starts")]
    rows = found.select(*others, F.inline(F.arrays_zip("doc_ids", "nths", "starts"))).toDF(*others, "doc_id", "nth", "start")
    return rows.select("doc_id", "nth", "start", (F.col("start") + F.length("name")).alias("end"), *others)


def counts(texts: DataFrame, names: DataFrame, mode: str = "earliest", word_boundary: bool = False) -> DataFrame:
    """(doc_id, nth, name, n) of links(), counted in the text; only rows with the hash of an id that repeats are added up by a shuffle."""
    names = _dictionary(names)
    known = _filter_of(names)
    wrong = _wrong(texts, names, known, word_boundary)
    if wrong is None:
        return _met(texts, names, known, mode, word_boundary).groupBy("doc_id", "nth", "name").agg(F.count(F.lit(1)).alias("n"))
    kind = dict(texts.dtypes)["doc_id"]
    run = _spans_of(_candidates(known, len(texts.columns) - 1, word_boundary), wrong, mode, True)
    own, shared = (rows.mapInArrow(run, f"doc_id {kind}, nth int, name string, n long") for rows in by_own_ids(texts, "doc_id"))
    return own.unionByName(shared.groupBy("doc_id", "nth", "name").agg(F.sum("n").alias("n")))


def _met(texts: DataFrame, names: DataFrame, known, mode: str, word_boundary: bool) -> DataFrame:
    """links() where places meet the dictionary in a join, and those of a text each other in a shuffle."""
    # rows are told apart by a number of their own, as ids may repeat
    rows = texts.withColumn("doc_id", F.struct(F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("row")))
    rows = materialize(rows)  # numbers stay what they are if a task runs again
    found = spans(_occurrences(rows, names, known, word_boundary), mode)
    return found.withColumn("doc_id", F.col("doc_id.id"))


def _kept(batches):
    """Of occurrences in order those that don't overlap an earlier one that is kept. What begins behind all before it is kept
    anyway; only the others are looked at one by one."""
    import numpy as np
    import pyarrow as pa

    last, at = None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        doc = batch.column("doc_id")
        doc = doc.field("row") if pa.types.is_struct(doc.type) else doc
        code = doc.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        nth, start, end = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("nth", "start", "end"))
        new = np.concatenate([[(doc[0].as_py(), int(nth[0])) != last], (code[1:] != code[:-1]) | (nth[1:] != nth[:-1])])
        at = 0 if new[0] else at
        group = np.cumsum(new) << 32
        behind = np.concatenate([[group[0] + at], np.maximum.accumulate(np.maximum(group + end, group[0] + at))[:-1]])
        keep = new | (group + start >= behind)
        before = np.maximum.accumulate(np.where(keep, np.arange(n), -1))
        own = -2
        for i in np.flatnonzero(~keep).tolist():
            if before[i] != own:
                own = before[i]
                at = int(end[own]) if own >= 0 else at
            if start[i] >= at:
                keep[i], at = True, int(end[i])
        last = (doc[n - 1].as_py(), int(nth[n - 1]))
        latest = np.flatnonzero(keep)
        at = int(end[latest[-1]]) if len(latest) else at  # a group's first row is kept, or begins in the batch before
        yield batch.filter(pa.array(keep))


def spans(found: DataFrame, mode: str = "earliest") -> DataFrame:
    """occurrences() without overlaps: leftmost first, of those that begin together the one that ends first
    ('earliest') or last ('longest'). Rows stream through in order, so no document's are held together. Documents with
    the same id count as one: make ids distinct, or structs with a number `row` of their own."""
    order = F.desc("end") if mode == "longest" else F.asc("end")
    return found.repartition("doc_id", "nth").sortWithinPartitions("doc_id", "nth", "start", order).mapInArrow(_kept, found.schema)

