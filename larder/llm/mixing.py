"""Language-model scores by online logistic context mixing, and an add-0.1 unigram base.

Tokens are the words of the lower-cased text and an end. A token's symbol has two parts: its class, told in
five binary decisions, and its place in the class. Classes are ranks of frequent words by powers of
two, one for all rarer and unknown words, and one for the end. Each of these decisions is predicted
from several hashed contexts (one and two classes before, the word before, place in the text and class
before), whose counts are gathered from all training texts. All weights are chosen by a gate, are the
same for each text at its start, and learn within it.

Where other training texts go on from the two words before, a first binary decision says whether they ever
go on with this token: it's predicted from how often they have been there and from how long their
predictions have held, mixed in the logistic domain, and refined by what came true when this much was
predicted before in the text. The token's probability is what both ways give it: that much of its share
among their continuations, and the rest of its class and place. Continuations are counted by some bits of the next word's hash; its share
among the words that have these bits, by their counts, is its own. So the probabilities of all words, of the unknown
one and of the end add up to one.

Two words and what follows them are counted for the whole corpus, in a distributed table that grows with
it: portions of texts ask buckets of hashes, once a portion and continuation. So do rare words for their
counts. A training text is scored without its own counts of two words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, worker_cache

#: Words with a class by rank, at most, and the least count of one; the classes; bits of a class.
FREQUENT, LEAST = 1 << 17, 4
RARE, END, START, LEVELS = 17, 18, 19, 5
#: Contexts of each predictor: class before, two classes before, word before (hashed), place and class before.
SPACES = (32, 1024, 1 << 14, 16 * 32)
SLOTS, CHUNK = 32 * sum(SPACES), 1 << 11
#: Tokens between weight updates at most. First weights and learning rates by token, of classes and of continuations.
STRETCH, FIRST, RATE = 8, 0.3, 0.02 / 64
FIRST_HITS, RATE_HITS = (0.4, 0.7, 0.0), 0.004
#: Steps of a refined prediction over a range of stretched ones, how fast they move, and their weight beside the mixed one.
STEPS, REACH, MOVE, TRUST = 17, 4.0, 0.02, 0.5
#: Words of a portion of texts; entries that portions send to a bucket, together; bits of a word in a continuation.
PORTION, ASKED, WORD = 1 << 19, 1 << 21, 12


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hash(word: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    h = xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


#: The end's key; no word holds a space.
END_WORD = b" "


class Vocabulary:
    """Frequent words by the hash of their bytes: number in the order of rank."""

    def __init__(self, hashes, counts, total: int, distinct: int, single: int, ends: int):
        import numpy as np

        self.hashes, self.counts = np.array(hashes, np.int64), np.array(counts, np.float64)
        self.total, self.distinct, self.single, self.ends = total, distinct, single, ends
        n = len(self.hashes)
        self.rare = total - ends - int(self.counts.sum())  # training tokens of rare words
        self.order = np.argsort(self.hashes)
        classes = np.minimum(np.floor(np.log2(np.arange(n) + 1)).astype(np.int64), RARE - 1)
        mass = np.bincount(classes, self.counts, minlength=32)
        # numbers: words, then rare, end, start
        self.classes = np.concatenate([classes, [RARE, END, START]]).astype(np.int64)
        used = np.zeros(32, np.int64)
        used[[*classes.tolist(), RARE, END]] = 1
        #: nodes of the class tree with words on both sides; at others there is nothing to tell
        self.free = np.concatenate([[False], *((used.reshape(-1, 2, 16 >> level).max(2).sum(1) == 2) for level in range(LEVELS))])
        self.within = np.concatenate([np.log10(self.counts / mass[classes]) if n else [], [0.0, 0.0, 0.0]])
        self.base = np.concatenate([self.smoothed(self.counts), [0.0, self.smoothed(np.array(ends))[()], 0.0]])
        # words never seen are one rare symbol, as likely as words seen once are among rare ones
        self.unknown = min(max(single / self.rare, 1e-9), 1 - 1e-9) if self.rare else 1.0

    def smoothed(self, counts):
        """The base's log10 probability of words with these counts."""
        import numpy as np

        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def numbers(self, hashes):
        """Numbers of words, the first of which is the end."""
        import numpy as np

        n = len(self.hashes)
        out = np.full(len(hashes), n)
        if n:
            at = self.order[np.minimum(np.searchsorted(self.hashes, hashes, sorter=self.order), n - 1)]
            out = np.where(self.hashes[at] == hashes, at, n)
        out[:1] = n + 1
        return out


# -- portions ------------------------------------------------------------------------------------


def pack(*arrays) -> bytes:
    """Arrays as one compressed value, byte by byte of their numbers."""
    import numpy as np
    import pyarrow as pa

    raw = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in arrays)
    head = np.array([len(raw), *map(len, arrays)], "<i8").tobytes()
    return head + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack(blob: bytes, *kinds):
    import numpy as np
    import pyarrow as pa

    size, *lens = np.frombuffer(blob, "<i8", len(kinds) + 1).tolist()
    raw = np.frombuffer(pa.decompress(blob[8 * len(kinds) + 8 :], decompressed_size=size, codec="zstd", asbytes=True) if size else b"", np.uint8)
    out, at = [], 0
    for kind, n in zip(kinds, lens):
        kind = np.dtype(kind)
        out.append(np.ascontiguousarray(raw[at : at + n * kind.itemsize].reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


SENT = "bucket long, portion long, data binary"


def _rows(rows):
    import pyarrow as pa

    cols = list(zip(*rows)) if rows else [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()))], names=["bucket", "portion", "data"])


def _portions(batches):
    """Rows (-1, portion, data): the texts of a portion as numbers of its distinct words, and these words' hashes."""
    import numpy as np
    from pyspark import TaskContext

    class Places(dict):
        def __missing__(self, word):
            self[word] = len(self)
            return len(self) - 1

    worker_cache()
    portion = TaskContext.get().partitionId() << 32

    def new():
        nonlocal find, held, size
        find, held, size = Places({END_WORD: 0}), [], 0

    def row():
        nonlocal portion
        words, told, ids, n_bytes = zip(*held)
        starts = np.cumsum([0, *map(len, words[:-1])])
        hashes = np.fromiter(map(word_hash, find), np.int64, len(find))
        data = pack(np.concatenate(words).astype("<u4"), hashes.astype("<i8"), starts.astype("<i8"), np.array(told, "u1"), np.array([i or 0 for i in ids], "<i8"), np.array([i is None for i in ids], "u1"), np.array(n_bytes, "<i8"))
        portion += 1
        return _rows([(-1, portion - 1, data)])

    find, held, size = None, [], 0
    new()
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            for i, text, taught in zip(*(c.to_pylist() for c in batch.slice(at, 500).columns)):
                own = tokens(text)
                held.append((np.fromiter(map(find.__getitem__, [*own, END_WORD]), np.int64, len(own) + 1), taught, i, len((text or "").encode("utf-8", "surrogatepass"))))
                size += len(own) + 1
                if size >= PORTION:
                    yield row()
                    new()
    if held:
        yield row()


class Texts:
    """The texts of a portion: words as places in `hashes`, the first word of each text, and so on."""

    def __init__(self, data: bytes):
        import numpy as np

        words, self.hashes, self.starts, told, ids, nulls, self.n_bytes = unpack(data, "<u4", "<i8", "<i8", "u1", "<i8", "u1", "<i8")
        self.words, self.told = words.astype(np.int64), told.astype(bool)
        self.ids = [None if none else i for i, none in zip(ids.tolist(), nulls.tolist())]
        self.lens = np.diff(np.append(self.starts, len(words)))
        self.doc = np.repeat(np.arange(len(self.starts)), self.lens)
        self.learnt = self.told[self.doc]

    def before(self, first):
        """The words one and two places before each word; `first` where there is none."""
        import numpy as np

        one = np.concatenate([[first], self.words[:-1]])
        one[self.starts] = first
        two = np.concatenate([[first], one[:-1]])
        two[self.starts] = first
        return one, two

    def continuations(self, bits: int):
        """A number for the two words before and the word of each token: `bits` of the former, WORD of the latter."""
        import numpy as np

        one, two = self.before(len(self.hashes))
        h = np.append(self.hashes.view(np.uint64), np.uint64(1))
        pair = stir(stir(h)[one] + h[two] * np.uint64(0xD6E8FEB86659FD93))
        return (pair >> np.uint64(64 - bits) << np.uint64(WORD)) | (stir(h) >> np.uint64(64 - WORD))[self.words]

    def rare(self, vocabulary: Vocabulary):
        """Hashes of the rare words in order, and their number in training texts."""
        import numpy as np

        at = np.flatnonzero(vocabulary.numbers(self.hashes) == len(vocabulary.hashes))
        n = np.bincount(self.words[self.learnt], minlength=len(self.hashes))[at]
        order = np.argsort(self.hashes.view(np.uint64)[at])
        return self.hashes.view(np.uint64)[at][order], n[order]

    def contexts(self, vocabulary: Vocabulary):
        """Each token's contexts as places in the table, one row a predictor, its class and the one before."""
        import numpy as np

        numbers = vocabulary.numbers(self.hashes)
        one, two = self.before(len(self.hashes))
        classes = np.append(vocabulary.classes[numbers], START)
        c, a, b = classes[self.words], classes[one], classes[two]
        place = np.minimum(np.log2(np.arange(len(c)) - np.repeat(self.starts, self.lens) + 1).astype(np.int64), 15)
        word = (stir(np.append(self.hashes.view(np.uint64), np.uint64(1))) & np.uint64(SPACES[2] - 1)).astype(np.int64)[one]
        bases = np.cumsum([0, *SPACES])
        return [32 * (row + base) for row, base in zip((a, a * 32 + b, word, place * 32 + a), bases)], c, a


def stir(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _counts(batches):
    """(hash, count) of the words of a portion's training texts."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for data in batch.column(0).to_pylist():
            t = Texts(data)
            n = np.bincount(t.words[t.learnt], minlength=len(t.hashes))
            yield pa.RecordBatch.from_arrays([pa.array(t.hashes[n > 0]), pa.array(n[n > 0])], names=["h", "n"])


def _dealt(keys, bits: int):
    """(bucket, first, last) of each bucket that sorted numbers fall in, by their upper bits; `bits`: (all, of the bucket)."""
    import numpy as np

    edges = np.searchsorted(keys >> np.uint64(bits[0] - bits[1]), np.arange((1 << bits[1]) + 1, dtype=np.uint64))
    for bucket in np.flatnonzero(np.diff(edges)).tolist():
        yield bucket, int(edges[bucket]), int(edges[bucket + 1])


def _ask(vocabulary: Vocabulary, of_pair: int, bits: int):
    """Rows (bucket, portion, data): the distinct continuations of each portion and its rare words, in order,
    with their number in training texts, dealt to buckets (rare words' come after); and from each
    task the class counts of the contexts, in chunks."""

    def run(batches):
        import numpy as np

        counts = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for portion, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t, out = Texts(data), []
                rows, c, _ = t.contexts(vocabulary)
                for r in rows:
                    counts += np.bincount((r + c)[t.learnt], minlength=SLOTS)
                every = t.continuations(of_pair)
                known = np.sort(every)
                first = np.flatnonzero(np.append(True, known[1:] != known[:-1]))
                known, n = known[first], np.diff(np.append(first, len(known)))
                np.subtract.at(n, np.searchsorted(known, every[~t.learnt]), 1)
                for bucket, lo, hi in _dealt(known, (of_pair + WORD, bits)):
                    out.append((bucket, portion, pack(np.diff(known[lo:hi], prepend=np.uint64(0)), n[lo:hi].astype("<u4"))))
                rare, n = t.rare(vocabulary)
                for bucket, lo, hi in _dealt(rare, (64, bits)):
                    out.append((bucket + (1 << bits), portion, pack(np.diff(rare[lo:hi], prepend=np.uint64(0)), n[lo:hi].astype("<u4"))))
                yield _rows(out)
        yield _rows([(-1 - at // CHUNK, -1, pack(counts[at : at + CHUNK])) for at in range(0, SLOTS, CHUNK) if counts[at : at + CHUNK].any()])

    return run


def _answer(bits: int):
    """Rows of a bucket -> for each portion, the totals of what it asked for: of continuations, and of their
    two words; of rare words. Chunks of counts are added up as they come."""

    def run(batches):
        import numpy as np

        key, held, total = None, [], None

        def answered():
            if key < 0:
                return _rows([(key, -1, pack(total))])
            asked = [unpack(data, "<u8", "<u4") for _, data in held]
            known, where = np.unique(np.concatenate([np.cumsum(d, dtype=np.uint64) for d, _ in asked]), return_inverse=True)
            each = np.bincount(where, np.concatenate([n for _, n in asked]), minlength=len(known)).astype(np.int64)
            columns = [each]
            if key < 1 << bits:
                pair = known >> np.uint64(WORD)
                first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
                columns.append(np.repeat(np.add.reduceat(each, first), np.diff(np.append(first, len(pair)))))
            ends = np.cumsum([len(d) for d, _ in asked])
            return _rows([(key, portion, pack(*(x[where[end - len(d) : end]].astype("<i8") for x in columns))) for (portion, _), (d, _), end in zip(held, asked, ends)])

        for batch in batches:
            for bucket, portion, data in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != key:
                    if key is not None:
                        yield answered()
                    key, held, total = bucket, [], 0
                if bucket < 0:
                    total = total + unpack(data, "<i8")[0]
                else:
                    held.append((portion, data))
        if key is not None:
            yield answered()

    return run


def _gathered(batches):
    """(texts, rows (bucket, data) of the answers in order) of each portion."""
    held, current = [], None
    for batch in batches:
        for bucket, portion, data in zip(*(c.to_pylist() for c in batch.columns)):
            if portion != current and held:
                yield Texts(held[0][1]), held[1:]
                held = []
            current = portion
            held.append((bucket, data))
    if held:
        yield Texts(held[0][1]), held[1:]


# -- scores --------------------------------------------------------------------------------------


def predictors(counts):
    """Class counts of each context -> stretched probability of a one for each node of the class tree."""
    import numpy as np

    c = counts.reshape(-1, 32).astype(np.float64)
    out = np.zeros_like(c, np.float32)
    for level in range(LEVELS):
        width = 32 >> level
        halves = c.reshape(len(c), -1, 2, width // 2).sum(3)
        p = (halves[:, :, 1] + 0.2) / (halves.sum(2) + 0.4)
        # nodes of a level are numbered from 2^level
        out[:, (1 << level) : (2 << level)] = np.clip(np.log(p / (1 - p)), -12, 12)
    return out.reshape(-1)


def mix(decisions, starts, lens, first, rate, refine: bool = False):
    """log10 probability of each token's binary decisions, mixed online in each text.

    decisions: a function of tokens' places that gives, for each decision of a token, its inputs, its
    bit, its gate and whether there is anything to tell (None: always). first: (gates, inputs), the weights
    that each text begins with; they change after each stretch of tokens, which is no longer than what is
    before it. refine: each text keeps, for steps of the mixed prediction, what came true there, and what
    it says of the two nearest steps is averaged with the mixed one.
    """
    import numpy as np

    total = np.zeros(int(lens.sum()))
    own = np.repeat(first[None], len(lens), 0)
    gates, k = first.shape
    levels = 1 / (1 + np.exp(-np.linspace(-REACH, REACH, STEPS)))
    refined = np.tile(levels, (len(lens), gates, 1)) if refine else None
    order = np.argsort(-lens, kind="stable")
    alive = lens[order]
    at, width = 0, 0
    while len(alive) and (at := at + width) < int(alive[0]):
        width = min(max(at, 1), STRETCH)
        live = order[: int(np.searchsorted(-alive, -at))]  # texts with tokens left
        size = np.minimum(lens[live] - at, width)
        doc = np.repeat(np.arange(len(live)), size)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[live] + at, size)
        weights = own[live].reshape(-1, k)
        change = np.zeros_like(weights)
        if refine:
            steps = refined[live].reshape(-1)
        for x, bit, gate, free in decisions(place):
            row = doc * gates + gate
            w = weights[row]
            z = np.clip(sum(w[:, i] * x[i] for i in range(k)), -20, 20)
            p = 1 / (1 + np.exp(-z))
            told = p
            if refine:
                at_step = (np.clip(z, -REACH, REACH) + REACH) * ((STEPS - 1) / (2 * REACH))
                low = np.minimum(at_step.astype(np.int64), STEPS - 2)
                part = at_step - low
                cell = row * STEPS + low
                told = (1 - TRUST) * p + TRUST * (steps[cell] * (1 - part) + steps[cell + 1] * part)
                near = cell + (part > 0.5)
                n = np.bincount(near, minlength=len(steps))
                seen = np.bincount(near, bit, minlength=len(steps))
                moved = 1 - (1 - MOVE) ** n
                steps += moved * (seen / np.maximum(n, 1) - steps)
            logs = np.log10(np.where(bit, told, 1 - told))
            error = bit - p
            if free is not None:
                logs, error = np.where(free, logs, 0.0), np.where(free, error, 0.0)
            total[place] += logs
            for i in range(k):
                change[:, i] += np.bincount(row, error * x[i], minlength=len(change))
        own[live] += rate * change.reshape(len(live), gates, k)
        if refine:
            refined[live] = steps.reshape(len(live), gates, STEPS)
    return total


def class_decisions(rows, c, a, table, both):
    """The five decisions of each token's class; gates: level, and whether the class before was the rare one.
    both: which nodes have words on both sides."""
    import numpy as np

    slow = (a == RARE).astype(np.int64)

    def decide(place):
        cls, gate = c[place], slow[place]
        context = [row[place] for row in rows]
        for level in range(LEVELS):
            node = (1 << level) + (cls >> (LEVELS - level))
            yield [table[row + node] for row in context], ((cls >> (LEVELS - 1 - level)) & 1).astype(bool), 2 * level + gate, both[node]

    return decide


def hit_decisions(times, hit, run):
    """One decision a token: do others go on with it, who have been there `times` and whose last `run`
    predictions held (below zero: failed)? Gate: whether the last one held."""
    import numpy as np

    sure = np.log(np.minimum(times, 1 << 20) + 0.5)
    lately = np.sign(run) * np.log1p(2 * np.minimum(np.abs(run), 1 << 10))

    def decide(place):
        yield [sure[place], lately[place], np.ones(len(place))], hit[place], (run[place] > 0).astype(np.int64), None

    return decide


def runs(hit, starts, lens):
    """Of each decision, how many before it in its text held in a row, or failed (below zero); 0 at first."""
    import numpy as np

    n = len(hit)
    change = np.ones(n, bool)
    change[1:] = hit[1:] != hit[:-1]
    change[starts[lens > 0]] = True
    at = np.arange(n)
    length = at - np.maximum.accumulate(np.where(change, at, 0)) + 1  # of the run that ends here
    out = np.zeros(n, np.int64)
    out[1:] = np.where(hit[:-1], length[:-1], -length[:-1])
    out[starts[lens > 0]] = 0
    return out


def others(t: Texts, every, total, pairs):
    """How often other training texts have been at each token's two words, and how often they went on with
    the token. every: continuations; total, pairs: of the distinct ones in order, in all training texts."""
    import numpy as np

    known, where = np.unique(every, return_inverse=True)
    went, been = total[where], pairs[where]
    own = np.flatnonzero(t.learnt & (been > 1))  # else only the text itself was there
    went[t.learnt], been[t.learnt] = went[t.learnt] - 1, been[t.learnt] - 1
    if len(own):
        order = own[np.lexsort((where[own], t.doc[own]))]
        for values, into in ((where, went), ((known >> np.uint64(WORD))[where], been)):
            first = np.flatnonzero(np.append(True, (np.diff(values[order]) != 0) | (np.diff(t.doc[order]) > 0)))
            times = np.diff(np.append(first, len(order)))
            into[order] -= np.repeat(times - 1, times)
    return been, went


def word_bits(hashes):
    """The WORD bits by which continuations tell words."""
    import numpy as np

    return (stir(hashes.view(np.uint64)) >> np.uint64(64 - WORD)).astype(np.int64)


def score_portion(t: Texts, *model):
    """(known tokens, base score, score) of each text."""
    import numpy as np

    known, base, score = (np.add.reduceat(x, t.starts) for x in token_scores(t, *model))
    return known.astype(np.int64), base, score


def token_scores(t: Texts, answers, vocabulary: Vocabulary, table, alike, of_pair: int, bits: int):
    """(whether it is known, base score, score) of each token. alike: by word bits, the training tokens of all words that have them."""
    import numpy as np

    def joined(rows, n):
        got = [unpack(data, *["<i8"] * n) for _, data in rows]
        return [np.concatenate([np.zeros(0, np.int64), *(g[i] for g in got)]) for i in range(n)]

    been, went = others(t, t.continuations(of_pair), *joined([r for r in answers if r[0] < 1 << bits], 2))
    (rare,) = joined([r for r in answers if r[0] >= 1 << bits], 1)
    # words: counts, base, and place in the class
    numbers = vocabulary.numbers(t.hashes)
    base, within, known = vocabulary.base[numbers], vocabulary.within[numbers], np.ones(len(numbers))
    count = np.concatenate([vocabulary.counts, [0.0, vocabulary.ends, 0.0]])[numbers]
    at = np.flatnonzero(numbers == len(vocabulary.hashes))
    at = at[np.argsort(t.hashes.view(np.uint64)[at])]
    base[at], known[at], count[at] = vocabulary.smoothed(rare), rare > 0, rare
    share = np.log10(np.maximum(rare, 1) * ((1 - vocabulary.unknown) / max(1, vocabulary.rare)) + (1e-300 if vocabulary.rare else 1.0))
    within[at] = np.where(rare > 0, share, np.log10(vocabulary.unknown))
    known[0] = vocabulary.ends > 0
    # by class and place
    rows, c, a = t.contexts(vocabulary)
    score = within[t.words] + mix(class_decisions(rows, c, a, table, vocabulary.free), t.starts, t.lens, np.full((2 * LEVELS, len(SPACES)), FIRST), RATE)
    # by continuations: where others have been, and whether they go on with the word
    own = count / np.maximum(alike[word_bits(t.hashes)], 1)
    asked = been > 0
    hit = ((went > 0) & (own[t.words] > 0))[asked]
    if len(hit):
        lens = np.add.reduceat(asked.astype(np.int64), t.starts)
        starts = np.cumsum(lens) - lens
        first = np.tile(np.array(FIRST_HITS), (2, 1))
        right = 10.0 ** mix(hit_decisions(been[asked], hit, runs(hit, starts, lens)), starts, lens, first, RATE_HITS, refine=True)
        go_on = np.where(hit, right, 1 - right)  # the probability that others go on with what comes
        told = np.where(hit, went[asked] / been[asked] * own[t.words[asked]], 0.0)
        score[asked] = np.log10(np.maximum(go_on * told + (1 - go_on) * 10.0 ** score[asked], 1e-300))
    return known[t.words], base[t.words], score


def _score(vocabulary: Vocabulary, table, alike, of_pair: int, bits: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for t, answers in _gathered(batches):
            known, base, score = score_portion(t, answers, vocabulary, table, alike, of_pair, bits)
            cols = [pa.array(t.ids, pa.int64()), pa.array(~t.told), *(pa.array(x) for x in (t.lens, known, base, score, score * -np.log2(10) / np.maximum(t.n_bytes, 1)))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "bits_per_byte"])

    return run


def _alike(batches):
    """(word bits, tokens) of a part of the words' counts."""
    import numpy as np
    import pyarrow as pa

    total = np.zeros(1 << WORD, np.int64)
    for batch in batches:
        total += np.bincount(word_bits(batch.column(0).to_numpy()), batch.column(1).to_numpy(), minlength=1 << WORD).astype(np.int64)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bits", "n"])


def training(id_col):
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 10 != 0, F.lit(True))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Counts come from all training rows. The driver and each task hold the FREQUENT commonest words and
    the SLOTS class counts of the contexts, which are of fixed size; counts of rare words and of all
    continuations of two words stay in buckets by hash, whose number grows with the corpus. A portion
    sends each of its words and continuations once, so a common one takes no more room in its bucket
    than portions. Texts are written once, as numbers of words, and meet the answers by portion.

    Null and empty texts are their end alone; very long ones are scored whole; repeated rows and tied ids each count and get their
    row; a null id is a training row; without training rows all counts are 0; an empty table gives
    no rows; other columns are ignored.
    """
    import numpy as np

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), training(F.col(id_col)).alias("taught"))
    texts = materialize(rows.mapInArrow(_portions, SENT))
    counts = materialize(texts.select("data").mapInArrow(_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")))
    end = word_hash(END_WORD)
    total, distinct, single, ends = (x or 0 for x in counts.agg(F.sum("c"), F.count(F.lit(1)), F.sum((F.col("c") == 1).cast("long")), F.sum(F.when(F.col("h") == end, F.col("c")))).first())
    # the highest steps of counts that together have at most FREQUENT words: no sort, no task's share of a top-k
    words = counts.filter((F.col("c") >= LEAST) & (F.col("h") != end)).withColumn("step", F.floor(F.log2("c") * 16).cast("int"))
    steps = {r["step"]: r["n"] for r in words.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()}  # 16 a power of two
    cut, held = max(steps, default=0) + 1, 0
    while cut - 1 >= min(steps, default=cut) and held + steps.get(cut - 1, 0) <= FREQUENT:
        cut -= 1
        held += steps.get(cut, 0)
    top = sorted(((r["c"], r["h"]) for r in words.filter(F.col("step") >= cut).select("c", "h").collect()), key=lambda x: (-x[0], x[1]))
    vocabulary = Vocabulary([h for _, h in top], [c for c, _ in top], total, distinct, single, ends)
    del top
    alike = np.zeros(1 << WORD, np.int64)
    for r in counts.mapInArrow(_alike, "bits long, n long").groupBy("bits").agg(F.sum("n").alias("n")).collect():  # as many as WORD bits tell
        alike[r["bits"]] = r["n"]
    least = docs.sparkSession.sparkContext.defaultParallelism
    bits = max(4, (int(total) // ASKED).bit_length())
    of_pair = min(64 - WORD, max(36, int(total).bit_length() + 10))  # pairs that differ rarely meet, however large the corpus
    parts = max(2 * least, 1 << bits)
    asked = texts.select("portion", "data").mapInArrow(_ask(vocabulary, of_pair, bits), SENT)
    answers = materialize(asked.repartition(parts, "bucket").sortWithinPartitions("bucket", "portion").mapInArrow(_answer(bits), SENT))
    del asked
    release(docs.sparkSession)  # what portions sent, once it is answered
    slots = np.zeros(SLOTS, np.int64)
    for r in answers.filter("bucket < 0").collect():  # SLOTS numbers in all
        own = unpack(r["data"], "<i8")[0]
        slots[(-1 - r["bucket"]) * CHUNK : (-1 - r["bucket"]) * CHUNK + len(own)] = own
    gathered = texts.unionByName(answers.filter("bucket >= 0")).repartition(max(4 * least, int(total) // (2 * PORTION)), "portion").sortWithinPartitions("portion", "bucket")
    scored = gathered.mapInArrow(_score(vocabulary, predictors(slots), alike, of_pair, bits), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte")
