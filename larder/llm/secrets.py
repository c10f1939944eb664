"""Secret scan: three patterns, and password guess costs of values in a credential context."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "guess")
#: Fixed values of the query's contract.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What names a credential beyond the first pattern, and what its value may hold.
CONTEXT = r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|auth|bearer|signature)s?["']?[\x20\t]*(?:[:=]>?|\bis\b)[\x20\t]*["']?([^\s"'<>,;()\[\]{}|]{6,})"""
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "signature")
#: Common words of passwords, most common first; keyboard rows.
WORDS = "password admin welcome login letmein monkey dragon master hello secret shadow sunshine princess football baseball superman batman iloveyou trustno access flower summer winter spring autumn hunter ranger soccer hockey killer george andrew michael jordan harley thomas robert daniel charlie jessica ashley nicole test user guest root demo temp default change example private public server system token service backup database mysql oracle apache ubuntu linux windows google love money happy freedom ninja mustang pepper cheese cookie orange banana apple silver golden diamond purple yellow green blue black white red cat dog tiger lion eagle star moon sun key pass word auth user prod dev stage the and".split()
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "qazwsxedcrfvtgbyhnujm")
LEET = str.maketrans("4@3105$7", "aaeiosst")
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")


YEAR = re.compile(r"(?:19|20)\d\d")
#: All pairs of letters that follow each other in a row, either way.
NEIGHBOURS = frozenset(pair for row in ROWS for a, b in zip(row, row[1:]) for pair in (a + b, b + a))


#: Longest block whose repeats are seen as such.
BLOCK = 16


def load_words(path: str) -> dict[str, int]:
    """A dictionary from a tokenizer's vocabulary: WORDS, then its words of three letters or more, each
    with its rank from 2 on."""
    import json

    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    found = dict.fromkeys(WORDS)
    for token in sorted(vocabulary, key=vocabulary.get):
        word = re.sub(r"^[\u0120\u2581]|</w>$", "", token)
        if len(word) >= 3 and word.isascii() and word.isalpha():
            found.setdefault(word.lower())
    return {w: i for i, w in enumerate(found, 2)}


def _ranks() -> dict[str, int]:
    return {w: i for i, w in enumerate(dict.fromkeys(WORDS), 2)}


class Coster:
    """Costs in bits of a value's segments, each but a brute-force character costing one bit more."""

    def __init__(self, value: str, ranks: dict[str, int], longest: int):
        self.value, self.ranks, self.longest = value, ranks, longest
        low = value.lower()
        self.low = low if len(low) == len(value) else value
        self.plain = self.low.translate(LEET)
        classes = [26 * any("a" <= c <= "z" for c in value), 26 * any("A" <= c <= "Z" for c in value), 10 * any("0" <= c <= "9" for c in value), 33 * any(c.isascii() and not c.isalnum() for c in value), 100 * any(not c.isascii() for c in value)]
        self.brute = math.log2(max(2, sum(classes)))
        self.dates = {}
        for m in re.finditer(f"(?=({DATE.pattern}))|(?=((?:19|20)\\d\\d))", value):  # a date may begin anywhere
            for end in {m.end(1) if m[1] else -1, m.start() + 4 if YEAR.match(value, m.start()) else -1} - {-1}:
                self.dates.setdefault(m.start(), []).append(end)
        near = NEIGHBOURS
        self.near = [i > 0 and self.low[i - 1 : i + 1] in near for i in range(len(value))]

    def word(self, i: int, j: int) -> float:
        rank = self.ranks.get(self.plain[i:j]) if 3 <= j - i <= self.longest else None
        if not rank:
            return math.inf
        own = self.value[i:j]
        return 1 + math.log2(rank) + (own != own.lower()) * 2 + (self.low[i:j] != self.plain[i:j]) * 3

    def date(self, i: int, j: int) -> float:
        if j not in self.dates.get(i, ()):
            return math.inf
        return 1 + math.log2(365 * 130 if j - i > 4 else 130) + 2 * (not self.value[i:j].isdigit())

    def walk(self, i: int, j: int) -> float:
        return 1 + WALK + math.log2(j - i) if j - i >= 3 and all(self.near[i + 1 : j]) else math.inf

    def block(self, i: int, j: int) -> float:
        """Of a block that is repeated: as a word, a date, a walk, or by brute force."""
        return min(self.brute * (j - i), self.word(i, j), self.date(i, j), self.walk(i, j))

    def repeat(self, i: int, j: int) -> float:
        """The cheapest way to see i..j as a repeated block; three times at least if it's one character."""
        costs = [math.inf]
        for b in range(1, min(BLOCK, (j - i) // 2) + 1):
            n, rest = divmod(j - i, b)
            if not rest and n >= (3 if b == 1 else 2) and self.value[i : j - b] == self.value[i + b : j]:
                costs.append(1 + self.block(i, i + b) + math.log2(n))
        return min(costs)

    def segment(self, i: int, j: int) -> float:
        return min(self.brute if j - i == 1 else math.inf, self.word(i, j), self.date(i, j), self.walk(i, j), self.repeat(i, j))


WALK = math.log2(47 * 2)


class _Starts:
    """Where a run may be entered, cheapest first. A start is left out where an earlier one is never
    dearer: the run's cost grows with the logarithm of its length in `unit`s only."""

    def __init__(self, unit: int, least: int):
        self.unit, self.least, self.kept = unit, least, []

    def add(self, at: int, cost: float) -> None:
        kept = [(a, c) for a, c in self.kept if cost > c or a > at]  # later and not dearer: better for all ends
        if all(cost < c + math.log2(((at - a) / self.unit + self.least) / self.least) for a, c in kept):
            kept.append((at, cost))
        self.kept = kept

    def cut(self, first: int) -> None:
        self.kept = [x for x in self.kept if x[0] >= first]

    def best(self, end: int) -> float:
        return min((c + math.log2((end - a) / self.unit) for a, c in self.kept if end - a >= self.least * self.unit), default=math.inf)


def guess_bits(value: str, ranks: dict[str, int] | None = None) -> float:
    """log2 of the guesses for a value: the cheapest of all segmentations into dictionary words (any
    case, simple substitutions), dates, repeated blocks, keyboard walks and brute-force characters,
    each segment but the last kind costing one bit more. Linear in the value's length: of a run's
    many starts only those are kept that can still be the cheapest."""
    ranks = ranks or _ranks()
    longest = max(map(len, ranks))
    cost, n = Coster(value, ranks, longest), len(value)
    best = [0.0] + [math.inf] * n
    walks = _Starts(1, 3)
    blocks = {(b, r): _Starts(b, 3 if b == 1 else 2) for b in range(1, min(BLOCK, n // 2) + 1) for r in range(b)}
    date_ends: dict[int, list[int]] = {}
    for i, ends in cost.dates.items():
        for j in ends:
            date_ends.setdefault(j, []).append(i)
    for i in range(1, n + 1):
        best[i] = best[i - 1] + cost.brute
        # a start is weighed against earlier ones once it's known whether their run reaches it
        if not cost.near[i - 1]:
            walks.cut(i)
        walks.add(i - 1, best[i - 1] + 1 + WALK)
        best[i] = min(best[i], walks.best(i))
        for b in range(1, min(BLOCK, n // 2, i) + 1):
            if i > b and value[i - 1] != value[i - 1 - b]:
                for r in range(b):
                    blocks[b, r].cut(i - b)
            blocks[b, i % b].add(i - b, best[i - b] + 1 + cost.block(i - b, i))
            best[i] = min(best[i], blocks[b, i % b].best(i))
        for j in date_ends.get(i, ()):
            best[i] = min(best[i], best[j] + cost.date(j, i))
        for k in range(3, min(longest, i) + 1):
            best[i] = min(best[i], best[i - k] + cost.word(i - k, i))
    return best[n]


def scanner(least_bits: float = 36.0, ranks: dict[str, int] | None = None):
    """text -> spans (kind number, start, end), by start, then kind; the base kinds as they are, then
    values in a credential context whose guess cost is at least least_bits."""
    assign = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
    access, hexes = re.compile(ACCESS), re.compile(HEX)
    context = re.compile(CONTEXT, re.ASCII | re.IGNORECASE)

    def scan(text: str) -> list[tuple[int, int, int]]:
        found = []
        low = text.lower()
        if any(h in low for h in HINTS):
            found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
            found += [(m.start(1), 3, m.end(1)) for m in context.finditer(text) if guess_bits(m[1], ranks) >= least_bits]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in access.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in hexes.finditer(text)]
        return [(kind, start, end) for start, kind, end in sorted(found)]

    return scan


def _scan(least_bits: float, ranks):
    def run(batches):
        import hashlib

        import pyarrow as pa

        scan = scanner(least_bits, ranks)
        join = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = scan(text or "")
                base = [x for x in spans if x[0] < 3]
                n = [sum(x[0] == k for x in spans) for k in range(4)]
                rows.append((doc, *n[:3], hashlib.sha256(join(base).encode()).hexdigest(), join(spans), n[3]))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    return run


def scan_secrets(docs: DataFrame, least_bits: float = 36.0, id_col: str = "doc_id", text_col: str = "text", words: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess.

    words: the path, on the driver, of a tokenizer's vocabulary that serves as the dictionary of guess
    costs; without it the list WORDS does.

    A span is kind:start:end of the whole match in code points, end exclusive (for `guess`: of the
    value). Row by row, nothing is shuffled. A null or empty text has no spans; a very long one is scanned whole; repeated rows and
    ties each get their row; a null id stays null; an empty table gives no rows; other columns are
    ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan(least_bits, load_words(words) if words else None), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")
