"""Cached tokenization: the ids of a text as little-endian unsigned 32-bit integers.

A text is cut at single spaces, where the vocabularies' pre-tokenizers always cut, and each piece
is looked up; pieces not seen before go through the pre-tokenizer's pattern and the BPE model of
the tokenizers library. A piece that has white space at an end, where a cut at a space need not
be one of the pattern's, makes the whole text take the plain path; so does the name of an added token
(such as <|endoftext|>) in a text, which the library turns into that token's id. The caches are
bounded: once full, they take no new entries.
"""

from __future__ import annotations

from .common import worker_cache

PIECES, WORDS = 300_000, 400_000
#: Unicode's White_Space, the patterns of the two vocabularies.
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BYTE_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t\n\x0b\x0c\r A-Za-z0-9]+|[\t\n\x0b\x0c\r ]+(?![^\t\n\x0b\x0c\r ])|[\t\n\x0b\x0c\r ]+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t\n\x0b\x0c\r a-z0-9]+"


def byte_letters() -> dict[int, int]:
    """Byte-level BPE's letter for each byte: printable ones stand for themselves, others follow from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


def tokenizer(path: str):
    from tokenizers import Tokenizer

    kept = worker_cache("tokens")
    if (key := ("tokenizer", path)) not in kept:
        kept[key] = Tokenizer.from_file(path)
    return kept[key]


def encoder(path: str):
    """text -> bytes of its ids, without special tokens; kept for the worker's life."""
    kept = worker_cache("tokens")
    if (key := ("encoder", path)) not in kept:
        kept[key] = _encoder(path)
    return kept[key]


def _encoder(path: str):
    import json
    import re

    from unicodedata import normalize

    import numpy as np
    import regex

    tok = tokenizer(path)
    said = json.loads(tok.to_str())
    spaced = (said.get("pre_tokenizer") or {}).get("type") == "ByteLevel"  # a piece has its space before it
    plain = lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    if not spaced and (said.get("model") or {}).get("end_of_word_suffix") != "</w>":
        return plain
    added = [(t.content, t.normalized) for t in tok.get_added_tokens_decoder().values()]
    names, folded = [c for c, normal in added if not normal], [c.lower() for c, normal in added if normal]
    letters, model, cut = byte_letters(), tok.model, frozenset(SPACE)
    wide, narrow = (regex.compile(BYTE_PATTERN), re.compile(BYTE_ASCII)) if spaced else (regex.compile(WORD_PATTERN), re.compile(WORD_ASCII))
    words: dict[str, bytes] = {}

    tokenize, pack = model.tokenize, np.array

    def word(w: str) -> bytes:
        ids = words.get(w)
        if ids is None:
            if w.isascii() and w.isalnum():
                raw = w
            else:
                raw = w.encode().decode("latin-1").translate(letters)
            ids = pack([t.id for t in tokenize(raw)], "<u4").tobytes()
            if len(words) < WORDS:
                words[w] = ids
        return ids

    def piece_ids(piece: str) -> bytes:
        if not spaced:
            if not piece.isascii():
                # a capital sigma's small form depends on the letters round it in Python alone
                piece = tok.normalizer.normalize_str(piece) if "Σ" in piece else normalize("NFC", piece).lower()
            else:
                piece = piece.lower()
        # letters only, or letters and one mark that ends a phrase, need no pattern
        lead, last = piece[:-1], piece[-1:]
        if piece.isalpha():
            return word(" " + piece if spaced else piece)
        if (last == "." or last == ",") and lead.isalpha():
            return word(" " + lead if spaced else lead) + word(last)
        if spaced:
            piece = " " + piece
        return b"".join([word(w) for w in (narrow if piece.isascii() else wide).findall(piece)])

    class Pieces(dict):
        def __missing__(self, piece):
            # None: the text takes the plain path (joining the pieces raises TypeError)
            ids = None if spaced and (not piece or piece[0] in cut or piece[-1] in cut) else piece_ids(piece)
            if len(self) < PIECES:
                self[piece] = ids
            return ids

    find, join = Pieces().__getitem__, b"".join

    def encode(text: str) -> bytes:
        if any(name in text for name in names) or folded and any(name in text.lower() for name in folded):
            return plain(text)
        pieces = text.split(" ")
        try:
            if not spaced:
                return join(map(find, pieces))
            # the first piece has no space before it
            first = pieces[0]
            head = join([word(w) for w in (narrow if first.isascii() else wide).findall(first)]) if first and first[-1] not in cut else plain(first) if len(pieces) == 1 else None
            del pieces[0]
            return head + join(map(find, pieces))
        except TypeError:
            return plain(text)

    return encode
