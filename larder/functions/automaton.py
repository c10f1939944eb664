"""Names found in texts by an automaton: one pass, however many names there are."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Sequence


def _cache() -> dict:
    """Lives as long as the Python worker; functions that are shipped by value have new globals in each task."""
    return sys.modules.setdefault("_larder_names", types.ModuleType("_larder_names")).__dict__


def automaton_of(names: Sequence[str]):
    """An automaton of the names, built once a worker; its values are their numbers."""
    import ahocorasick

    key = hash(tuple(names))
    cache = _cache()
    if cache.get("names") != key:
        built = ahocorasick.Automaton()
        for i, name in enumerate(names):
            if name:
                built.add_word(name, i)
        built.make_automaton()
        cache["names"], cache["automaton"] = key, built
    return cache["automaton"]


def is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def finder(names: Sequence[str], mode: str = "earliest", word_boundary: bool = False) -> Callable[[str], list[tuple[int, int, int]]]:
    """text -> (start, end, number of the name), none overlapping: leftmost first, of those that begin
    together the one that ends first ('earliest') or last ('longest')."""
    built = automaton_of(names)
    if not len(built):
        return lambda text: []
    sizes, last = [len(n) for n in names], -1 if mode == "longest" else 1

    def find(text: str) -> list[tuple[int, int, int]]:
        hits = [(end - sizes[i] + 1, last * (end + 1), i) for end, i in built.iter(text)]
        if word_boundary:
            hits = [h for h in hits if not (h[0] and is_word(text[h[0] - 1])) and not (abs(h[1]) < len(text) and is_word(text[abs(h[1])]))]
        kept, at = [], 0
        for start, end, i in sorted(hits):
            if start >= at:
                at = abs(end)
                kept.append((start, at, i))
        return kept

    return find


def first_ends(names: Sequence[str]) -> Callable[[str], dict[int, int]]:
    """text -> number of each name in it and where its first occurrence ends."""
    built = automaton_of(names)

    def find(text: str) -> dict[int, int]:
        found: dict[int, int] = {}
        for end, i in built.iter(text) if len(built) else ():
            found.setdefault(i, end + 1)
        return found

    return find
