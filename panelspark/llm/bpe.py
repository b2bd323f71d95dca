"""Byte-pair encoding: vocabularies read from public tokenizer files, and two merge loops in plain Python.

Both loops apply, again and again, the merge of lowest rank among adjacent parts (the leftmost of equal ones), which is
what the tokenizers library does. `rank_array_merge` suits short words, `heap_merge` any length.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import regex

SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same over ASCII alone, where Python's own engine is faster.
SPLIT_ASCII = r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
WORD_SPLIT_ASCII = r"'(?:[stmd]|re|ve|ll)|[a-z]+|[0-9]|[^\sa-z0-9]+"


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable letter by which byte-level vocabularies write each byte: itself where printable, else from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """ids by token, and by pair of tokens the (rank, merged token)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.ranks: dict[tuple[str, str], int] = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None

    def symbols(self, word: str) -> list[str]:
        """A word's first symbols: one for each byte, the last with the end-of-word suffix."""
        letters = byte_letters()
        parts = [letters[b] for b in word.encode()]
        if parts and self.suffix:
            parts[-1] += self.suffix
        return parts


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def rank_array_merge(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Merges by a contiguous array of ranks beside the part boundaries: find its minimum, delete a boundary, refresh the
    two neighbouring ranks. Each round scans the array, so the work is quadratic in the word's length."""
    none = len(ranks)
    get = ranks.get
    near = [get(p, none) for p in zip(parts, parts[1:])]
    while near:
        low = min(near)
        if low == none:
            break
        i = near.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del near[i]
        if i < len(near):
            near[i] = get((parts[i], parts[i + 1]), none)
        if i:
            near[i - 1] = get((parts[i - 1], parts[i]), none)
    return parts


def heap_merge(parts: list[str], ranks: dict[tuple[str, str], int]) -> tuple[list[str], list[int], int]:
    """Merges by a heap of (rank, place) over a linked list of parts; entries whose pair has changed are skipped when
    popped. Returns parts (None where merged away), the list's links and the number of merges."""
    n = len(parts)
    get = ranks.get
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i, p in enumerate(zip(parts, parts[1:])) if (r := get(p)) is not None]
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    merges = 0
    while heap:
        rank, i = pop(heap)
        left = parts[i]
        if left is None or (j := nxt[i]) >= n or get((left, parts[j])) != rank:
            continue
        parts[i] = left = left + parts[j]
        parts[j] = None
        merges += 1
        k = nxt[i] = nxt[j]
        if k < n:
            prv[k] = i
            if (r := get((left, parts[k]))) is not None:
                push(heap, (r, i))
        h = prv[i]
        if h >= 0 and (r := get((parts[h], left))) is not None:
            push(heap, (r, h))
    return parts, nxt, merges
