"""A minimal acyclic transducer: words to id sequences, with shared prefixes and suffixes, in one mapped file.

Each arc carries the number of words that come before it in its state, so the numbers added
on a word's path give its place in the sorted list (a minimal perfect hash); that place
leads to the word's ids.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterable

import numpy as np

_PARTS = (("first", "<i4"), ("label", "u1"), ("target", "<i4"), ("skip", "<i4"), ("final", "u1"), ("at", "<i4"), ("ids", "<i4"))


def compile_lexicon(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """The file of a lexicon; later entries of a repeated word are dropped.

    Words come in sorted order, so every state but those on the last word's path is finished;
    a finished state equal to an earlier one is replaced by it, which keeps the automaton minimal.
    """
    words = sorted(dict(reversed(list(entries))).items())
    arcs: list[list[list[int]]] = [[]]  # by state: [label, target]
    final = [0]
    register: dict[tuple, int] = {}
    path: list[int] = [0]
    last = b""

    def close(depth: int) -> None:
        """Share the states of the last word's path below depth."""
        while len(path) - 1 > depth:
            state = path.pop()
            key = (final[state], *map(tuple, arcs[state]))
            same = register.setdefault(key, state)
            if same != state:
                arcs[path[-1]][-1][1] = same

    for word, _ in words:
        shared = 0
        while shared < min(len(word), len(last)) and word[shared] == last[shared]:
            shared += 1
        close(shared)
        for byte in word[shared:]:
            arcs.append([])
            final.append(0)
            arcs[path[-1]].append([byte, len(arcs) - 1])
            path.append(len(arcs) - 1)
        final[path[-1]] = 1
        last = word
    close(0)

    order: list[int] = []  # states that are left, each after those that it leads to
    seen: set[int] = set()
    stack = [(0, False)]
    while stack:
        state, done = stack.pop()
        if done:
            order.append(state)
        elif state not in seen:
            seen.add(state)
            stack.append((state, True))
            stack += [(t, False) for _, t in arcs[state] if t not in seen]
    count: dict[int, int] = {}
    for state in order:
        count[state] = final[state] + sum(count[t] for _, t in arcs[state])
    number = {state: i for i, state in enumerate(reversed(order))}  # the root is 0
    out = {name: [] for name, _ in _PARTS}
    for state in reversed(order):
        out["first"].append(len(out["label"]))
        out["final"].append(final[state])
        before = final[state]
        for label, target in arcs[state]:
            out["label"].append(label)
            out["target"].append(number[target])
            out["skip"].append(before)
            before += count[target]
    out["first"].append(len(out["label"]))
    for _, ids in words:
        out["at"].append(len(out["ids"]))
        out["ids"] += ids
    out["at"].append(len(out["ids"]))
    parts = [np.asarray(out[name], kind).tobytes() for name, kind in _PARTS]
    return np.asarray([len(p) for p in parts], "<i8").tobytes() + b"".join(parts)


class Lexicon:
    """A lexicon's file, mapped: all processes of a machine share its pages."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self._map = mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ)
        sizes = np.frombuffer(self._map, "<i8", len(_PARTS))
        at = 8 * len(_PARTS)
        for (name, kind), size in zip(_PARTS, sizes.tolist(), strict=True):
            setattr(self, name, memoryview(self._map)[at : at + size].cast("B" if kind == "u1" else "i"))
            if name == "label":
                self._labels_at = at
            at += size
        self._ids = np.frombuffer(self.ids, np.int32)
        self._first = np.frombuffer(self.first, np.int32)
        of_state = np.repeat(np.arange(len(self._first) - 1), np.diff(self._first))
        self._keys = of_state * 256 + np.frombuffer(self.label, np.uint8)  # ascending, as words were sorted

    def __len__(self) -> int:
        return len(self.at) - 1

    def states(self) -> int:
        return len(self.first) - 1

    def get(self, word: bytes):
        """The word's ids as little-endian unsigned 32-bit bytes; None if the lexicon lacks it."""
        find, base, first, target, skip = self._map.find, self._labels_at, self.first, self.target, self.skip
        state = place = 0
        for i in range(len(word)):
            arc = find(word[i : i + 1], base + first[state], base + first[state + 1])
            if arc < 0:
                return None
            arc -= base
            place += skip[arc]
            state = target[arc]
        if not self.final[state]:
            return None
        return self._ids[self.at[place] : self.at[place + 1]].tobytes()

    def get_many(self, words: list[bytes]) -> list:
        """get() of each word, all walks a byte further at a time."""
        if not words or not len(self):
            return [None] * len(words)
        length = np.array([len(w) for w in words])
        start = np.cumsum(length) - length
        flat = np.frombuffer(b"".join(words), np.uint8)
        state, place = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live = np.arange(len(words))
        target, skip = np.frombuffer(self.target, np.int32), np.frombuffer(self.skip, np.int32)
        for step in range(int(length.max())):
            going = live[length[live] > step]
            if not len(going):
                break
            key = state[going] * 256 + flat[start[going] + step]
            arc = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
            hit = self._keys[arc] == key
            state[going[~hit]] = -1
            on, arc = going[hit], arc[hit]
            place[on] += skip[arc]
            state[on] = target[arc]
            live = on
        found = (state >= 0) & (np.frombuffer(self.final, np.uint8)[np.maximum(state, 0)] == 1)
        ids, at = self._ids, self.at
        return [ids[at[p] : at[p + 1]].tobytes() if ok else None for p, ok in zip(place.tolist(), found.tolist(), strict=True)]
