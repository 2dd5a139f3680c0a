"""A minimal acyclic transducer from words to token ids, in one flat buffer.

Words are put in in order of their bytes, and states with equal futures become
one as soon as no word can change them, so suffixes are shared. Each arc holds
how many words come before it at its state; the sum along a word's path is the
word's number, under which its ids are kept. The buffer is plain arrays, made to
be mapped into memory and shared by all workers of a machine.
"""

from __future__ import annotations

import mmap
import os
import struct
import tempfile
from collections.abc import Mapping
from hashlib import sha256

import numpy as np

HEADER = struct.Struct("<4sIIII")
MAGIC = b"rgfs"


def _minimal_states(words: list[bytes]) -> list[tuple[bool, tuple[tuple[int, int], ...]]]:
    """States (final, arcs by label), the last the root; an arc leads to an earlier state."""
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    known: dict[tuple[bool, tuple[tuple[int, int], ...]], int] = {}

    def settle(final: bool, arcs: list[tuple[int, int]]) -> int:
        key = (final, tuple(arcs))
        if key not in known:
            known[key] = len(states)
            states.append(key)
        return known[key]

    path: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]
    last = b""
    for word in [*words, None]:
        same = 0
        if word is not None:
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
        while len(path) - 1 > same:
            final, arcs = path.pop()
            path[-1][1].append((last[len(path) - 1], settle(final, arcs)))
        if word is None:
            break
        for _ in word[same:]:
            path.append((False, []))
        path[-1] = (True, path[-1][1])
        last = word
    root = (path[0][0], tuple(path[0][1]))
    if root in known:  # only where there is no word
        return states
    states.append(root)
    return states


def compile_lexicon(entries: Mapping[str, list[int]]) -> bytes:
    """The transducer for words and their ids, as bytes."""
    by_bytes = sorted((w.encode("utf-8"), ids) for w, ids in entries.items())
    states = _minimal_states([w for w, _ in by_bytes]) if by_bytes else [(False, ())]
    holds = [0] * len(states)
    first, labels, targets, skips, final = [0], bytearray(), [], [], bytearray()
    for i, (ends, arcs) in enumerate(states):
        below = int(ends)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            skips.append(below)
            below += holds[target]
        holds[i] = below
        final.append(ends)
        first.append(len(labels))
    offsets = np.cumsum([0, *(len(ids) for _, ids in by_bytes)]).astype("<u4")
    ids = np.fromiter((x for _, own in by_bytes for x in own), dtype="<u4")
    head = HEADER.pack(MAGIC, len(states), len(labels), len(by_bytes), len(ids))
    arrays = [np.array(first, "<u4"), np.array(targets, "<u4"), np.array(skips, "<u4"), offsets, ids]
    return head + b"".join(a.tobytes() for a in arrays) + bytes(labels) + bytes(final)


class Lexicon:
    """Looks words up in a compiled buffer, such as a memory map."""

    def __init__(self, buffer: bytes | mmap.mmap) -> None:
        magic, states, arcs, words, n_ids = HEADER.unpack_from(buffer, 0)
        if magic != MAGIC:
            raise ValueError("not a compiled lexicon")
        at = HEADER.size

        def array(n: int) -> memoryview:
            nonlocal at
            part = memoryview(buffer)[at : at + 4 * n].cast("I")
            at += 4 * n
            return part

        self.first, self.targets, self.skips, self.offsets, self.ids = array(states + 1), array(arcs), array(arcs), array(words + 1), array(n_ids)
        self.buffer, self.labels, self.final = buffer, at, at + arcs
        self.root, self.words, self.states = states - 1, words, states

    def get(self, word: bytes) -> memoryview | None:
        """The word's ids, or None if the lexicon doesn't have it."""
        state, number, find = self.root, 0, self.buffer.find
        first, base = self.first, self.labels
        for i in range(len(word)):
            arc = find(word[i : i + 1], base + first[state], base + first[state + 1])
            if arc < 0:
                return None
            arc -= base
            number += self.skips[arc]
            state = self.targets[arc]
        if not self.buffer[self.final + state]:
            return None
        return self.ids[self.offsets[number] : self.offsets[number + 1]]


def mapped(compiled: bytes) -> Lexicon:
    """The lexicon in a memory map of a file that workers of this machine share."""
    path = os.path.join(tempfile.gettempdir(), f"lexicon-{sha256(compiled).hexdigest()[:32]}.bin")
    if not os.path.exists(path) or os.path.getsize(path) != len(compiled):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        own = f"{path}.{os.getpid()}"
        with open(own, "wb") as file:
            file.write(compiled)
        os.replace(own, path)
    with open(path, "rb") as file:
        return Lexicon(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
