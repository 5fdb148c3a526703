"""A bidirectional FM-index over a sequence of word ids.

The Burrows-Wheeler transform of a sequence and of its reverse answer, for any phrase, where it stands among the sorted suffixes of either:
a node is (start among the suffixes, start among the reversed prefixes, number of occurrences).  One step extends all
nodes of a set by every word that stands before (or after) them, and keeps both starts in step.  Suffixes are
sorted by their first ``depth`` words or a few more, which is enough for phrases of that length.

Id 0 is a break that no phrase crosses.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

#: Occurrences that are extended at once.
BLOCK = 1 << 16


def dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the distinct keys."""
    order = np.argsort(keys)
    new = np.ones(len(keys), dtype=np.int64)
    new[1:] = keys[order][1:] != keys[order][:-1]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """The places of ``text`` by the ``depth`` words, or a few more, that begin there."""
    rank, size = text, 1
    while True:  # the order by 2 * size words from ranks by size words; ids and ranks are below 2^31
        after = np.append(rank[size:], np.zeros(min(size, len(rank)), dtype=np.int64))
        keys = (rank << np.int64(32)) | after
        if 2 * size >= depth:
            return np.argsort(keys)
        rank, size = dense(keys), 2 * size


@dataclass
class Nodes:
    """Phrases that occur: their words, starts in the two indexes, and number of occurrences."""

    words: np.ndarray
    forward: np.ndarray
    backward: np.ndarray
    count: np.ndarray

    def __len__(self):
        return len(self.count)


class Index:
    """One direction: what precedes each sorted suffix, and where that suffix's extension by it stands."""

    def __init__(self, text: np.ndarray, depth: int):
        self.before = text[suffix_order(text, depth) - 1]  # the first place follows the last, which is a break
        place = np.arange(len(text))
        self.step = np.empty(len(text), dtype=np.int64)
        self.step[np.sort((self.before << np.int64(32)) | place) & np.int64(0xFFFFFFFF)] = place

    def extend(self, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(node, word, start here, offset in the other index, count) of each extension of each node."""
        block = (np.cumsum(count) - count) // BLOCK  # nodes whose occurrences begin in the same block go together
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(block)) + 1, [len(count)]))
        parts = [(a, self._extend(start[a:b], count[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        node, *rest = (np.concatenate(x) for x in zip(*((a + found[0], *found[1:]) for a, found in parts), strict=True))
        return node, *rest

    def _extend(self, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        total = int(count.sum())
        node = np.repeat(np.arange(len(count)), count)
        place = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
        word = self.before[place]
        order = np.argsort((node << np.int64(32)) | word)
        node, word, place = node[order], word[order], place[order]
        first = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (word[1:] != word[:-1]))) if total else np.zeros(0, np.int64)
        size = np.diff(np.append(first, total))
        offset = first - np.repeat(np.cumsum(count) - count, count)[first]  # smaller words of the same node come first
        keep = word[first] > 0
        lowest = np.minimum.reduceat(place, first)[keep] if total else place
        first, size, offset = first[keep], size[keep], offset[keep]
        return node[first], word[first], self.step[lowest], offset, size


class BidirectionalIndex:
    def __init__(self, text: np.ndarray, depth: int):
        """``text`` begins and ends with a break; phrases have up to ``depth`` words."""
        self.text, self.depth = text, depth

    @cached_property
    def forward(self) -> Index:
        return Index(self.text, self.depth)

    @cached_property
    def backward(self) -> Index:
        return Index(self.text[::-1], self.depth)

    def words(self) -> Nodes:
        """The single words that occur."""
        count = np.bincount(self.text)
        start = np.cumsum(count) - count
        found = np.flatnonzero(count)
        found = found[found > 0]
        return Nodes(found[:, None], start[found], start[found], count[found])

    def extended(self, nodes: Nodes, left: bool) -> Nodes:
        """All phrases that have one word more before (``left``) or after a phrase of ``nodes``."""
        here, other = (nodes.forward, nodes.backward) if left else (nodes.backward, nodes.forward)
        node, word, start, offset, count = (self.forward if left else self.backward).extend(here, nodes.count)
        there = other[node] + offset
        old = nodes.words[node]
        if left:
            return Nodes(np.column_stack([word, old]), start, there, count)
        return Nodes(np.column_stack([old, word]), there, start, count)

    def phrases(self):
        """The phrases of each length up to the depth, extended to the left and to the right by turns."""
        nodes = self.words()
        yield nodes
        for size in range(2, self.depth + 1):
            nodes = self.extended(nodes, left=size % 2 == 0)
            yield nodes
