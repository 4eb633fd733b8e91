"""Codes in Gray order under a hierarchy of shared bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from loomery.llm.common import slices

FAN, PAIRS = 8, 2_000_000


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchy over groups of codes, each group sorted by Gray rank.

    A node stands for up to FAN neighbours of the level below and holds the bits that all codes under it share (mask,
    pattern). The differences on shared bits only grow on the way down, so a node whose count is over the limit drops with
    everything below it.
    """

    def __init__(self, groups: np.ndarray, codes: np.ndarray):
        """groups: sorted; codes of a group stand in Gray order."""
        self.codes = codes
        starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
        sizes = np.diff(np.append(starts, len(codes)))
        self.group = np.repeat(np.arange(len(starts)), sizes)
        self.size = sizes[self.group]
        self.levels = []  # (first child, children, mask, pattern, last code)
        self.compared = 0  # codes that a search came to, of all pairs in all groups
        both, any_, last, counts, begin = codes, codes, np.arange(len(codes)), sizes, starts
        while not self.levels or counts.max() > 1:
            above = -(-counts // FAN)
            offset = np.concatenate([[0], np.cumsum(above)])[:-1]
            step = np.arange(above.sum()) - np.repeat(offset, above)
            first = np.repeat(begin, above) + FAN * step
            children = np.minimum(FAN, np.repeat(counts, above) - FAN * step)
            both, any_ = np.bitwise_and.reduceat(both, first), np.bitwise_or.reduceat(any_, first)
            last = last[first + children - 1]
            self.levels.append((first, children, ~(both ^ any_), both, last))
            counts, begin = above, offset

    def pairs(self, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Every pair of one group at limit differences or fewer, as places i < j."""
        for lo, hi in slices(self.size, PAIRS):
            query = np.arange(lo, hi)
            node = self.group[lo:hi]
            for first, children, mask, pattern, last in reversed(self.levels):
                near = (last[node] > query) & (np.bitwise_count((self.codes[query] ^ pattern[node]) & mask[node]) <= limit)
                query, node = query[near], node[near]
                many = children[node]
                inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                query, node = np.repeat(query, many), np.repeat(first[node], many) + inside
            near = node > query
            self.compared += int(near.sum())
            near &= np.bitwise_count(self.codes[query] ^ self.codes[node]) <= limit
            yield query[near], node[near]
