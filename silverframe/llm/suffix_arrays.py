"""Suffix arrays of a shard's blocks in numpy, and the windows of fixed length that they repeat."""

from __future__ import annotations

import numpy as np

_FIRST = 8


class ShardSuffixes:
    """Ranks of all suffixes by their first 8, 16, 32, ... characters, by Larsson-Sadakane refinement.

    A suffix's rank is the first place of its group in the suffix array. A round of refinement sorts only the
    groups that still have several members, by the rank of the suffix ``h`` further on, and doubles ``h``. The
    ranks of the first and the last round are what later steps use.
    """

    def __init__(self, data: np.ndarray, depth: int):
        self.data, self.n, pad = data, len(data), np.zeros(_FIRST, np.uint8)
        wide = np.concatenate([data, pad]).astype(np.uint64)
        key = np.zeros(self.n, np.uint64)
        for k in range(_FIRST):
            key = (key << np.uint64(8)) | wide[k : k + self.n]
        order = np.argsort(key)  # equal keys form a group, whatever their order
        head = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] + np.uint64(1)))
        rank = np.empty(self.n, np.int64)
        rank[order] = np.repeat(head, np.diff(np.append(head, self.n)))
        self.h, self.ranks = [_FIRST], [rank]
        while 2 * self.h[-1] <= depth:
            self.ranks.append(self._refine(self.ranks[-1], self.h[-1]))
            self.h.append(2 * self.h[-1])

    def at(self, level: int, i: np.ndarray) -> np.ndarray:
        """Rank at a level, -1 beyond the end."""
        return np.where(i < self.n, self.ranks[level][np.minimum(i, self.n - 1)], -1)

    def _refine(self, rank: np.ndarray, h: int) -> np.ndarray:
        size = np.bincount(rank, minlength=self.n)
        open_ = np.flatnonzero(size[rank] > 1)
        new = rank.copy()
        if not len(open_):
            return new
        r = rank[open_]
        ahead = np.where(open_ + h < self.n, rank[np.minimum(open_ + h, self.n - 1)], -1)
        order = np.argsort(r * (self.n + 1) + ahead + 1)
        r, ahead, who = r[order], ahead[order], open_[order]
        group = np.diff(r, prepend=-1) != 0
        part = group | (np.diff(ahead, prepend=-2) != 0)
        place = np.arange(len(r))
        first = np.maximum.accumulate(np.where(group, place, 0))
        new[who] = r + np.maximum.accumulate(np.where(part, place, 0)) - first
        return new

    def order(self, starts: np.ndarray, depth: int) -> np.ndarray:
        """``starts`` in the order of their suffixes' first ``depth`` characters."""
        top = self.h[-1]
        return starts[np.argsort(self.at(-1, starts) * (self.n + 1) + self.at(-1, starts + depth - top) + 1)]

    def common_prefixes(self, sa: np.ndarray, begin: np.ndarray, counts: np.ndarray, depth: int) -> np.ndarray:
        """Kasai's common prefixes of each suffix of ``sa`` with the one before it, up to ``depth`` (0 for the first).

        Block k holds the suffixes ``begin[k]`` to ``begin[k] + counts[k] - 1``. Kasai walks a block's suffixes in the order of
        the text: the prefix of the next is shorter by one at most, so only what follows is compared. All blocks walk side by side.
        The argument needs the neighbour's next suffix in ``sa``, and before it; where a block ends, or the prefix has
        the whole depth and the order after it is open, the count starts again.
        """
        before = np.full(self.n, -1, np.int64)
        before[sa[1:]] = sa[:-1]
        last = np.zeros(self.n, bool)
        last[begin + counts - 1] = True
        lanes = np.argsort(-counts, kind="stable")
        begin, counts = begin[lanes], counts[lanes]
        found, h, eight = np.zeros(self.n, np.int64), np.zeros(len(lanes), np.int64), self.ranks[0]
        left = np.searchsorted(-counts, -np.arange(1, int(counts.max(initial=0)) + 1), side="right")
        for step, m in enumerate(left.tolist()):
            i = begin[:m] + step
            j = before[i]
            h = np.where(j >= 0, np.maximum(h[:m] - 1, 0), 0)
            at = np.flatnonzero(j >= 0)
            while len(at):
                k = h[at]
                same = (k + _FIRST <= depth) & (eight[np.minimum(i[at] + k, self.n - 1)] == eight[np.minimum(j[at] + k, self.n - 1)])
                at = at[same]
                h[at] += _FIRST
            at = np.flatnonzero((j >= 0) & (h < depth))
            while len(at):
                at = at[self.data[i[at] + h[at]] == self.data[j[at] + h[at]]]
                h[at] += 1
                at = at[h[at] < depth]
            found[i] = h
            h = np.where(last[np.maximum(j, 0)] | (h >= depth), 0, h)
        return found[sa]


def repeated_windows(blocks: list[bytes], counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For the windows of all blocks, end to end (block k has ``counts[k]``): repeated in the shard or not, and class.

    A block has ``counts[k] + width - 1`` bytes, so windows don't leave their block. Windows of the same class are equal.
    """
    data = np.frombuffer(b"".join(blocks), np.uint8)
    sizes = np.array([len(x) for x in blocks], np.int64)
    begin = np.cumsum(sizes) - sizes
    total = int(counts.sum())
    starts = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(total)
    shard = ShardSuffixes(data, width)
    sa = shard.order(starts, width)
    with_previous = shard.common_prefixes(sa, begin[counts > 0], counts[counts > 0], width) >= width
    repeated = with_previous | np.append(with_previous[1:], False)
    where = np.empty(len(data), np.int64)
    where[starts] = np.arange(total)
    out, cls = np.zeros(total, bool), np.zeros(total, np.int64)
    out[where[sa]] = repeated
    cls[where[sa]] = np.cumsum(~with_previous) - 1
    return out, cls
