"""Sort of suffixes that are compared through prefix hashes.

A polynomial hash of every prefix gives the hash of any substring in constant
time; a binary search over lengths finds how far two suffixes agree, so one
comparison takes a logarithmic number of steps.  The mergesort runs over many
groups at once: at each level every element finds its rank in the neighbouring
run by binary search, with numpy vectors in place of loops.  Suffixes that the
hashes call equal are compared byte by byte afterwards.
"""

from __future__ import annotations

import numpy as np

from folioscope.llm.arrays import powers, prefix_hashes


class Suffixes:
    def __init__(self, data: np.ndarray):
        self.data = data
        self.prefix = prefix_hashes(data)
        self.undo = powers(len(data) + 1, inverse=True)

    def common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common beginning at a and b, ``most`` at most."""
        agreed = np.zeros(len(a), np.int64)
        if not len(a):
            return agreed
        pa, pb, ua, ub = self.prefix[a], self.prefix[b], self.undo[a], self.undo[b]
        step = 1 << (int(most.max()).bit_length() - 1) if most.max() > 0 else 0
        while step:
            tried = agreed + step
            inside = tried <= most
            reach = np.where(inside, tried, 0)
            same = (self.prefix[a + reach] - pa) * ua == (self.prefix[b + reach] - pb) * ub
            agreed = np.where(inside & same, tried, agreed)
            step >>= 1
        return agreed

    def less(self, a, la, b, lb, or_equal: np.ndarray) -> np.ndarray:
        most = np.minimum(la, lb)
        agreed = self.common(a, b, most)
        ended = agreed == most
        at = np.where(ended, 0, agreed)
        before = self.data[a + at] < self.data[b + at]
        by_length = np.where(la == lb, or_equal, la < lb)
        return np.where(ended, by_length, before)

    def order(self, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order that sorts by group and, inside a group, by the bytes."""
        order = np.argsort(group, kind="stable")
        sizes = np.diff(np.append(np.flatnonzero(np.diff(group[order], prepend=group[order][:1] - 1)), len(order))) if len(order) else np.zeros(0, int)
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        size = np.repeat(sizes, sizes)
        local = np.arange(len(order)) - begin
        run = 1
        while len(sizes) and run < sizes.max():
            at = np.flatnonzero(size > run)
            here, first, total = local[at], begin[at], size[at]
            left = (here // run) % 2 == 0
            pair = here // (2 * run) * (2 * run)
            low = np.where(left, np.minimum(pair + run, total), pair)
            high = np.where(left, np.minimum(pair + 2 * run, total), pair + run)
            base = low
            mine = order[at]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                other, own = order[first[open_] + middle], mine[open_]
                # rank of a left element: those strictly before it; of a right one: those not after it
                goes_on = self.less(start[other], length[other], start[own], length[own], ~left[open_])
                low = low.copy() if low is base else low
                low[open_] = np.where(goes_on, middle + 1, low[open_])
                high[open_] = np.where(goes_on, high[open_], middle)
            own_place = here - pair - np.where(left, 0, run)
            moved = order.copy()
            moved[first + pair + own_place + (low - base)] = mine
            order = moved
            run *= 2
        return order

    def classes(self, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Number of the class of equal strings each element belongs to, inside its group."""
        if not len(start):
            return np.zeros(0, np.int64)
        order = self.order(start, length, group)
        s, n, g = start[order], length[order], group[order]
        same = (g[1:] == g[:-1]) & (n[1:] == n[:-1])
        at = np.flatnonzero(same)
        same[at] = self.common(s[at], s[at + 1], n[at]) == n[at]
        at = np.flatnonzero(same)
        same[at] = self.equal_bytes(s[at], s[at + 1], n[at])
        number = np.concatenate(([0], np.cumsum(~same)))
        out = np.empty(len(start), np.int64)
        out[order] = number
        return out

    def equal_bytes(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The strings compared byte by byte, in blocks of bounded size."""
        out = np.ones(len(a), bool)
        block = max(1, (1 << 22) // max(int(length.max()) if len(length) else 1, 1))
        for low in range(0, len(a), block):
            x, y, n = a[low : low + block], b[low : low + block], length[low : low + block]
            begin = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(begin, n)
            differ = self.data[np.repeat(x, n) + place] != self.data[np.repeat(y, n) + place]
            filled = n > 0
            if filled.any():
                out[low : low + block][filled] = ~np.logical_or.reduceat(differ, begin[filled])
        return out
