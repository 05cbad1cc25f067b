"""Two-stage suffix sorting of short byte slices, and their adjacent common prefixes (numpy).

Only suffixes smaller than their successor are sorted directly; every other
suffix is placed by scanning the buckets of first bytes in ascending order,
where the order of its successor is already known.  Order is right for the
first ``depth`` bytes; that is all that repeats of that length need.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


class Slices:
    """Byte slices laid out one after another, each followed by ``depth + 8`` zero bytes."""

    def __init__(self, slices: list[bytes], depth: int) -> None:
        self.depth = depth
        gap = bytes(depth + 8)
        self.data = np.frombuffer(gap.join(slices) + gap, dtype=np.uint8)
        self.size = np.fromiter(map(len, slices), dtype=np.int64, count=len(slices))
        self.begin = np.cumsum(self.size + depth + 8) - (self.size + depth + 8)
        n = len(self.data) - 8
        self.word = np.zeros(n, dtype=U)  # eight bytes from each place on, the first one highest
        for k in range(8):
            self.word = (self.word << U(8)) | self.data[k:k + n].astype(U)

    def sort_directly(self, places: np.ndarray) -> np.ndarray:
        """``places`` in the order of their first ``depth`` bytes (ties in the order given)."""
        rank = np.zeros(len(places), dtype=np.int64)
        order = np.arange(len(places))
        todo = order.copy()  # slots of ``order`` whose place is not settled
        for at in range(0, self.depth, 8):
            members = order[todo]
            key = self.word[places[members] + at]
            by = np.lexsort((key, rank[members]))
            members, key = members[by], key[by]
            order[todo] = members
            old = rank[members]
            new = np.empty(len(members), dtype=bool)
            new[:1] = True
            new[1:] = (old[1:] != old[:-1]) | (key[1:] != key[:-1])
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            rank[members] = todo[starts[group]]
            again = np.bincount(group)[group] > 1
            todo = todo[again]
            if not len(todo):
                break
        return places[order]

    def sort(self, counts: np.ndarray) -> np.ndarray:
        """The first ``counts[i]`` places of each slice, as suffixes in order."""
        data, n = self.data, len(self.data)
        differs = data[:-1] != data[1:]
        change = np.append(np.where(differs, np.arange(n - 1), n), n)  # next place whose byte differs from the one after
        change = np.minimum.accumulate(change[::-1])[::-1]
        last = np.minimum(change, n - 2)
        smaller = (change < n) & (data[last] < data[last + 1])  # suffix smaller than its successor
        wanted = np.zeros(n, dtype=bool)
        for_slice = np.repeat(self.begin, counts)
        wanted[for_slice + np.arange(len(for_slice)) - np.repeat(np.cumsum(counts) - counts, counts)] = True
        asked = wanted.copy()
        # a larger suffix needs its successor: go on to the next smaller one, or to the end of the slice
        stop = np.where(smaller, np.arange(n), n)
        stop = np.minimum.accumulate(stop[::-1])[::-1]
        tail = self.begin + counts - 1
        upto = np.minimum(stop[tail], self.begin + self.size)
        extra = upto - tail
        more = np.repeat(tail, extra) + np.arange(int(extra.sum())) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        wanted[more] = True
        closing = np.zeros(n, dtype=bool)
        closing[self.begin + self.size] = True
        direct = wanted & (smaller | closing)
        seeds = self.sort_directly(np.flatnonzero(direct & ~closing))
        seed_at = np.searchsorted(data[seeds], np.arange(257))
        induced: list[list[np.ndarray]] = [[] for _ in range(256)]

        def induce(placed: np.ndarray) -> np.ndarray:
            """Put the larger predecessors of placed suffixes into their buckets; those of the same bucket come back."""
            before = placed[placed > 0] - 1
            before = before[wanted[before] & ~smaller[before] & ~closing[before]]
            if not len(before):
                return before
            first = data[before]
            own = before[first == now]
            others = before[first != now]
            if len(others):
                by = np.argsort(data[others], kind="stable")
                others = others[by]
                cut = np.flatnonzero(np.diff(data[others])) + 1
                for part in np.split(others, cut):
                    induced[data[part[0]]].append(part)
            return own

        out: list[np.ndarray] = []
        now = -1
        induce(np.flatnonzero(wanted & closing))
        for now in range(256):
            fresh = np.concatenate(induced[now]) if induced[now] else np.empty(0, dtype=np.int64)
            while len(fresh):  # runs of one byte come round by round
                out.append(fresh)
                fresh = induce(fresh)
            own = seeds[seed_at[now]:seed_at[now + 1]]
            if len(own):
                out.append(own)
                induce(own)
        order = np.concatenate(out) if out else np.empty(0, dtype=np.int64)
        return order[asked[order]]

    def common_prefixes(self, order: np.ndarray) -> np.ndarray:
        """Bytes (at most ``depth``) that each suffix shares with the one before it; 0 for the first."""
        n = len(order)
        out = np.zeros(n, dtype=np.int64)
        todo = np.arange(1, n)
        for at in range(0, self.depth, 8):
            x = self.word[order[todo] + at] ^ self.word[order[todo - 1] + at]
            same = x == 0
            out[todo[same]] += 8
            # leading equal bytes of the first differing word
            rest, places = x[~same], todo[~same]
            lead = np.zeros(len(rest), dtype=np.int64)
            for k in range(1, 8):
                lead += (rest >> U(64 - 8 * k)) == 0
            out[places] += lead
            todo = todo[same]
        return np.minimum(out, self.depth)
