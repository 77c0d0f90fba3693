"""A run-length index: Burrows-Wheeler transform in runs, with sampled run ends.

Pieces of text stand one after the other, each closed by a terminator, in ascending order of their documents.
The rows of the transform are the places of that text, ordered by their next `context` symbols and, among
equals, from the last place to the first; the next symbols of the last piece go on with the first one.  What
is kept grows with the runs and with the distinct contexts, not with the text:

* for each run of equal symbols its symbol, start and length, sorted so that one binary search steps back;
* the text place of the last row of each run (the sampled run ends) and of each context.

Matching statistics stream the text backwards in lanes of their own.  A lane grows its match symbol by symbol
to `context` symbols, from then on each further symbol makes a match of one more, asks for its witness, and
drops the last symbol again.  The row that the witness comes from is the last one of its context that the
symbol precedes: a sampled run end, and of all occurrences the first in the text, hence in the smallest document.
"""

from __future__ import annotations

import numpy as np

LANE = 512


class RunIndex:
    """Index of pieces (their bytes `data`, their sizes) for matches of `context` + 1 bytes."""

    def __init__(self, data: np.ndarray, size: np.ndarray, context: int):
        self.context = context
        self.end = np.cumsum(size + 1) - 1  # the terminators
        self.n = n = len(data) + len(size)
        symbols = np.zeros(n, np.uint16)
        inside = np.ones(n, bool)
        inside[self.end] = False
        symbols[inside] = data.astype(np.uint16) + 1
        self.symbols = symbols
        places, first = self._rows()
        before = symbols[places - 1]
        start = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        length = np.diff(np.append(start, n))
        by = np.argsort(before[start], kind="stable")
        self.key = before[start].astype(np.int64)[by] * (n + 1) + start[by]
        self.length = length[by]
        self.rank = np.cumsum(self.length) - self.length
        self.run_end = places[start + length - 1][by]
        self.contexts = np.append(first, n)
        self.context_end = places[self.contexts[1:] - 1]

    def _rows(self):
        """(places in the order of the rows, first row of each distinct context), by doubling of ranks."""
        n = self.n
        bits = max(1, int(n - 1).bit_length())
        mask, place = (1 << bits) - 1, np.arange(n)
        key = np.zeros(n, np.int64)
        for j in range(depth := min(self.context, 4)):
            key = key << 9 | np.roll(self.symbols, -j)
        while True:
            last = depth == self.context
            tie = n - 1 - place if last else place
            if int(key.max()).bit_length() + bits < 64:
                rows = np.sort(key << bits | tie)
                at, value = rows & mask, rows >> bits
                order = n - 1 - at if last else at
            else:
                order = np.lexsort((tie, key))
                value = key[order]
            new = np.append(True, value[1:] != value[:-1])
            if last:
                return order, np.flatnonzero(new)
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            gap = min(depth, self.context - depth)
            key = rank << bits | np.roll(rank, -gap)
            depth += gap

    def _before(self, symbol: np.ndarray, row: np.ndarray):
        """(run, offset in it, whether the run reaches the row before `row`) of the last `symbol` before `row`."""
        query = symbol.astype(np.int64) * (self.n + 1) + row
        run = np.maximum(np.searchsorted(self.key, query) - 1, 0)
        offset = query - self.key[run]
        return run, np.clip(offset, 0, self.length[run]), offset <= self.length[run]

    def witnesses(self) -> np.ndarray:
        """For each place, the first place of the text with the same next `context` + 1 symbols."""
        n, symbols = self.n, self.symbols
        out = np.zeros(n, np.int64)
        low = np.arange(0, n, LANE)
        high = np.minimum(low + LANE, n)
        lo, hi = np.zeros(len(low), np.int64), np.full(len(low), n)
        for j in range(self.context - 1, -1, -1):  # the match grows
            c = symbols[(high + j) % n]
            run, offset, _ = self._before(c, lo)
            lo = self.rank[run] + offset
            run, offset, _ = self._before(c, hi)
            hi = self.rank[run] + offset
        row = hi - 1
        for j in range(1, LANE + 1):
            place = np.maximum(high - j, low)  # the last lane may be shorter; it stays at its lowest place
            live = high - j >= low
            if not live.all():
                place, row, low, high = place[live], row[live], low[live], high[live]
            context = np.searchsorted(self.contexts, row, side="right") - 1
            run, offset, inside = self._before(symbols[place], self.contexts[context + 1])
            out[place] = (np.where(inside, self.context_end[context], self.run_end[run]) - 1) % n
            row = self.rank[run] + offset - 1
        return out
