"""Chunk boundaries over arrays of line lengths.

A chunk takes lines while their lengths fit ``size``; the next chunk restarts at the
shortest suffix of lines that reaches ``overlap`` characters.  The line start after an
end ``e`` depends on ``e`` alone, so the ends of a trace are the path of one step
function.  That lets a long trace be packed block by block: a block's task maps every
possible entry to its exit, the exits are chained, and each block is then packed on its
own from its known entry.

The entry of a block is ``(reach, carried)``: how many lines lie behind the last closed
chunk, and how many events the open chunk carried over from it.
"""

from __future__ import annotations

import numpy as np


class Block:
    """One block of lines with the look-back lines in front of it."""

    def __init__(self, first: int, lengths: np.ndarray, lookback: int, size: int, overlap: int, closes: bool):
        self.base = first - 1  # lines of the trace before the first line held here
        self.back = lookback
        self.total = len(lengths)
        self.closes = closes
        before = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        ends = np.arange(self.total)
        if overlap > 0:
            start = np.searchsorted(before, before[:-1] - overlap, side="right") - 1
            start = np.maximum(start, 0)
        else:
            start = ends
        fits = np.searchsorted(before, before[start] + size, side="right") - 1
        self.start = start.tolist()
        self.next = np.maximum(ends + 1, fits).tolist()
        if lookback and self.base:
            reach = before[lookback]
            short = reach <= size + max(overlap, 0) or (overlap > 0 and before[lookback - 1] < overlap)
            if short:
                raise ValueError("look-back spans more than one block: raise block_rows")

    def path(self, entry: int):
        """Closed chunks from ``entry``, as ``(previous end, end)`` positions."""
        at, last, step = entry, self.total, self.next
        while at < last:
            to = step[at]
            if to >= last and not self.closes:
                return
            yield at, to
            at = to

    def entries(self) -> range:
        """Every position that may be the last closed end when this block begins."""
        if not self.back:
            return range(0, 1)
        low = self.back - 1
        while low > 0 and self.next[low - 1] >= self.back:
            low -= 1
        return range(low, self.back)

    def exits(self):
        """Per run of equivalent entries: reach range, exit reach, chunk count, carry steps."""
        runs = []
        for entry in self.entries():
            known = self.back == 0
            froms = np.arange(1 if known else self.total + 1)
            tos = froms
            at, count = entry, 0
            for prev, end in self.path(entry):
                tos = np.maximum(1, (end - prev + tos) // 10)
                if len(tos) > 1:
                    keep = np.concatenate([[True], tos[1:] != tos[:-1]])
                    froms, tos = froms[keep], tos[keep]
                at, count = end, count + 1
            exit_ = (self.total - at, count, froms.tolist(), tos.tolist())
            reach = self.back - entry
            if runs and runs[-1][2:] == exit_ and count:
                runs[-1] = (reach, *runs[-1][1:])
            else:
                runs.append((reach, reach, *exit_))
        return runs

    def chunks(self, reach: int, carried: int):
        """Closed chunks as 1-based ``(line start, line end, event start)`` in the trace."""
        for prev, end in self.path(self.back - reach):
            yield self.base + self.start[prev] + 1, self.base + end, self.base + prev - carried + 1
            carried = max(1, (end - prev + carried) // 10)


def chain(blocks: list[list[tuple]]) -> list[tuple[int, int, int]]:
    """Entries of the blocks after the first: ``(reach, carried, chunks before)``."""
    reach, carried, before, found = 0, 0, 0, []
    for runs in blocks:
        low, high, out, count, froms, tos = next(r for r in runs if r[0] <= reach <= r[1])
        carried = tos[int(np.searchsorted(froms, carried, side="right")) - 1]
        reach, before = out, before + count
        found.append((reach, carried, before))
    return found
