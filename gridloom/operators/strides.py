"""Greedy progressions of ascending rows: from the first free row on, as many with one distance over 1 as there are, if they are three or more; else it stays alone.

Rows may come in chunks. What a chunk's first and last rows become depends on its neighbours; all between is settled alone. So chunks are settled in parallel,
and only their ends, as few pieces (first, step, n), pass through ``Greedy`` in order. A chunk's first rows come to an end where the three ways in which the chunk
before can have left it (its first row free, taken, or its first progression taken) go on from the same row.
"""

from __future__ import annotations


def _pieces(rows: list[int]) -> list[tuple[int, int, int]]:
    """(first, step, n) of ascending rows, whole progressions as one."""
    out, i, n = [], 0, len(rows)
    while i < n:
        j, step = i, rows[i + 1] - rows[i] if i + 1 < n else 0
        if step > 1:
            while j + 1 < n and rows[j + 1] - rows[j] == step:
                j += 1
        out.append((rows[i], step if j > i else 0, j - i + 1))
        i = j + 1
    return out


def settled(rows: list[int]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, bool]]]:
    """(first, last, step) of the spans of a chunk that no neighbour changes, and (first, step, n, whether a span ends there in any case) of its ends."""
    n = len(rows)
    if n == 1:
        return [], [(rows[0], 0, 1, False)]
    last = [n - 1] * n  # of the rows from each with one distance
    for i in range(n - 3, -1, -1):
        last[i] = last[i + 1] if rows[i + 1] - rows[i] == rows[i + 2] - rows[i + 1] else i + 1

    def after(i: int) -> int:
        j = last[i]
        return n if j == n - 1 else j + 1 if j - i > 1 and rows[i + 1] - rows[i] > 1 else i + 1

    ways = [0, 1, last[0] + 1]
    while (i := min(ways)) < max(ways):
        ways = [after(w) if w == i else w for w in ways]
    if i == n:
        return [], [(*p, False) for p in _pieces(rows)]
    head, spans = _pieces(rows[:i]), []
    while last[i] < n - 1:
        j = after(i)
        spans.append((rows[i], rows[j - 1], rows[i + 1] - rows[i] if j - i > 1 else 1))
        i = j
    return spans, [*((*p, False) for p in head[:-1]), (*head[-1], True), *((*p, False) for p in _pieces(rows[i:]))]


class Greedy:
    """Spans of pieces in the order of their rows."""

    def __init__(self) -> None:
        self.first, self.step, self.n, self.out = 0, 0, 0, []

    def _put(self, first: int, step: int, n: int) -> None:
        self.first, self.step, self.n = first, step, n

    def _row(self, x: int) -> None:
        if not self.n:
            self._put(x, 0, 1)
            return
        end = self.first + self.step * (self.n - 1)
        if self.n > 1 and x - end == self.step:
            self.n += 1
            return
        if self.n > 2:
            self.out.append((self.first, end, self.step))
            self._put(x, 0, 1)
            return
        if self.n == 2:
            self.out.append((self.first, self.first, 1))
        if x - end > 1:
            self._put(end, x - end, 2)
        else:
            self.out.append((end, end, 1))
            self._put(x, 0, 1)

    def add(self, first: int, step: int, n: int) -> None:
        self._row(first)
        if n > 1:
            self._row(first + step)
        if n > 2 and self.step != step:  # a progression that came before took the second row
            self._row(first + 2 * step)
            n -= 1
        if n > 2:
            self.n += n - 2

    def flush(self) -> None:
        if self.n > 2:
            self.out.append((self.first, self.first + self.step * (self.n - 1), self.step))
        elif self.n:
            self.out += [(x, x, 1) for x in range(self.first, self.first + self.step * (self.n - 1) + 1, self.step or 1)]
        self.n = 0

    def taken(self) -> list[tuple[int, int, int]]:
        out, self.out = self.out, []
        return out
