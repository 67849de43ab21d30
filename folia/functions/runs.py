"""Sequences: first occurrences from every start, and line differences from bit vectors."""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence


def first_occurrences(items: Sequence[Hashable]) -> Iterator[tuple[int, list[int]]]:
    """For every start, last to first: (start, after). From a start z, after[z] is the next place whose item
    hasn't occurred since the start, up to len(items); valid until the next start is taken.

    So what a start meets anew is walked without the repeats between: a linked list loses an item's
    old place when the item occurs before it.
    """
    n = len(items)
    after, before, at = [n] * (n + 1), [n] * (n + 1), {}
    head = n
    for k in range(n - 1, -1, -1):
        old = at.get(items[k])
        if old is not None:
            a, b = before[old], after[old]
            if a == n:
                head = b
            else:
                after[a] = b
            before[b] = a
        after[k], before[head], before[k], head = head, k, n, k
        at[items[k]] = k
        yield k, after


def line_diff(a: str, b: str) -> list[tuple[str, str]]:
    """Lines kept ( ), removed (-) and added (+), by longest common subsequence; removals come first.

    A row of the table of common lengths is a bit vector of its steps, so a row costs a few operations on
    whole numbers as long as the other text has lines. Every so many rows one is kept, and the rows between are
    made again on the way back: two texts of n lines need about n ** 1.5 / 4 bytes.
    """
    x, y = a.split("\n"), b.split("\n")
    n, m = len(x), len(y)
    ones = (1 << m) - 1
    where: dict[str, int] = {}
    for j, line in enumerate(y):
        where[line] = where.get(line, 0) | 1 << m - 1 - j

    def up(row: int, line: str) -> int:
        """The row above: a bit that isn't set says that one more line is common from there on."""
        shared = row & where.get(line, 0)
        return (row + shared | row - shared) & ones

    step = max(1, int(n**0.5))
    kept, row = {n: ones}, ones
    for i in range(n - 1, -1, -1):
        row = up(row, x[i])
        if i % step == 0:
            kept[i] = row
    rows: dict[int, int] = {}

    def steps(i: int) -> int:
        """Row i as steps of the common length."""
        if i not in rows:
            rows.clear()
            at = min(n, (i // step + 1) * step)
            row = kept[at]
            rows[at] = row
            for k in range(at - 1, i // step * step - 1, -1):
                row = rows[k] = up(row, x[k])
        return ~rows[i] & ones

    out, i, j = [], 0, 0
    own = below = 0
    fresh = True
    while i < n and j < m:
        if fresh:
            rest = (1 << m - j) - 1
            here, under = steps(i), steps(i + 1) if (i + 1) // step == i // step or i + 1 == n else ~kept[i + 1] & ones
            own, below, fresh = (here & rest).bit_count(), (under & rest).bit_count(), False
        if x[i] == y[j]:
            out.append((" ", x[i]))
            i, j, fresh = i + 1, j + 1, True
        elif below == own:
            out.append(("-", x[i]))
            i, fresh = i + 1, True
        else:
            out.append(("+", y[j]))
            bit = m - 1 - j
            own, below, j = own - (here >> bit & 1), below - (under >> bit & 1), j + 1
    return out + [("-", line) for line in x[i:]] + [("+", line) for line in y[j:]]
