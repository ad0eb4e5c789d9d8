"""Banded alignment of many patterns at once, each against a region of its own text."""

from __future__ import annotations

import numpy as np

#: Patterns aligned at once, and their cells.
MOST_ROWS, MOST_CELLS = 4096, 1 << 16
#: A cell's low bits hold a diagonal, its high bits count edits.
BITS = 28


#: Edits of an alignment that was given up.
GIVEN_UP = 1 << 30


def banded_edits(text, first, row, low, width, pattern, begin, size, most=None, cells=None, which=None, done=0):
    """(edits, start, end) of each whole pattern against its text, along `width` diagonals from `low` up.

    Pattern p is pattern[begin[p] : begin[p] + size[p]]; its text is text[first[row[p]] : first[row[p] + 1]].
    The alignment starts and ends anywhere in the text; start and end count from the text's first symbol.
    With `most`, patterns that need more edits than that may be given up: their edits are GIVEN_UP or more.
    With `cells`, the first `done` symbols have been aligned already, with the state cells[which[p]] (see stem_cells).
    """
    out = [np.zeros(len(row), np.int64) for _ in range(3)]
    order = np.lexsort((width, size))
    a = 0
    while a < len(order):
        # So many rows that their cells fit in a bounded table; one row of a very long pattern may be wider.
        fit = np.flatnonzero(np.maximum.accumulate(width[order[a : a + MOST_ROWS]]) * np.arange(1, len(order[a : a + MOST_ROWS]) + 1) <= MOST_CELLS)
        part = order[a : a + max(1, len(fit))]
        a += len(part)
        begun = None if cells is None else cells[which[part]]
        got = _rows(text, first, row[part], low[part], int(width[part].max()), pattern, begin[part], size[part], None if most is None else most[part], begun, done)
        for x, y in zip(out, got, strict=True):
            x[part] = y
    return out


def _begin(first, row, low, width):
    offset, beyond = np.arange(width), np.int64(1) << 60
    start, length = low[:, None] + offset, (first[row + 1] - first[row])[:, None]
    return np.where((start >= 0) & (start <= length), offset[None, :], beyond)


def _next(text, first, row, low, cell, symbols, i):
    """The cells after symbol i of each row's pattern. A cell holds edits * unit + the diagonal at which its alignment began."""
    unit, beyond, offset = np.int64(1) << BITS, np.int64(1) << 60, np.arange(cell.shape[1])
    length, base = (first[row + 1] - first[row])[:, None], first[row][:, None]
    j = low[:, None] + offset + i  # the place in the text that pattern symbol i stands against on each diagonal
    there = (j >= 0) & (j < length)
    symbol = text[np.where(there, base + j, 0)]
    new = np.where(there, cell + np.where(symbol == symbols[:, None], 0, unit), beyond)
    # Without the pattern's symbol: from the next diagonal.
    np.minimum(new[:, :-1], np.where(cell[:, 1:] < beyond, cell[:, 1:] + unit, beyond), out=new[:, :-1])
    # With text symbols between: from the diagonals before.
    new = np.minimum.accumulate(new - offset * unit, axis=1) + offset * unit
    return np.where((j + 1 >= 0) & (j + 1 <= length), new, beyond)


def stem_cells(text, first, row, low, width, stem):
    """The state of each row's alignment after all symbols of a pattern's beginning, which all rows share."""
    cell = _begin(first, row, low, width)
    for i, symbol in enumerate(stem):
        cell = _next(text, first, row, low, cell, np.full(len(row), symbol), i)
    return cell


def _rows(text, first, row, low, width, pattern, begin, size, most, cell, done):
    edits, starts, ends = np.full(len(row), GIVEN_UP, np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    unit, at = np.int64(1) << BITS, np.arange(len(row))
    cell = _begin(first, row, low, width) if cell is None else cell
    for i in range(done, int(size.max())):
        cell = _next(text, first, row, low, cell, pattern[np.minimum(begin + i, len(pattern) - 1)], i)
        over = np.flatnonzero(size == i + 1)
        if len(over):
            best = np.argmin(cell[over], axis=1)
            value = cell[over, best]
            edits[at[over]], starts[at[over]], ends[at[over]] = value >> BITS, low[over] + (value & (unit - 1)), low[over] + best + i + 1
        if most is not None and i % 8 == 7:
            live = (size > i + 1) & (cell.min(axis=1) >> BITS <= most)
            if not live.any():
                break
            if live.mean() < 0.75:
                row, low, begin, size, most, at, cell = (x[live] for x in (row, low, begin, size, most, at, cell))
    return edits, starts, ends
