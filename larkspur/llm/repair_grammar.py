"""Cheapest repair of a sequence of conversation rows by interval parsing with a weighted grammar."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

#: Roles alternate, beginning with the user, after one system row at most: `(s?(ua)+)?`. States: nothing yet, after s,
#: after u, after a.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, FINAL = 4, (0, 3)
KEEP, REROLE, DELETE, INSERT = (0, "K"), (1, "R"), (2, "D"), (5, "I")
#: Added to a truncated row that stays.
TRUNCATED = 5

#: The cheapest derivations of a span: for each nonterminal (a pair of states) its cost and audit. Absent ones can't be derived.
Cell = dict[tuple[int, int], tuple[int, str]]


def _better(cell: Cell, pair: tuple[int, int], found: tuple[int, str]) -> None:
    if pair not in cell or found < cell[pair]:
        cell[pair] = found


def join(left: Cell, right: Cell) -> Cell:
    """The cell of two spans that follow each other: every rule [p q] -> [p r] [r q].

    Two audits of one span and one cost are never each other's prefix (they would differ by inserts alone, which
    cost), so the least audits of the parts give the least of the whole."""
    cell: Cell = {}
    for (p, r), (a, x) in left.items():
        for (s, q), (b, y) in right.items():
            if r == s:
                _better(cell, (p, q), (a + b, x + y))
    return cell


def _closure() -> Cell:
    """What inserts alone derive."""
    cell: Cell = {(p, p): (0, "") for p in range(STATES)}
    for _ in range(STATES):
        step: Cell = {(p, q): INSERT for (p, role), q in STEPS.items() if role in "ua"}
        for pair, found in join(cell, step).items():
            _better(cell, pair, found)
    return cell


INSERTS = _closure()


@lru_cache(maxsize=64)
def row_cell(initial: str, fault: str) -> Cell:
    """The cell of a row: kept, with another role or deleted, with inserts on both sides. fault is `x` for a row that must
    be deleted, `t` for a truncated one, else `-`; a row without an initial leaves the state as it is."""
    cell: Cell = {(p, p): DELETE for p in range(STATES)}
    extra = TRUNCATED if fault == "t" else 0
    if fault != "x":
        for (p, role), q in STEPS.items():
            if role == initial:
                _better(cell, (p, q), (KEEP[0] + extra, KEEP[1]))
            if role in "ua":
                _better(cell, (p, q), (REROLE[0] + extra, REROLE[1]))
        if not initial:
            for p in range(STATES):
                _better(cell, (p, p), (KEEP[0] + extra, KEEP[1]))
    return join(join(INSERTS, cell), INSERTS)


def parse(cells: Sequence[Cell]) -> Cell:
    """The cell of all spans in a row, by span length: neighbours become spans of two, these of four and so on. As
    the nonterminals are pairs of states, every split of a span gives the same cell, so one split each is enough."""
    cells = list(cells)
    while len(cells) > 1:
        cells = [join(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0] if cells else INSERTS


def cheapest(cell: Cell) -> tuple[int, str]:
    """Cost and audit of a whole conversation."""
    return min(cell[0, q] for q in FINAL if (0, q) in cell)


def roles(audit: str, initials: Sequence[str]) -> list[tuple[int, str]]:
    """What stands after the edits: (row, role initial) with row -1 for inserted rows; kept rows have their own initial. All other
    roles follow from their place: after s or a, or at the start, comes u, after u comes a."""
    out, last, row = [], "", 0
    for edit in audit:
        if edit == "D":
            row += 1
            continue
        now = initials[row] if edit == "K" else ("a" if last == "u" else "u")
        out.append((-1 if edit == "I" else row, now))
        last = now or last
        row += edit != "I"
    return out
