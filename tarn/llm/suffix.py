"""Suffix arrays by linear grouping.

A suffix's Lyndon prefix is the longest Lyndon word at its start. Phase one sorts suffixes into groups of equal
Lyndon prefixes: groups start out by first symbol and are finished in descending order. When a group is
finished, each member finds the closest position before it that lies in a smaller group (its previous-smaller
pointer); that position's prefix grows by the group's word, once for each member that points to it, so it
moves to a new group right above those of its old group that didn't grow, further up the more it grew.
Phase two emits groups: going up the array, each suffix s appends to their groups the suffixes whose Lyndon
prefix ends where s begins. Nothing is renamed and no smaller problem is solved recursively; both phases take
time linear in the text.
"""

import numpy as np


def suffix_array(symbols: np.ndarray) -> list[int]:
    """Start positions in suffix order. The last symbol must be smaller than all others."""
    n = len(symbols)
    if n < 2:
        return list(range(n))
    order = np.argsort(symbols, kind="stable")
    heads = np.concatenate(([True], np.diff(symbols[order]) != 0))
    starts = np.flatnonzero(heads)
    label = np.empty(n, np.int64)  # of each position: where its group starts in suffix order
    label[order] = starts[np.cumsum(heads) - 1]
    return _emit(*_group(label.tolist(), order.tolist(), starts.tolist()))


def _group(label: list[int], order: list[int], starts: list[int]) -> tuple[list[int], list[int]]:
    n = len(label)
    members: list[list[int] | None] = [None] * n  # by label, in text order; those that moved on are skipped when read
    size, ending = [0] * n, [0] * n
    for a, b in zip(starts, [*starts[1:], n], strict=True):
        members[a] = order[a:b]
        size[a] = b - a
        ending[b - 1] = a
    before = [-1] * n
    top = n - 1
    while top >= 0:
        here = ending[top]
        mine = members[here]
        members[here] = None
        if top == here:  # alone, which is the usual case late on
            i = next(p for p in mine if label[p] == here)
            p = i - 1
            while p >= 0 and label[p] >= here:
                p = before[p]
            before[i] = p
            if p >= 0 and size[old := label[p]] > 1:
                size[old] = left = size[old] - 1
                new = old + left
                label[p] = new
                members[new] = [p]
                size[new] = 1
                ending[new] = new
                ending[new - 1] = old
            top = here - 1
            continue
        grown: dict[int, dict[int, list[int]]] = {}  # old group -> times grown -> positions in text order
        last, times = -1, 0
        for i in mine:
            if label[i] != here:
                continue
            p = i - 1
            while p >= 0 and label[p] >= here:
                p = before[p]
            before[i] = p
            if p == last:
                times += 1
                continue
            if last >= 0:
                grown.setdefault(label[last], {}).setdefault(times, []).append(last)
            last, times = p, 1
        if last >= 0:
            grown.setdefault(label[last], {}).setdefault(times, []).append(last)
        for old, by_times in grown.items():
            end = old + size[old]
            for t in sorted(by_times, reverse=True) if len(by_times) > 1 else by_times:
                moved = by_times[t]
                new = end - len(moved)
                ending[end - 1] = new
                if new > old:
                    for p in moved:
                        label[p] = new
                members[new] = moved
                size[new] = len(moved)
                end = new
            if end > old:
                size[old] = end - old
                ending[end - 1] = old
        top = here - 1
    return label, before


def _emit(label: list[int], before: list[int]) -> list[int]:
    n = len(label)
    out, free = [0] * n, list(range(n))
    out[0] = n - 1
    for i in range(n):
        s = out[i]
        stop, p = before[s], s - 1
        while p > stop:
            g = label[p]
            at = free[g]
            out[at] = p
            free[g] = at + 1
            p = before[p]
    return out
