"""Suffix arrays of many short texts at once, by linear grouping.

Each text's suffixes are grouped by their Lyndon prefix (the longest Lyndon word they begin with). Groups are processed
in descending order: every suffix of the group finds the nearest earlier suffix of a smaller group by following
previous-smaller pointers; that suffix's Lyndon prefix grows by the group's, so it moves into a new group right behind
the rest of its old one. In the end each group's order follows from the order of the suffixes that come after the
Lyndon prefixes: going through the array in ascending order, the suffixes that end where the current one begins take
the next place of their groups. Nothing is renamed and solved again on a shorter text.

All texts of a batch take a step together, so a step is a few vector operations.
"""

from __future__ import annotations

import numpy as np


def _ramp(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def suffix_arrays(symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix arrays of the texts ``symbols[start:start + size]``, which follow each other without gaps.

    Result: places in ``symbols``; the entries of a text stand where its symbols stand.
    """
    n, texts = len(symbols), len(starts)
    if not n:
        return np.zeros(0, np.int64)
    text_of = np.repeat(np.arange(texts), sizes)
    array = np.lexsort((symbols, text_of))
    inverse = np.empty(n, np.int64)
    inverse[array] = np.arange(n)
    begins = np.ones(n, bool)
    begins[1:] = (symbols[array][1:] != symbols[array][:-1]) | (text_of[array][1:] != text_of[array][:-1])
    heads = np.flatnonzero(begins)
    group = np.empty(n, np.int64)  # of a suffix: the first place of its group
    group[array] = heads[np.cumsum(begins) - 1]
    count = np.zeros(n, np.int64)
    count[heads] = np.diff(np.append(heads, n))
    smaller = np.full(n, -1, np.int64)  # previous-smaller pointers
    lyndon = np.ones(n, np.int64)
    moved_mark = np.zeros(n, bool)

    cursor = starts + sizes - 1
    while True:
        live = cursor >= starts
        if not live.any():
            break
        low, last = starts[live], cursor[live]
        head = group[array[last]]
        size = last - head + 1
        cursor[live] = head - 1
        suffix = array[np.repeat(head, size) + _ramp(size)]
        own, floor = np.repeat(head, size), np.repeat(low, size)
        point = suffix - 1
        todo = np.flatnonzero(point >= floor)
        while len(todo):
            at = point[todo]
            there, here = group[at], own[todo]
            on = there >= here
            todo, at, same = todo[on], at[on], there[on] == here[on]
            point[todo] = np.where(same, at - 1, smaller[at])
            todo = todo[point[todo] >= floor[todo]]
        smaller[suffix] = point
        has = point >= floor
        if not has.any():
            continue
        moved, example, times = np.unique(point[has], return_index=True, return_counts=True)
        lyndon[moved] += times * lyndon[suffix[has][example]]

        old = group[moved]
        order = np.lexsort((times, old))
        moved, old, times = moved[order], old[order], times[order]
        new_old = np.append(True, old[1:] != old[:-1])
        olds = old[new_old]
        leaving = np.diff(np.append(np.flatnonzero(new_old), len(old)))
        tail = np.repeat(olds + count[olds] - leaving, leaving)
        places = tail + _ramp(leaving)
        moved_mark[moved] = True
        there = array[places]
        displaced = there[~moved_mark[there]]
        at = inverse[moved]
        vacant = at[at < tail]
        moved_mark[moved] = False
        array[vacant], inverse[displaced] = displaced, vacant
        array[places], inverse[moved] = moved, places
        count[olds] -= leaving
        new = new_old | np.append(True, times[1:] != times[:-1])
        heads = places[new]
        group[moved] = heads[np.cumsum(new) - 1]
        count[heads] = np.diff(np.append(np.flatnonzero(new), len(new)))

    # Emit. The suffix after a Lyndon prefix is smaller; a text's end (its own slot) is the smallest of all.
    slot = np.arange(n) + text_of
    after = slot + lyndon
    children = np.argsort(after, kind="stable")
    per = np.bincount(after, minlength=n + texts)
    first_child = np.cumsum(per) - per
    out, fill = np.empty(n, np.int64), np.arange(n)
    now = starts + sizes + np.arange(texts)
    alive = np.arange(texts)
    for step in range(int(sizes.max())):
        amount = per[now]
        child = children[np.repeat(first_child[now], amount) + _ramp(amount)]
        heads = group[child]
        out[fill[heads]] = child
        fill[heads] += 1
        alive = alive[sizes[alive] > step]
        here = out[starts[alive] + step]
        now = here + alive
    return out
