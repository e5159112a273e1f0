"""Column-wise construction of collections' Burrows-Wheeler transforms and common prefixes.

The strings of a group stand under each other, each from a column of its own. A round goes one column to the left and
inserts one symbol for every string that reaches there: the order of the suffixes that begin at this column is the
order of the last round, sorted stably by the new symbol; that column of symbols, in the order of the suffixes behind
it, is the (positional) Burrows-Wheeler transform. The common prefix of two neighbours with one symbol is one more
than the least common prefix between them in the last round. Strings enter as empty suffixes, before all others of
their group, when their end is reached, and leave after their first symbol. A round reads and writes these sequences
once, in order, as the published construction does with its files; here all groups of a batch share them in memory,
and only suffixes of one column are compared, since equal windows always stand in equal columns.
"""

from __future__ import annotations

import numpy as np


def repeated_windows(strings: list[bytes], columns: np.ndarray, groups: np.ndarray, width: int) -> list[np.ndarray]:
    """For each string, the starts, ascending, of its ``width``-byte windows that stand at the same column of another
    string of its group. ``columns``: where each string begins; ``groups``: ascending numbers."""
    m = len(strings)
    if not m:
        return []
    length = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(b"".join(strings) + b"\0", np.uint8)
    zero = np.cumsum(length) - length - columns  # text[zero + t]: the symbol of a string at column t
    first, end = columns.astype(np.int64), columns + length
    enter = np.argsort(-end, kind="stable")
    enter = enter[length[enter] > 0]
    todo = 0  # of enter
    order = np.zeros(0, np.int64)  # strings in suffix order, groups apart
    common = np.zeros(0, np.int64)  # with the string before, at most width
    hit_string, hit_start = [], []
    for t in range(int(end.max()) - 1, int(first.min()) - 1, -1):
        come = todo
        while come < len(enter) and end[enter[come]] == t + 1:
            come += 1
        if come > todo:
            new = enter[todo:come]
            todo = come
            both = np.concatenate([new, order])
            by = np.argsort(groups[both], kind="stable")
            common = np.concatenate([np.zeros(len(new), np.int64), common])[by]
            # whoever now stands behind an empty suffix shares nothing with it
            order = both[by]
            common[1:][(end[order[:-1]] == t + 1)] = 0
        if not len(order):
            continue
        n = len(order)
        key = groups[order] * 256 + text[zero[order] + t]
        by = np.argsort(key, kind="stable")
        key = key[by]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        after = np.zeros(n, np.int64)
        if len(same):
            cuts = np.stack([by[same - 1] + 1, by[same] + 1], 1).ravel()
            after[same] = np.minimum(width, 1 + np.minimum.reduceat(np.append(common, 0), cuts)[::2])
        order, common = order[by], after
        full = common >= width
        if full.any():
            full[:-1] |= full[1:]
            hit_string.append(order[full])
            hit_start.append(np.full(int(full.sum()), t))
        stay = first[order] < t
        if not stay.all():
            # a string that leaves passes the least on to the one behind it
            keep = np.flatnonzero(stay)
            common = np.minimum.reduceat(common[: keep[-1] + 1], np.append(0, keep[:-1] + 1)) if len(keep) else common[:0]
            order = order[keep]
            if len(order):
                common[np.append(True, groups[order[1:]] != groups[order[:-1]])] = 0
    string = np.concatenate([np.zeros(0, np.int64), *hit_string])
    start = np.concatenate([np.zeros(0, np.int64), *hit_start]) - columns[string]
    by = np.lexsort((start, string))
    cuts = np.searchsorted(string[by], np.arange(m + 1))
    return [start[by[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
