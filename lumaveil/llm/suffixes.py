"""Suffix arrays by grouping suffixes by their Lyndon prefixes, in linear time and without recursive renaming."""

from __future__ import annotations

import numpy as np


def suffix_array(text: list[int]) -> list[int]:
    """Order of the suffixes of text (any integers).

    Suffixes start in groups by first letter. Groups are taken from the highest down; when a group with prefix u is
    taken, its prefixes are the Lyndon prefixes of its members. For each member the pointer to the previous suffix of
    a lower group (its previous smaller suffix) is found by following earlier pointers; a suffix that k members of the
    group point to has its prefix extended by u^k and moves to a group of its own just above its old one. When all
    groups are taken, they are in order; a member's rank in its group is that of the suffix behind its prefix, so one
    pass over the growing result, along the pointers, emits every group's order.
    """
    n = len(text)
    if n < 2:
        return list(range(n))
    letters = sorted(set(text))
    count = len(letters)
    rank = {c: g for g, c in enumerate(letters)}
    group = [rank[c] for c in text]
    members: list = [{} for _ in letters]
    for i, g in enumerate(group):
        members[g][i] = None
    below, above = list(range(-1, count - 1)), [*range(1, count), -1]
    taken = [False] * count
    previous = [-1] * n
    order: list[int] = []
    at = count - 1
    while at >= 0:
        mine = sorted(members[at]) if len(members[at]) > 1 else list(members[at])
        members[at] = mine
        taken[at] = True
        if mine:
            order.append(at)
        hits: dict[int, int] = {}
        for i in mine:
            j = i - 1
            while j >= 0 and taken[group[j]]:
                j = previous[j]
            previous[i] = j
            if j >= 0:
                hits[j] = hits.get(j, 0) + 1
        moves: dict[int, dict[int, list[int]]] = {}
        for j, k in hits.items():
            moves.setdefault(group[j], {}).setdefault(k, []).append(j)
        for g, parts in moves.items():
            old, under, over = members[g], g, above[g]
            for k in sorted(parts):
                new = len(below)
                below.append(under)
                above.append(over)
                above[under] = new
                taken.append(False)
                members.append(dict.fromkeys(parts[k]))
                for j in parts[k]:
                    del old[j]
                    group[j] = new
                under = new
            if over >= 0:
                below[over] = under
        at = below[at]
    slot = [0] * len(below)
    total = 0
    for g in reversed(order):
        slot[g] = total
        total += len(members[g])
    out = [-1] * n
    placed = [False] * n

    def chain(s: int) -> None:
        while s >= 0 and not placed[s]:
            g = group[s]
            out[slot[g]] = s
            slot[g] += 1
            placed[s] = True
            s = previous[s]

    chain(n - 1)
    for r in range(n):
        chain(out[r] - 1)
    return out


#: Strings of about one length from which they are ordered side by side, and letters of them at once.
FEW, TOGETHER = 48, 1 << 19


def suffix_arrays(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For strings text[bounds[i]:bounds[i + 1]] of integers: the places in text in the order of each string's suffixes.

    Many short strings are ordered side by side, each by the same groups and pointers as in suffix_array: a step takes
    the highest group left of every string. Groups are stretches of one array of places; members that move go to the
    end of their group's stretch, which becomes the new groups.
    """
    sizes = np.diff(bounds)
    out = np.empty(len(text), np.int64)
    kind = np.where(sizes > 0, np.frexp(sizes.astype(np.float64))[1], 0)  # doubling lengths: a step costs as much for one string
    for k in np.unique(kind[kind > 0]):
        alike = np.flatnonzero(kind == k)
        if len(alike) < FEW:
            for i in alike:
                a, b = int(bounds[i]), int(bounds[i + 1])
                out[a:b] = np.array(suffix_array(text[a:b].tolist()), np.int64) + a
            continue
        alike = alike[np.argsort(-sizes[alike], kind="stable")]
        for part in np.split(alike, np.flatnonzero(np.diff(np.cumsum(sizes[alike]) // TOGETHER)) + 1):
            n = sizes[part]
            first = np.concatenate([[0], np.cumsum(n)])
            places = np.repeat(bounds[:-1][part] - first[:-1], n) + np.arange(first[-1])
            out[places] = places[_side_by_side(text[places], first)]
    return out


def _side_by_side(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """suffix_arrays of non-empty strings, the longest first."""
    n, first = len(text), bounds[:-1]
    owner = np.repeat(np.arange(len(first)), np.diff(bounds))
    held = np.lexsort((text, owner))  # places by group
    new = np.ones(n, bool)
    new[1:] = (owner[held[1:]] != owner[held[:-1]]) | (text[held[1:]] != text[held[:-1]])
    count = int(new.sum())
    start, size = np.zeros(count + n, np.int64), np.zeros(count + n, np.int64)
    start[:count] = np.flatnonzero(new)
    size[:count] = np.diff(np.append(start[:count], n))
    group, where = np.empty(n, np.int64), np.empty(n, np.int64)
    group[held] = np.cumsum(new) - 1
    where[held] = np.arange(n)
    taken, moves = np.zeros(n, bool), np.zeros(n, bool)  # by place
    before = np.arange(-1, n - 1)
    before[first] = -1
    previous = np.full(n, -1)
    now, low = group[held[bounds[1:] - 1]], first
    while len(now):
        at, many = start[now], size[now]
        ends = many.cumsum()
        mine = held[(at - ends + many).repeat(many) + np.arange(ends[-1])]
        taken[mine] = True
        to = before[mine]
        previous[mine] = to
        on = np.flatnonzero((to >= 0) & taken[to])  # place -1 is the last one: left out by the first test
        seek, to = mine[on], to[on]
        while len(seek):
            to = previous[to]
            previous[seek] = to
            on = np.flatnonzero((to >= 0) & taken[to])
            seek, to = seek[on], to[on]
        hit = previous[mine]
        hit = hit[hit >= 0]
        if len(hit):
            hit.sort()
            heads = np.flatnonzero(hit[1:] != hit[:-1]) + 1
            times = np.diff(heads, prepend=0, append=len(hit))
            hit = hit[np.append(0, heads)]
            g = group[hit]
            key = g * (int(times.max()) + 1) + times
            order = key.argsort(kind="stable")
            hit, g, key = hit[order], g[order], key[order]
            parts = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
            heads = np.append(0, np.flatnonzero(g[1:] != g[:-1]) + 1)
            counts = np.diff(heads, append=len(g))
            old = g[heads]
            tail = start[old] + size[old] - counts
            to = (tail - heads).repeat(counts) + np.arange(len(g))
            there, here = held[to], where[hit]
            moves[hit] = True
            there = there[~moves[there]]
            moves[hit] = False
            here = here[here < tail.repeat(counts)]
            held[here], where[there] = there, here
            held[to], where[hit] = hit, to
            lengths = np.diff(parts, append=len(g))
            group[hit] = (count + np.arange(len(parts))).repeat(lengths)
            start[count : count + len(parts)], size[count : count + len(parts)] = to[parts], lengths
            size[old] -= counts
            count += len(parts)
        more = at > low
        low = low[more]
        now = group[held[at[more] - 1]]
    out = np.full(n, -1)
    slot, placed = start.copy(), np.zeros(n, bool)

    def chain(s: np.ndarray) -> None:
        while len(s):
            g = group[s]
            at = slot[g]
            out[at] = s
            slot[g] = at + 1
            placed[s] = True
            s = previous[s]
            s = s[(s >= 0) & ~placed[s]]

    chain(bounds[1:] - 1)
    lengths = np.diff(bounds)
    longest_first = -lengths
    for r in range(int(lengths[0])):
        s = before[out[first[: np.searchsorted(longest_first, -r)] + r]]
        chain(s[(s >= 0) & ~placed[s]])
    return out
