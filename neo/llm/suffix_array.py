"""Suffix array in linear time by grouping, without recursion or renaming.

First phase: suffixes are put into groups of equal Lyndon prefixes, and the groups into
their order.  Groups are processed in descending order.  For a suffix of the current group
the pointer to its previous smaller suffix leads to the nearest place before it that is in a
lower group; such a place takes the Lyndon words that follow it into its own prefix, so it
moves to a new group just above its old one, and the higher, the more words of the current
group it takes.  Processed places are unlinked, which makes the pointers constant-time.

Second phase: a suffix is its Lyndon prefix followed by a smaller suffix.  Going through the
order from its beginning, every suffix that is next after a Lyndon prefix releases the
suffixes with that prefix, found along the pointers, into the next free place of their group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Texts of similar length are sorted side by side if there are at least so many of them.
LEAST_LANES = 100
#: Symbols of such a batch.
BATCH = 1 << 20
#: Longest text of such a batch relative to the shortest.
SPREAD = 1.3


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start places of the suffixes of ``text`` in ascending order."""
    n = len(text)
    by_symbol: dict[int, list[int]] = {}
    for i, symbol in enumerate(text):
        by_symbol.setdefault(symbol, []).append(i)
    lists = [by_symbol[symbol] for symbol in sorted(by_symbol)]
    group = [0] * n + [-1]  # the last entry serves the places before the first and after the last
    for g, places in enumerate(lists):
        for i in places:
            group[i] = g
    lower, upper = list(range(-1, len(lists) - 1)), list(range(1, len(lists) + 1))
    before, after = list(range(-1, n)), list(range(1, n + 2))
    done = bytearray(n + 1)
    descending = []
    g = len(lists) - 1
    while g >= 0:
        own = [i for i in lists[g] if group[i] == g]
        descending.append(own)
        takes: dict[tuple[int, int], list[int]] = {}
        for i in own:
            smaller = before[i]
            if done[i] or group[smaller] == g:
                continue
            done[i], count, following = 1, 1, after[i]
            while group[following] == g:
                done[following] = 1
                before[following] = smaller
                following = after[following]
                count += 1
            before[following] = smaller
            if smaller >= 0:
                after[smaller] = following
                takes.setdefault((count, group[smaller]), []).append(smaller)
        for key in sorted(takes, reverse=True):
            old, new = key[1], len(lists)
            lists.append(takes[key])
            for i in takes[key]:
                group[i] = new
            lower.append(old)
            upper.append(upper[old])
            lower[upper[old]] = new
            upper[old] = new
        g = lower[g]

    free, at = [0] * len(lists), 0
    for own in reversed(descending):
        if own:
            free[group[own[0]]] = at
            at += len(own)
    order, placed = [0] * n, bytearray(n)
    suffix = n
    for k in range(n + 1):
        i = suffix - 1
        while i >= 0 and not placed[i]:
            placed[i] = 1
            order[free[group[i]]] = i
            free[group[i]] += 1
            i = before[i]
        if k < n:
            suffix = order[k]
    return order


def _group_lanes(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First phase for many texts at a time, each step on the highest open group of every text:
    the final group (its first place in the order) and previous smaller pointer of each suffix."""
    n = len(symbols)
    lane = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.argsort((lane << 16) + symbols, kind="stable").astype(np.int32)
    where = np.empty(n, np.int32)
    where[order] = np.arange(n, dtype=np.int32)
    new = np.ones(n, bool)
    new[1:] = (symbols[order][1:] != symbols[order][:-1]) | (lane[order][1:] != lane[order][:-1])
    first = np.flatnonzero(new).astype(np.int32)
    group = np.full(n + 1, -1, np.int32)  # place n stands for what is before and after each text
    group[order] = np.repeat(first, np.diff(np.append(first, n)))
    end_of = np.zeros(n + 1, np.int32)
    end_of[first] = np.append(first[1:], n)
    before, after = np.arange(-1, n, dtype=np.int32), np.arange(1, n + 2, dtype=np.int32)
    before[starts[:-1]] = n
    after[starts[1:] - 1] = n
    smaller = np.full(n + 1, n, np.int32)
    moved = np.zeros(n, bool)
    low, high = starts[:-1].astype(np.int32), starts[1:].astype(np.int32)  # slots of each text that are still open
    while len(low):
        g = group[order[high - 1]]
        size = high - g
        shift = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        own = np.sort(order[np.repeat(g, size) + shift])
        head = np.ones(len(own), bool)
        head[1:] = after[own[:-1]] != own[1:]  # else it continues a run of this group
        at = np.flatnonzero(head)
        count = np.diff(np.append(at, len(own)))
        to, following = before[own[at]], after[own[at + count - 1]]
        smaller[own] = np.repeat(to, count)
        after[to], before[following] = following, to
        some = to != n
        to, count = to[some], count[some]
        if len(to):
            old = group[to]
            rank = np.argsort((old.astype(np.int64) << 24) + count)
            to, count, old = to[rank], count[rank], old[rank]
            other = np.ones(len(to), bool)
            other[1:] = old[1:] != old[:-1]
            at = np.flatnonzero(other)
            many = np.diff(np.append(at, len(to)))
            end = end_of[old[at]]
            cut = np.repeat(end - many, many)  # they take the last slots of their old group
            slot = cut + np.arange(len(to)) - np.repeat(at, many)
            was = where[to]
            moved[to] = True
            there = order[slot]
            stays = there[~moved[there]]
            moved[to] = False
            free = was[was < cut]
            order[free], where[stays] = stays, free
            order[slot], where[to] = to, slot
            new = other.copy()
            new[1:] |= count[1:] != count[:-1]
            begin = np.flatnonzero(new)
            last = np.append(slot[begin[1:]], 0)
            last[np.append(other[begin[1:]], True)] = end
            end_of[old[at]] = end - many
            end_of[slot[begin]] = last
            group[to] = np.repeat(slot[begin], np.diff(np.append(begin, len(to))))
        high = g
        still = high > low
        if not still.all():
            low, high = low[still], high[still]
    return group, smaller


def _emit_lanes(starts: np.ndarray, group: np.ndarray, smaller: np.ndarray) -> np.ndarray:
    """Second phase for many texts at a time."""
    n = int(starts[-1])
    order, free, placed = np.empty(n, np.int32), np.arange(n + 1, dtype=np.int32), np.zeros(n + 1, bool)
    placed[n] = True
    low, high = starts[:-1].astype(np.int32), starts[1:].astype(np.int32)
    read, at = low.copy(), high - 1
    while len(low):
        known = placed[at]
        put = np.flatnonzero(~known)
        i = at[put]
        g = group[i]
        slot = free[g]
        order[slot] = i
        free[g] = slot + 1
        placed[i] = True
        at[put] = smaller[i]
        go = np.flatnonzero(known)
        if len(go):
            over = read[go] == high[go]
            if over.any():
                keep = np.ones(len(low), bool)
                keep[go[over]] = False
                go = go[~over]
                nxt = order[read[go]]
                at[go] = np.where(nxt > low[go], nxt - 1, n)
                read[go] += 1
                low, high, read, at = low[keep], high[keep], read[keep], at[keep]
            else:
                nxt = order[read[go]]
                at[go] = np.where(nxt > low[go], nxt - 1, n)
                read[go] += 1
    return order


def suffix_arrays(texts: list[np.ndarray]) -> list[np.ndarray]:
    """Suffix array of each text.  Texts of similar length go side by side through the two
    phases; lengths with too few texts take the plain form."""
    out: list[np.ndarray] = [None] * len(texts)
    by_size = sorted(range(len(texts)), key=lambda k: len(texts[k]))
    a = 0
    while a < len(by_size):
        b, least = a, len(texts[by_size[a]])
        total = 0
        while b < len(by_size) and len(texts[by_size[b]]) <= SPREAD * least + 8 and total < BATCH:
            total += len(texts[by_size[b]])
            b += 1
        batch = [k for k in by_size[a:b] if len(texts[k])]
        if len(batch) >= LEAST_LANES:
            starts = np.append(0, np.cumsum([len(texts[k]) for k in batch]))
            group, smaller = _group_lanes(np.concatenate([texts[k] for k in batch]), starts)
            order = _emit_lanes(starts, group, smaller)
            for k, first, last in zip(batch, starts, starts[1:]):
                out[k] = order[first:last] - first
        for k in by_size[a:b]:
            if out[k] is None:
                out[k] = np.array(suffix_array(texts[k].tolist()), np.int64)
        a = b
    return out
