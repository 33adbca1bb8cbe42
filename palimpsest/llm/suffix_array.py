"""Suffix arrays by induced sorting, and permuted common prefixes.

``suffix_array`` classifies suffixes, sorts the leftmost-smaller (LMS) substrings by
inducing, names them, recurses on the string of names, and induces the whole array from
the order of the LMS suffixes.  Over a small alphabet each bucket is induced as a whole in
numpy; over the large alphabets of the recursion the same steps go one by one.
"""

from __future__ import annotations

import numpy as np

_SMALL = 1024


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the last (the sentinel) counts as such."""
    n = len(s)
    differs = np.flatnonzero(s[1:] != s[:-1])
    small = np.ones(n, bool)
    if n > 1:
        at = np.searchsorted(differs, np.arange(n - 1))  # the next place where symbols differ
        known = at < len(differs)
        place = differs[np.minimum(at, max(len(differs) - 1, 0))] if len(differs) else np.zeros(n - 1, int)
        small[:-1] = np.where(known, s[np.minimum(place + 1, n - 1)] > s[place], False)
    return small


def _induce_buckets(s: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """All suffixes in the order that the order of ``lms`` induces, bucket by bucket."""
    n = len(s)
    ends = np.cumsum(np.bincount(s, minlength=symbols))
    heads = ends - np.bincount(s, minlength=symbols)
    sa = np.full(n, -1, np.int64)

    def deal(items: np.ndarray, place: np.ndarray, forward: bool) -> None:
        keys = s[items]
        order = np.argsort(keys, kind="stable")
        items, keys = items[order], keys[order]
        cuts = np.flatnonzero(np.diff(keys)) + 1
        lo = 0
        for hi in [*cuts.tolist(), len(items)]:
            c, k = int(keys[lo]), hi - lo
            if forward:
                sa[place[c] : place[c] + k] = items[lo:hi]
                place[c] += k
            else:
                sa[place[c] - k : place[c]] = items[lo:hi][::-1]
                place[c] -= k
            lo = hi

    starts = [lms[s[lms] == c] for c in range(symbols)] if symbols <= 2 else None
    if starts is None:
        by = np.argsort(s[lms], kind="stable")
        sorted_lms, sizes = lms[by], np.bincount(s[lms], minlength=symbols)
        offsets = np.cumsum(sizes) - sizes
    place = heads.copy()
    for c in range(symbols):  # larger suffixes, from the left
        if heads[c] == ends[c]:
            continue
        done = heads[c]
        while True:
            wave = sa[done : place[c]]
            if not len(wave):
                break
            done = place[c]
            before = wave[wave > 0] - 1
            before = before[~small[before]]
            if len(before):
                deal(before, place, True)
        mine = starts[c] if starts is not None else sorted_lms[offsets[c] : offsets[c] + sizes[c]]
        before = mine[mine > 0] - 1
        before = before[~small[before]]
        if len(before):
            deal(before, place, True)
    large_end = place.copy()
    place = ends.copy()
    for c in range(symbols - 1, -1, -1):  # smaller suffixes, from the right
        if heads[c] == ends[c]:
            continue
        done = ends[c]
        while True:
            wave = sa[place[c] : done][::-1]
            if not len(wave):
                break
            done = place[c]
            before = wave[wave > 0] - 1
            before = before[small[before]]
            if len(before):
                deal(before, place, False)
        wave = sa[heads[c] : large_end[c]][::-1]
        before = wave[wave > 0] - 1
        before = before[small[before]]
        if len(before):
            deal(before, place, False)
    sa[0] = n - 1  # the sentinel
    return sa


def _induce_one_by_one(s: np.ndarray, small: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    counts = np.bincount(s, minlength=symbols)
    ends = np.cumsum(counts)
    text, kind, n = s.tolist(), small.tolist(), len(s)
    sa = [-1] * n
    tail = ends.tolist()
    for i in lms[::-1].tolist():
        c = text[i]
        tail[c] -= 1
        sa[tail[c]] = i
    head = (ends - counts).tolist()
    for k in range(n):
        j = sa[k] - 1
        if j >= 0 and not kind[j]:
            c = text[j]
            sa[head[c]] = j
            head[c] += 1
    tail = ends.tolist()
    for k in range(n - 1, -1, -1):
        j = sa[k] - 1
        if j >= 0 and kind[j]:
            c = text[j]
            tail[c] -= 1
            sa[tail[c]] = j
    return np.array(sa, np.int64)


def _names(s: np.ndarray, ordered: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """For LMS positions in text order: ranks of their substrings, equal for equal ones."""
    n = len(s)
    length = np.empty(len(lms), np.int64)
    length[:-1] = np.diff(lms) + 1
    length[-1] = 1
    size = np.zeros(n, np.int64)
    size[lms] = length
    a, b = ordered[:-1], ordered[1:]
    same = size[a] == size[b]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        live = live[size[a[live]] > k]
        if not len(live):
            break
        bad = s[a[live] + k] != s[b[live] + k]
        same[live[bad]] = False
        live = live[~bad]
        k += 1
    rank = np.concatenate([[0], np.cumsum(~same)])
    name = np.zeros(n, np.int64)
    name[ordered] = rank
    return name[lms], int(rank[-1]) + 1


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array of ``s``, whose last symbol is 0 and occurs nowhere else."""
    n = len(s)
    if n <= 2:
        return np.arange(n - 1, -1, -1)
    induce = _induce_buckets if symbols <= _SMALL else _induce_one_by_one
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    first = induce(s, small, lms, symbols)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    ordered = first[is_lms[first]]
    names, k = _names(s, ordered, lms)
    if k < len(lms):
        ordered = lms[suffix_array(names, k)]
    return induce(s, small, ordered, symbols)


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position the common prefix with the suffix before it in the array.

    Where the symbols before the two suffixes agree, the value is that of the position
    before less one; only the others are compared.
    """
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = np.arange(n)
    same = np.zeros(n, bool)
    ok = (at > 0) & (phi > 0)
    same[ok] = s[at[ok] - 1] == s[phi[ok] - 1]
    base = np.flatnonzero(~same)
    length = np.zeros(len(base), np.int64)
    wide = s.astype(np.uint64)
    packed = np.zeros(n, np.uint64)
    packed[: n - 3] = wide[:-3] | wide[1:-2] << np.uint64(16) | wide[2:-1] << np.uint64(32) | wide[3:] << np.uint64(48) if n > 3 else 0
    for step in (4, 1):
        source = packed if step == 4 else wide
        live = np.flatnonzero(phi[base] >= 0)
        while len(live):
            i, j = base[live] + length[live], phi[base[live]] + length[live]
            inside = np.maximum(i, j) + step <= n
            live, i, j = live[inside], i[inside], j[inside]
            live = live[source[i] == source[j]]
            length[live] += step
    value = np.zeros(n, np.int64)
    owner = np.searchsorted(base, at, side="right") - 1
    value = length[owner] - (at - base[owner])
    return np.maximum(value, 0)


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part a flag per position: its ``length`` bytes start at another place too, in any part."""
    if not parts:
        return []
    pieces = []
    for p in parts:  # 2 to 257 are the bytes, 1 ends a part, 0 ends all
        pieces += [np.frombuffer(p, np.uint8).astype(np.int64) + 2, np.ones(1, np.int64)]
    s = np.concatenate([*pieces, np.zeros(1, np.int64)])
    sa = suffix_array(s, 258)
    lcp = permuted_lcp(s, sa)[sa]
    hit = lcp >= length
    flag = np.zeros(len(s), bool)
    flag[sa] = hit | np.append(hit[1:], False)
    # Common prefixes may run over the end of a part; a repeat must lie inside.
    out, at = [], 0
    for p in parts:
        f = flag[at : at + len(p)].copy()
        f[max(len(p) - length + 1, 0) :] = False
        out.append(f)
        at += len(p) + 1
    return out
