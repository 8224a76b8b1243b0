"""Suffix arrays by induced sorting, at every level of the recursion, and permuted common prefixes."""

from __future__ import annotations

import numpy as np

#: Buckets of fewer symbols than this on average are scanned symbol by symbol; larger ones are vectors.
BUCKET = 256


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one (S-type). The last symbol, the sentinel, is S-type."""
    n = len(t)
    up, differs = np.ones(n, dtype=bool), np.ones(n, dtype=bool)
    up[:-1], differs[:-1] = t[:-1] < t[1:], t[:-1] != t[1:]
    at = np.where(differs, np.arange(n), n)  # a run of equal symbols has the type of its last
    return up[np.minimum.accumulate(at[::-1])[::-1]]


def _deal(items: np.ndarray, symbols: np.ndarray, buckets: list[list[np.ndarray]]) -> None:
    """Append `items` to their symbols' buckets, in their order."""
    if not len(items):
        return
    order = np.argsort(symbols, kind="stable")
    items, symbols = items[order], symbols[order]
    cuts = np.flatnonzero(np.diff(symbols)) + 1
    for part, s in zip(np.split(items, cuts), symbols[np.concatenate([[0], cuts])].tolist(), strict=True):
        buckets[s].append(part)


def _join(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The suffix array that follows from the leftmost-S suffixes in the order `lms`.

    Left to right, each bucket's known suffixes place their L-type predecessors at the bucket fronts; right to left, the
    S-type ones at the bucket ends. A bucket is a vector; runs of one symbol take a round each.
    """
    seeds: list[list[np.ndarray]] = [[] for _ in range(k)]
    _deal(lms, t[lms], seeds)
    larger: list[list[np.ndarray]] = [[] for _ in range(k)]
    placed = []
    for c in range(k):
        own, now = [], _join(larger[c])
        while len(now):
            own.append(now)
            before = now[now > 0] - 1
            before = before[~small[before]]
            same = t[before] == c
            _deal(before[~same], t[before[~same]], larger)
            now = before[same]
        placed.append(_join(own))
        start = _join(seeds[c])
        start = start[start > 0] - 1
        start = start[~small[start]]
        _deal(start, t[start], larger)
    smaller: list[list[np.ndarray]] = [[] for _ in range(k)]
    smaller[0].append(np.array([len(t) - 1], dtype=np.int32))  # the sentinel, which nothing induces
    out: list[np.ndarray] = []
    for c in range(k - 1, -1, -1):
        own, now = [], _join(smaller[c])
        while len(now):
            own.append(now)
            before = now[now > 0] - 1
            before = before[small[before]]
            same = t[before] == c
            _deal(before[~same], t[before[~same]], smaller)
            now = before[same]
        front = placed[c][::-1]
        front = front[front > 0] - 1
        front = front[small[front]]
        _deal(front, t[front], smaller)
        out += [_join(own), placed[c][::-1]]
    return _join(out)[::-1]


def induce_by_scan(t: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """What `induce` returns, for alphabets whose buckets are too small to be vectors: one linear scan each way."""
    ends = np.cumsum(np.bincount(t, minlength=k))
    sa = np.full(len(t), -1, dtype=np.int32)
    seeds = lms[np.argsort(t[lms], kind="stable")]
    seeded = np.cumsum(np.bincount(t[lms], minlength=k))
    sa[np.arange(len(seeds)) + (ends - seeded)[t[seeds]]] = seeds  # at the bucket ends
    sa = sa.tolist()
    # by place, the symbol of the predecessor if the scan is to file it, else -1; the entry after the last is for empty slots
    before, is_small = np.append(-1, t[:-1]), np.append(True, small[:-1])
    larger = np.append(np.where(is_small, -1, before), -1).tolist()
    smaller = np.append(np.where(is_small, before, -1), -1).tolist()
    front, back = np.append(0, ends[:-1]).tolist(), ends.tolist()
    for j in sa:  # the list fills ahead of the scan
        c = larger[j]
        if c >= 0:
            p = front[c]
            sa[p] = j - 1
            front[c] = p + 1
    for j in reversed(sa):
        c = smaller[j]
        if c >= 0:
            p = back[c] - 1
            sa[p] = j - 1
            back[c] = p
    return np.array(sa, dtype=np.int32)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffix array of `t`, whose last symbol is smaller than all others (a sentinel); below 2**31 symbols.

    Symbols below 65536 are dealt to their buckets by numpy's radix sort, so they are kept in 16 bits.
    """
    if len(t) == 1:
        return np.zeros(1, dtype=np.int32)
    k = int(t.max()) + 1
    t = t.astype(np.uint16 if k <= 1 << 16 else np.int32)
    file = induce if len(t) >= BUCKET * k else induce_by_scan
    small = suffix_types(t)
    is_lms = small.copy()
    is_lms[0] = False
    is_lms[1:] &= ~small[:-1]
    lms = np.flatnonzero(is_lms).astype(np.int32)
    if len(lms) > 1:
        order = file(t, small, lms, k)
        order = order[is_lms[order]]  # leftmost-S suffixes by their substrings
        end = np.append(lms[1:], len(t) - 1)
        length = np.zeros(len(t), dtype=np.int32)
        length[lms] = end - lms + 1
        a, b = order[:-1], order[1:]
        same = length[a] == length[b]
        alive, i = np.flatnonzero(same), 0
        while len(alive):  # symbol by symbol, over the pairs still equal
            equal = t[a[alive] + i] == t[b[alive] + i]
            same[alive[~equal]] = False
            alive, i = alive[equal], i + 1
            alive = alive[length[a[alive]] > i]
        name = np.zeros(len(t), dtype=np.int32)
        name[order] = np.concatenate([[0], np.cumsum(~same)])
        lms = lms[suffix_array(name[lms])] if not (~same).all() else order
    return file(t, small, lms, k)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, most: int, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(phi, plcp): by text place, the suffix before it in `sa`, and their common prefix, at most `most` symbols.

    Symbols are below 65536; four go into a word, and only places whose words were equal so far are compared further.
    With `asked` (a flag for every place), other places get 0.
    """
    n = len(t)
    phi = np.full(n, n, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    padded = np.concatenate([t.astype(np.uint64), np.zeros(most + 8, dtype=np.uint64)])
    word = padded[:-3] | padded[1:-2] << np.uint64(16) | padded[2:-1] << np.uint64(32) | padded[3:] << np.uint64(48)
    plcp = np.zeros(n, dtype=np.int64)
    alive = np.flatnonzero(phi < n if asked is None else asked & (phi < n))
    for i in range(0, most, 4):
        differ = word[alive + i] ^ word[phi[alive] + i]
        ended = differ != 0
        bits = differ[ended] & (~differ[ended] + np.uint64(1))  # lowest set bit
        plcp[alive[ended]] = i + np.searchsorted(np.array([1 << 16, 1 << 32, 1 << 48], dtype=np.uint64), bits, "right")
        alive = alive[~ended]
    plcp[alive] = most
    return phi, np.minimum(plcp, most)
