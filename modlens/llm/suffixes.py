"""Two-stage suffix sorting of a byte array, to a given depth."""

from __future__ import annotations

import numpy as np


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor. The end of the text is smaller than any byte."""
    n = len(text)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    differs = np.append(text[:-1] != text[1:], True)
    at = np.where(differs, np.arange(n), n)
    turn = np.minimum.accumulate(at[::-1])[::-1]  # where the run of equal bytes that holds i ends
    inside = turn < n - 1
    out[inside] = text[turn[inside]] < text[turn[inside] + 1]
    return out


def needed(small: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted suffixes, and all that their places are induced from: those after each, up to one smaller than its successor."""
    n = len(small)
    last = np.append(-1, np.maximum.accumulate(np.where(small, np.arange(n), -1))[:-1])
    count = np.append(0, np.cumsum(wanted))
    return count[1:] > count[last + 1]


def suffix_array(text: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Positions in the order of their suffixes' first `depth` bytes at least; of the wanted ones alone, if a mask is given.

    Stage one sorts only the suffixes that are smaller than their successors, bucket by first byte. Stage two scans the
    buckets in order: every suffix i that has its place gives the next place of the bucket of text[i - 1] to suffix
    i - 1 if that is larger than its successor. Within a bucket these come before the directly sorted ones.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    small = types(text)
    raw = text.tobytes()
    need = np.ones(n, bool) if wanted is None else needed(small, wanted)
    large = need & ~small
    direct = np.flatnonzero(need & small)
    direct = direct[np.argsort(text[direct], kind="stable")]
    limits = np.searchsorted(text[direct], np.arange(257))
    places: list[list[np.ndarray]] = [[] for _ in range(256)]
    if large[n - 1]:
        places[text[n - 1]].append(np.array([n - 1]))  # the empty suffix comes first and induces the last one
    out = []
    for c in range(256):
        part = wave = np.concatenate(places[c]) if places[c] else np.zeros(0, np.int64)
        waves = [part]
        while len(wave):  # those that this bucket induces in itself
            p = wave[wave > 0] - 1
            wave = p[(text[p] == c) & large[p]]
            waves.append(wave)
        mine = direct[limits[c] : limits[c + 1]].tolist()
        mine.sort(key=lambda i: raw[i : i + depth])
        bucket = np.concatenate([*waves, np.array(mine, np.int64)])
        if not len(bucket):
            continue
        out.append(bucket)
        p = bucket[bucket > 0] - 1
        p = p[(text[p] > c) & large[p]]
        if len(p):
            p = p[np.argsort(text[p], kind="stable")]
            firsts, starts = np.unique(text[p], return_index=True)
            for byte, group in zip(firsts, np.split(p, starts[1:])):
                places[byte].append(group)
        places[c] = []
    order = np.concatenate([*out, np.zeros(0, np.int64)])
    return order if wanted is None else order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each suffix but the first of the order, how many bytes it shares with the one before it, `most` at the most."""
    n = len(text)
    padded = np.append(text, np.zeros(8, np.uint8))
    words = np.lib.stride_tricks.as_strided(padded, (n + 1, 8), (1, 1)).copy().view(">u8").reshape(-1) if n else np.zeros(1, ">u8")
    a, b = order[:-1], order[1:]
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    for k in range(0, most, 8):
        x, y = a[open_] + k, b[open_] + k
        inside = (x < n) & (y < n)
        open_, x, y = open_[inside], x[inside], y[inside]
        diff = (words[x] ^ words[y]).astype(np.uint64)
        same = np.full(len(diff), 8)
        some = diff != 0
        if some.any():
            d = diff[some]
            lead = np.zeros(len(d), np.int64)
            for s in (32, 16, 8):  # leading zero bytes
                z = d >> np.uint64(64 - s) == 0
                lead[z] += s // 8
                d[z] = d[z] << np.uint64(s)
            same[some] = lead
        same = np.minimum(same, np.minimum(n - x, n - y))
        out[open_] += same
        open_ = open_[same == 8]
        if not len(open_):
            break
    return np.minimum(out, most)


def share_start(text: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """For each suffix but the first of the order, whether its common prefix with the one before it has `width` bytes; all
    suffixes of the order have as many."""
    out = np.zeros(max(len(order) - 1, 0), bool)
    if len(out):
        windows = np.lib.stride_tricks.sliding_window_view(text, width)
        for lo in range(0, len(out), 1024):
            rows = windows[order[lo : lo + 1025]]
            out[lo : lo + 1024] = (rows[1:] == rows[:-1]).all(axis=1)
    return out
