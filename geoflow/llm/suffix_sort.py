"""Two-stage suffix sorting of one task's pieces, and what their neighbours share.

Only suffixes that start a window (``length`` bytes inside one piece) have to be in order,
and only by their first ``length`` bytes. A suffix smaller than its successor is sorted
directly; one that is larger is induced: it stands where its first byte's bucket is up, in
the order of its successors. Buckets are scanned from the smallest byte on.
"""

from __future__ import annotations

import numpy as np

#: Ends a piece; no byte of UTF-8.
END = 0xFF


def suffix_order(data: bytes, windows: np.ndarray, length: int) -> np.ndarray:
    """The positions ``windows`` ordered by the ``length`` bytes that begin there.

    ``data`` ends with ``END``, as does every piece in it.
    """
    text = np.frombuffer(data, np.uint8)
    n = len(text)
    # Smaller than its successor: the next differing byte is larger. The last byte counts as larger than what follows.
    change = np.flatnonzero(text[1:] != text[:-1])
    following = change[np.minimum(np.searchsorted(change, np.arange(n)), len(change) - 1)] if len(change) else np.zeros(n, np.int64)
    smaller = np.zeros(n, bool)
    valid = following >= np.arange(n)
    smaller[valid] = text[following[valid] + 1] > text[following[valid]]

    # What is needed: the windows, and behind each of them the way to the first suffix that is sorted directly.
    needed = np.zeros(n, bool)
    needed[windows] = True
    edge = windows[~needed[np.minimum(windows + 1, n - 1)] & ~smaller[windows]]
    while len(edge):
        edge = edge + 1
        needed[edge] = True
        edge = edge[~smaller[edge]]

    direct = np.flatnonzero(needed & smaller)
    keys = [data[i:i + length] for i in direct.tolist()]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)]
    del keys

    own = np.split(direct, np.searchsorted(text[direct], np.arange(1, 256)))  # by first byte, in order
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order = []
    for byte in range(256):
        # The larger suffixes of a bucket come first; runs of one byte induce each other.
        step = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
        bucket = [step]
        while len(step):
            before = step - 1
            step = before[(before >= 0) & (text[before] == byte) & needed[before] & ~smaller[before]]
            bucket.append(step)
        bucket = np.concatenate([*bucket, own[byte]])
        order.append(bucket)
        before = bucket - 1
        before = before[before >= 0]
        before = before[(text[before] > byte) & needed[before]]
        if len(before):
            first = text[before]
            placed = np.argsort(first, kind="stable")
            before, first = before[placed], first[placed]
            for run in np.split(before, np.flatnonzero(np.diff(first)) + 1):
                waiting[text[run[0]]].append(run)
    order = np.concatenate(order)
    is_window = np.zeros(n, bool)
    is_window[windows] = True
    return order[is_window[order]]


def common_prefixes(data: bytes, order: np.ndarray, length: int) -> np.ndarray:
    """Bytes, at most ``length``, that each suffix of ``order`` shares with the one before; 0 for the first."""
    text = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint64)
    word = text.copy()
    for width in (1, 2, 4):  # eight bytes from each position, the first in the lowest place
        word[:-width] |= word[width:] << np.uint64(8 * width)
    shared = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    at = 0
    while len(live) and at < length:
        a, b = word[order[live] + at], word[order[live - 1] + at]
        same = a == b
        differ = live[~same]
        if len(differ):
            low = a[~same] ^ b[~same]
            low &= ~low + np.uint64(1)  # the lowest bit that differs
            shared[differ] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        live = live[same]
        at += 8
    shared[live] = length
    return np.minimum(shared, length)


def repeated_windows(pieces: list[bytes], weights: list[int], length: int) -> list[np.ndarray]:
    """For each piece the starts of its windows that occur at least twice, where a piece occurs ``weights`` times."""
    counts = np.array([len(p) - length + 1 for p in pieces])
    data = b"".join(p + bytes([END]) for p in pieces)
    begins = np.cumsum([0, *(len(p) + 1 for p in pieces[:-1])])
    owner = np.repeat(np.arange(len(pieces)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    windows = begins[owner] + offset
    order = suffix_order(data, windows, length)
    run = np.cumsum(common_prefixes(data, order, length) < length) - 1
    at = np.searchsorted(windows, order)
    total = np.bincount(run, np.array(weights)[owner[at]])
    often = np.zeros(len(windows), bool)
    often[at] = total[run] >= 2
    return [offset[a:b][often[a:b]] for a, b in zip(np.cumsum(counts) - counts, np.cumsum(counts))]
