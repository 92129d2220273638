"""Suffix arrays by two-stage sorting, and common prefixes of neighbours."""

from __future__ import annotations

import numpy as np

PAD = 72  # zero bytes that must follow the text


def words8(text: np.ndarray) -> np.ndarray:
    """At every place but the padding, the next eight bytes as one big-endian number."""
    n = len(text) - 8
    out = np.zeros(n, np.uint64)
    for k in range(8):
        out |= text[k:n + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Whether the suffix at each place is smaller than the one after it."""
    step = np.diff(text.astype(np.int16), append=np.int16(-1))
    changes = np.flatnonzero(step)
    return step[changes[np.searchsorted(changes, np.arange(len(text)))]] > 0


def _sort_direct(words: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of their first ``depth`` bytes: eight bytes first, then five more at a time where there are ties."""
    key = words[at]
    order = np.argsort(key)
    at, key = at[order], key[order]
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    offset = 8
    while offset < depth and len(at):
        # Members of groups of several, with the group's number in the high bits.
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        group = np.cumsum(new[tied]).astype(np.uint64)
        key = (group << np.uint64(40)) | (words[at[tied] + offset] >> np.uint64(24))
        order = np.argsort(key)
        at[tied] = at[tied][order]
        key = key[order]
        new[tied[1:]] = key[1:] != key[:-1]
        offset += 5
    return at


def suffix_array(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Places marked in ``wanted``, in the order of their suffixes as far as ``depth`` bytes tell; ties stand together.

    Suffixes smaller than their successors are sorted directly. Each other suffix follows from its successor: buckets of the
    first byte are scanned in ascending order, and every place met puts the place before it at the end of that one's bucket.
    ``text`` ends with ``PAD`` zeros.
    """
    n = len(text)
    small = smaller_than_next(text)
    # A larger suffix is induced from the next smaller one, so the places up to there are needed too.
    needed = wanted.copy()
    ends = np.flatnonzero(wanted[:-1] & ~wanted[1:] & ~small[:-1])
    if len(ends):
        smalls = np.append(np.flatnonzero(small), n - 1)
        change = np.zeros(n + 1, np.int32)
        np.add.at(change, ends + 1, 1)
        np.add.at(change, np.minimum(smalls[np.searchsorted(smalls, ends)], n - PAD) + 1, -1)
        needed |= np.cumsum(change[:-1]) > 0
    needed[n - PAD:] = False
    direct = _sort_direct(words8(text), np.flatnonzero(needed & small), depth + 6)
    first = text[direct]
    bounds = np.searchsorted(first, np.arange(257))
    induced = needed & ~small
    # The scan starts from what no needed successor precedes: places whose successor lies in the padding.
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    last = n - PAD - 1
    if last >= 0 and induced[last]:
        waiting[text[last]].append(np.array([last]))
    out = []
    for c in range(256):
        scanned = list(waiting[c])
        part = np.concatenate(scanned) if scanned else np.zeros(0, np.int64)
        while len(part):  # runs of one byte: the longer is the larger
            before = part[part > 0] - 1
            part = before[induced[before] & (text[before] == c)]
            scanned.append(part)
        scanned.append(direct[bounds[c]:bounds[c + 1]])
        bucket = np.concatenate(scanned)
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before]]
        byte = text[before]
        before, byte = before[byte > c], byte[byte > c]
        order = np.argsort(byte, kind="stable")
        before, byte = before[order], byte[order]
        edges = np.flatnonzero(np.diff(byte)) + 1
        for part in np.split(before, edges):
            if len(part):
                waiting[text[part[0]]].append(part)
    every = np.concatenate(out) if out else np.zeros(0, np.int64)
    return every[wanted[every]]


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes, at most ``most``, that each suffix of ``order`` shares with the one before it (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    words = words8(text)
    open_ = np.arange(1, len(order))
    for offset in range(0, most, 8):
        if not len(open_):
            break
        differ = words[order[open_] + offset] ^ words[order[open_ - 1] + offset]
        same = differ == 0
        out[open_[same]] = offset + 8
        rest = differ[~same]
        high = (rest >> np.uint64(32)) > 0
        bits = np.where(high, np.frexp((rest >> np.uint64(32)).astype(np.float64))[1] + 32, np.frexp((rest & np.uint64(0xFFFFFFFF)).astype(np.float64))[1])
        out[open_[~same]] = offset + (64 - bits) // 8
        open_ = open_[same]
    return np.minimum(out, most)
