"""Two-stage suffix sorting of one text in memory, to a given depth, and common prefixes of neighbours."""

from __future__ import annotations

import numpy as np


def words_at(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number that sorts like them; beyond the end are zeros."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(text)]
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """For each suffix: is it smaller than the one that starts a byte later? The last isn't."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1:] = -1
    at = np.where(step != 0, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]  # equal bytes: as the next place that differs
    return step[at] > 0


def sorted_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """places in the order of their suffixes' first depth bytes; only those still tied are looked at again."""
    key = words[places]
    order = np.argsort(key, kind="stable")
    out, key = places[order], key[order]
    slots = np.arange(len(out))
    for offset in range(8, depth + 8, 8):
        same = np.append(False, key[1:] == key[:-1])
        if offset > 8:
            same &= np.append(False, group[1:] == group[:-1])
        tied = same | np.append(same[1:], False)
        if not tied.any() or offset >= depth:
            break
        head = np.cumsum(~same)
        slots, group = slots[tied], head[tied]
        active = out[slots]
        far = active + offset
        key = np.where(far < len(words), words[np.minimum(far, len(words) - 1)], 0).astype(np.uint64)
        order = np.lexsort((key, group))
        out[slots] = active[order]
        key = key[order]
    return out


def suffix_array(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes' places, sorted by their first depth bytes, and words_at(text).

    Suffixes smaller than their successor are sorted directly. The others follow in one scan of the buckets of
    first bytes: whatever suffix comes next in order, the larger one that starts a byte before it is the next of
    its own bucket.
    """
    n = len(text)
    words = words_at(text)
    if not n:
        return np.zeros(0, np.int64), words
    small = smaller_than_next(text)
    direct = sorted_directly(np.flatnonzero(small), words, depth)
    cut = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        larger, wave = [], np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        while len(wave):  # a run of one byte induces within its bucket
            larger.append(wave)
            before = wave[wave > 0] - 1
            wave = before[~small[before] & (text[before] == c)]
        bucket = np.concatenate([*larger, direct[cut[c] : cut[c + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[~small[before] & (text[before] > c)]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            at = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
            for run, b in zip(np.split(before, at[1:]), first[at], strict=True):
                waiting[b].append(run)
    return np.concatenate(out), words


def common_prefixes(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that each place's suffix shares with the one before it in places, depth at most; 0 for the first."""
    out = np.zeros(len(places), np.int64)
    open_ = np.arange(1, len(places))
    read = lambda at: np.where(at < len(words), words[np.minimum(at, len(words) - 1)], 0)
    for offset in range(0, depth, 8):
        a, b = read(places[open_ - 1] + offset), read(places[open_] + offset)
        same = a == b
        differ = (a ^ b)[~same]
        zeros = np.zeros(len(differ), np.int64)
        for k in range(1, 8):
            zeros += differ >> np.uint64(64 - 8 * k) == 0
        out[open_[~same]] += zeros
        open_ = open_[same]
        out[open_] += 8
        if not len(open_):
            break
    return np.minimum(out, depth)
