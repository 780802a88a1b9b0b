"""Suffix arrays by two-stage sorting, exact to a given depth."""

from __future__ import annotations

import numpy as np


def sorted_directly(symbols: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """These suffixes in the order of their first `depth` symbols."""
    if not len(starts):
        return starts
    padded = np.concatenate((symbols, np.zeros(depth, np.uint8)))
    heads = np.lib.stride_tricks.as_strided(padded, shape=(len(symbols), depth), strides=(1, 1))[starts]
    return starts[np.argsort(heads.view(f"S{depth}").ravel(), kind="stable")]


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of symbols (uint8), in the order of their first `depth` symbols at least.

    First stage: the suffixes that are smaller than their successors are sorted directly. Second stage: a
    scan of the buckets (suffixes by first symbol) in ascending order puts every other suffix behind those
    of its bucket that came before: a bucket's larger suffixes are the predecessors of suffixes placed
    already, a wave for each further repetition of its own symbol.
    """
    n = len(symbols)
    if not n:
        return np.zeros(0, dtype=np.int64)
    change = np.flatnonzero(symbols[1:] != symbols[:-1])  # last place of each run
    run_end = np.append(change, n - 1)
    following = np.append(symbols, np.uint8(0)).astype(np.int16)
    rises = following[run_end] < following[run_end + 1]
    rises[-1] = False  # the end is smaller than any symbol
    smaller = np.repeat(rises, np.diff(np.concatenate(([-1], run_end))))

    direct = sorted_directly(symbols, np.flatnonzero(smaller), depth)
    first = np.searchsorted(symbols[direct], np.arange(257))  # they are in order of their first symbols

    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[symbols[-1]].append(np.array([n - 1], dtype=np.int64))
    out = []
    for c in range(256):
        wave = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        waiting[c] = []
        bucket = []
        while len(wave):
            bucket.append(wave)
            before = wave[wave > 0] - 1
            wave = before[symbols[before] == c]
        bucket.append(direct[first[c] : first[c + 1]])
        done = np.concatenate(bucket)
        if not len(done):
            continue
        out.append(done)
        before = done[done > 0] - 1
        symbol = symbols[before]
        before, symbol = before[symbol > c], symbol[symbol > c]
        order = np.argsort(symbol, kind="stable")
        before, symbol = before[order], symbol[order]
        cuts = np.flatnonzero(np.diff(symbol)) + 1
        if len(before):
            for part, s in zip(np.split(before, cuts), symbol[np.concatenate(([0], cuts))]):
                waiting[s].append(part)
    return np.concatenate(out)


def common_prefixes(symbols: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """For each place of order but the first: symbols that its suffix shares with the one before, `most` at most."""
    a, b = order[:-1], order[1:]
    padded = np.concatenate((symbols, np.zeros(most + 16, np.uint8)))
    eight = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), shape=(len(symbols) + most + 8,), strides=(1,))
    shared = np.full(len(a), most, dtype=np.int64)
    alive = np.arange(len(a))
    left, right = a.copy(), b.copy()
    for at in range(0, most, 8):
        differ = eight[left] ^ eight[right]
        equal = differ == 0
        if not equal.all():
            word = differ[~equal]
            low = np.log2((word & (~word + np.uint64(1))).astype(np.float64)).astype(np.int64)  # little-endian: the first symbol is in the lowest byte
            shared[alive[~equal]] = at + low // 8
            alive, left, right = alive[equal], left[equal], right[equal]
            if not len(alive):
                break
        left += 8
        right += 8
    return np.minimum(np.minimum(shared, len(symbols) - np.maximum(a, b)), most)
