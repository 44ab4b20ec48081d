"""Static 3-wise binary-fuse filters over 64-bit keys with 8-bit fingerprints, built and probed in NumPy."""

from __future__ import annotations

import math
import struct

import numpy as np

HEAD = struct.Struct("<QII")
MUL1, MUL2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys + np.uint64(seed)
        h ^= h >> np.uint64(33)
        h *= MUL1
        h ^= h >> np.uint64(33)
        h *= MUL2
        h ^= h >> np.uint64(33)
    return h


def places(h: np.ndarray, length: int, segments: int) -> np.ndarray:
    """The three slots of each hash, in neighbouring segments."""
    mask = np.uint64(length - 1)
    first = ((h >> np.uint64(32)) * np.uint64(segments * length)) >> np.uint64(32)
    second = (first + np.uint64(length)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * length)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def fingerprint(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """A filter of the keys (repeats count once). It says yes to every one of them and to about 1 in 256 others."""
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    if not n:
        return HEAD.pack(0, 0, 0)
    length = 1 << max(2, min(18, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))
    segments = max(1, math.ceil(n * factor / length) - 2)
    for seed in range(1, 200):
        h = mixed(keys, seed * 0x9E3779B97F4A7C15 & (2**64 - 1))
        at = places(h, length, segments)
        slots = (segments + 2) * length
        count = np.bincount(at.ravel(), minlength=slots)
        owner = np.zeros(slots, np.int64)  # xor of the keys in a slot: the key itself where there is one
        for row in at:
            np.bitwise_xor.at(owner, row, np.arange(n))
        rounds, left, front = [], n, np.flatnonzero(count == 1)
        while len(front):
            who, first = np.unique(owner[front], return_index=True)
            slot = front[first]
            rounds.append((who, slot))
            left -= len(who)
            gone = at[:, who]
            np.subtract.at(count, gone.ravel(), 1)
            np.bitwise_xor.at(owner, gone.ravel(), np.tile(who, 3))
            touched = np.unique(gone)
            front = touched[count[touched] == 1]
        if left:
            segments += left > n // 2  # far too dense: one segment more
            continue
        table, prints = np.zeros(slots, np.uint8), fingerprint(h)
        for who, slot in reversed(rounds):
            a, b, c = (table[x] for x in at[:, who])  # the slot itself is still 0
            table[slot] = prints[who] ^ a ^ b ^ c
        return HEAD.pack(seed * 0x9E3779B97F4A7C15 & (2**64 - 1), length, segments) + table.tobytes()
    raise ValueError("no binary-fuse filter found for these keys")


def probe(blob: bytes, keys: np.ndarray) -> np.ndarray:
    seed, length, segments = HEAD.unpack_from(blob)
    if not length:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(blob, np.uint8, offset=HEAD.size)
    h = mixed(keys.astype(np.uint64), seed)
    at = places(h, length, segments)
    return (table[at[0]] ^ table[at[1]] ^ table[at[2]]) == fingerprint(h)
