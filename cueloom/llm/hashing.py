"""Hashes of the words of many texts at once, over their UTF-8 bytes.

Words are runs of bytes other than ASCII white space, with A-Z in lower case. A word's hash is
the sum of a random number for each byte times a power of an odd base, modulo 2**64: sums over
any span come from one running sum, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240607)
_odd = lambda *n: _rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _odd(256)
_BYTE[65:91] = _BYTE[97:123]
_BASE = int(_odd(1)[0])
_STEP = _odd(8)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes hashed at a time; longer texts are cut at white space.
BLOCK = 1 << 20
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n."""
    if not _powers or len(_powers[0]) <= n:
        n = max(n, BLOCK) + 1
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """Spread all bits of each number over the number."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(NamedTuple):
    """hashes: of all words; starts, ends: their bytes; counts: words of each text."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    prefixes: dict[int, np.ndarray]


def hash_block(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = ()) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``; prefixes: also hashes of each word's first bytes."""
    n = len(data)
    power, inverse = _powers_to(n)
    solid = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    starts = np.flatnonzero(solid & (first[:n] | np.concatenate([[True], ~solid[:-1]])[:n]))
    ends = np.flatnonzero(solid & (first[1:] | np.concatenate([~solid[1:], [True]])[:n])) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[:n], out=total[1:])
    span = lambda to: mix64((total[to] - total[starts]) * inverse[starts])
    counts = np.diff(np.searchsorted(starts, offsets))
    return Words(span(ends), starts, ends, counts, {k: span(np.minimum(starts + k, ends)) for k in prefixes})


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about a block: first index, number, bytes, offsets. Null texts are empty."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1)
        j = min(j, len(texts))
        yield i, j - i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_runs(texts: pa.Array, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray, Words]]:
    """For runs of texts: index of the first, their bytes, their words; places are in those bytes."""
    for at, n, data, offsets in blocks(texts):
        if n > 1 or len(data) <= 2 * BLOCK:
            yield at, data, hash_block(data, offsets, prefixes)
            continue
        parts, i = [], 0
        while i < len(data):  # one very long text
            j = min(i + BLOCK, len(data))
            while j < len(data) and not _SPACE[data[j]]:
                j += 1
            w = hash_block(data[i:j], np.array([0, j - i]), prefixes)
            parts.append(w._replace(starts=w.starts + i, ends=w.ends + i))
            i = j
        hashes, starts, ends = (np.concatenate([p[k] for p in parts]) for k in range(3))
        yield at, data, Words(hashes, starts, ends, np.array([len(hashes)]), {k: np.concatenate([p.prefixes[k] for p in parts]) for k in prefixes})


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct hashes of ``size`` words in a row, sorted; of all its words if it has fewer."""
    for _, _, (hashes, _, _, counts, _) in word_runs(texts):
        runs = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
        for k in range(size if len(runs) else 0):
            runs += hashes[k : k + len(runs)] * _STEP[k]
        runs = mix64(runs)
        at = 0
        for n in counts:
            if n >= size:
                yield np.unique(runs[at : at + n - size + 1])
            elif n:
                yield mix64(np.sum(hashes[at : at + n] * _STEP[:n], keepdims=True, dtype=np.uint64) + _STEP[7:] * np.array([n], np.uint64))
            else:
                yield np.zeros(0, np.uint64)
            at += n
