"""Sorted suffix runs: front coding, and merging with a loser tree that knows common prefixes."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np

# (common prefix with the entry before, key, payload)
Entry = tuple[int, bytes, tuple]


def common_prefix(x: bytes, y: bytes, known: int) -> int:
    """Bytes that two keys of equal length share, when ``known`` of them are known to be shared."""
    x, y = x[known:], y[known:]
    if x == y:
        return known + len(x)
    return known + len(x) - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8


def front_coded(keys: list[bytes]) -> bytes:
    """Sorted keys of equal length: the lengths of the prefixes shared with the key before, then the rests."""
    shared, rests, before = bytearray(), [], None
    for key in keys:
        same = 0 if before is None else common_prefix(before, key, 0)
        shared.append(same)
        rests.append(key[same:])
        before = key
    return zlib.compress(bytes(shared) + b"".join(rests), 1)


def coded_rows(keys: np.ndarray, shared: np.ndarray) -> bytes:
    """The same from a matrix with a key per row; ``shared`` holds the prefix shared with the row before, whatever it says of the first."""
    shared = shared.copy()
    shared[:1] = 0
    rests = keys[np.arange(keys.shape[1]) >= shared[:, None]]
    return zlib.compress(shared.astype(np.uint8).tobytes() + rests.tobytes(), 1)


def decoded(data: bytes, count: int, width: int) -> Iterator[tuple[int, bytes]]:
    """The keys again, each with the prefix it shares with the one before."""
    data = zlib.decompress(data)
    at, key = count, b""
    for same in data[:count]:
        rest = width - same
        key = key[:same] + data[at : at + rest]
        at += rest
        yield same, key


def merged(runs: list[Iterable[Entry]]) -> Iterator[Entry]:
    """One sorted stream of all runs; each entry with the prefix it shares with the entry before it in the stream.

    A loser holds the prefix it shares with the winner that beat it, so at the next match, where both sides have lost to
    or followed that same winner, the side that shares more with it is smaller, and only ties are compared: behind the
    prefix that both are known to share.
    """
    sources = [iter(run) for run in runs]
    width = 1 << max(0, len(sources) - 1).bit_length()
    losers: list = [None] * (2 * width)

    def play(x, y):
        if x is None or y is None:
            return (y, x) if x is None else (x, y)
        if x[0] != y[0]:
            return (x, y) if x[0] > y[0] else (y, x)
        shared = common_prefix(x[1], y[1], x[0])
        if x[1] <= y[1]:
            y[0] = shared
            return x, y
        x[0] = shared
        return y, x

    def head(i):
        entry = next(sources[i], None) if i < len(sources) else None
        return None if entry is None else [entry[0], entry[1], entry[2], i]

    first = [None] * width + [head(i) for i in range(width)]
    for node in range(width - 1, 0, -1):
        first[node], losers[node] = play(first[2 * node], first[2 * node + 1])
    winner = first[1] if width > 1 else first[-1]
    while winner is not None:
        yield winner[0], winner[1], winner[2]
        source = winner[3]
        winner = head(source)
        node = (width + source) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def packed(values: np.ndarray) -> bytes:
    """Whole numbers from a base, in as few bytes each as the largest needs."""
    if not len(values):
        return b""
    base = int(values.min())
    rest = (values.astype(np.int64) - base).astype(np.uint64)
    width = max(1, (int(rest.max()).bit_length() + 7) // 8)
    return base.to_bytes(8, "little", signed=True) + bytes([width]) + rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.int64)
    base, width = int.from_bytes(data[:8], "little", signed=True), data[8]
    rest = np.zeros(((len(data) - 9) // width, 8), np.uint8)
    rest[:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    return rest.view("<u8").reshape(-1).astype(np.int64) + base
