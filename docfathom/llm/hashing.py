"""Rolling 64-bit hashes of bytes and words of whole Arrow batches, in NumPy."""

from __future__ import annotations

import numpy as np

#: The white space that ends a word: space, and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _byte_values(seed: int, lower: bool) -> np.ndarray:
    values = np.random.Generator(np.random.PCG64(977 + seed)).integers(1, 2**64, 256, np.uint64, endpoint=False)
    if lower:
        values[65:91] = values[97:123]
    return values


_VALUES = {(s, low): _byte_values(s, low) for s in (0, 1) for low in (False, True)}


def powers(n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of an odd base and of its inverse modulo 2**64."""
    have = _powers.get(seed)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        base = _BASES[seed]
        pair = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            pair.append(np.multiply.accumulate(p))
        have = _powers[seed] = (pair[0], pair[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64), in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sums(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """Prefix sums of values times powers, for window_hash()."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), seed)[0], out=out[1:])
    return out


def window_hash(prefix: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of every window of length values."""
    n = len(prefix) - length
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((prefix[length:] - prefix[:n]) * powers(n, seed)[1])


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each row begins (one more entry than rows); null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


class Words:
    """The words of a batch: starts, ends (in bytes), first (index of each row's first word, and the end), hash."""

    def __init__(self, column, lower: bool = False):
        data, offs = text_buffer(column)
        n = len(data)
        gap = SPACE[data]
        start, end = ~gap, ~gap
        cut = np.zeros(n + 1, bool)
        cut[offs] = True
        if n:
            start[1:] &= gap[:-1] | cut[1:n]
            end[:-1] &= gap[1:] | cut[1:n]
        self.data, self.offs = data, offs
        self.starts = np.flatnonzero(start)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.lower, self._hashes = lower, {}

    def hash_of(self, seed: int) -> np.ndarray:
        """A hash for each word; seeds 0 and 1 are independent."""
        if seed not in self._hashes:
            p = sums(_VALUES[seed, self.lower][self.data], seed)
            inverse = powers(max(len(self.data), 1), seed)[1]
            self._hashes[seed] = mix((p[self.ends] - p[self.starts]) * inverse[self.starts])
        return self._hashes[seed]

    @property
    def hash(self) -> np.ndarray:
        return self.hash_of(0)


def byte_values(data: np.ndarray, seed: int = 0) -> np.ndarray:
    return _VALUES[seed, False][data]


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over every window of width entries, by doubling."""
    if len(x) < width:
        return x[:0]
    step = 1
    while 2 * step <= width:
        x = best(x[:-step], x[step:])
        step *= 2
    return best(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def starts_within(first: np.ndarray, length: int) -> np.ndarray:
    """Which positions begin a window of length entries that stays in its row; first: bounds of the rows."""
    n = int(first[-1])
    inside = np.zeros(n + 1, np.int32)
    lengths = np.diff(first)
    rows = lengths >= length
    np.add.at(inside, first[:-1][rows], 1)
    np.add.at(inside, (first[1:] - length + 1)[rows], -1)
    return np.cumsum(inside[:n]) > 0


def covered(hits: np.ndarray, length: int) -> np.ndarray:
    """Positions within length entries from a start in hits (a mask as long as the rows together)."""
    n = len(hits)
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(hits)
    np.add.at(edge, at, 1)
    np.add.at(edge, np.minimum(at + length, n), -1)
    return np.cumsum(edge[:n]) > 0
