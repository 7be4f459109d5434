"""Vectorised word splitting and hashing over batches of texts.

Texts of a slice are joined into one byte buffer. A 256-entry table maps every byte to
its normalised form, or to 0 where it separates words. Word hashes are differences of a
prefix polynomial modulo 2**64, mixed at the end, so the cost per byte does not depend
on the number of words. Buffers are worked through in segments of about one megabyte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEGMENT = 1 << 20
SLICE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _lowered(keep) -> np.ndarray:
    table = np.array([b if keep(b) else 0 for b in range(256)], np.uint8)
    table[65:91] += 32
    return table


# The word classes that the queries name.
WHITESPACE_WORDS = _lowered(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
# NUL is a word byte there, but 0 marks separators; it gets a byte that UTF-8 never uses.
WHITESPACE_WORDS[0] = 0xFF
ALNUM_WORDS = _lowered(lambda b: b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_tables.get("up", ())) < n:
        size = max(n, SEGMENT + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _tables[name] = np.multiply.accumulate(a)
    return _tables["up"], _tables["down"]


class Words:
    """Words of a list of texts: byte range in ``raw``, hash, and the text they are in.

    ``first[i]:first[i + 1]`` are the words of text ``i``; a null text has none.
    """

    def __init__(self, texts: list[bytes | None], table: np.ndarray):
        texts = [t or b"" for t in texts]
        self.raw = b" ".join(texts) + b" "
        buf = np.frombuffer(self.raw, np.uint8)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.text_start = np.concatenate([[0], ends]).astype(np.int64)
        starts, stops, hashes = [], [], []
        pos, n = 0, len(buf)
        while pos < n:
            end = min(pos + SEGMENT, n)
            if end < n:
                end = self._cut(buf, table, pos, end)
            seg = table[buf[pos:end]]
            inside = np.concatenate([[False], seg != 0, [False]])
            edge = np.flatnonzero(inside[1:] != inside[:-1])
            a, b = edge[::2], edge[1::2]
            up, down = _powers(len(seg) + 1)
            prefix = np.zeros(len(seg) + 1, np.uint64)
            np.cumsum(seg.astype(np.uint64) * up[: len(seg)], out=prefix[1:])
            h = (prefix[b] - prefix[a]) * down[a]
            starts.append(a + pos)
            stops.append(b + pos)
            hashes.append(mix(h + (b - a).astype(np.uint64)))
            pos = end
        none = np.zeros(0, np.int64)
        self.start = np.concatenate(starts) if starts else none
        self.stop = np.concatenate(stops) if stops else none
        self.hash = np.concatenate(hashes) if hashes else none.astype(np.uint64)
        self.first = np.searchsorted(self.start, self.text_start)

    @staticmethod
    def _cut(buf: np.ndarray, table: np.ndarray, pos: int, end: int) -> int:
        """A separator near ``end``: the last one before it, else the next one after."""
        back = np.flatnonzero(table[buf[max(pos, end - 4096) : end]] == 0)
        if len(back):
            return max(pos, end - 4096) + int(back[-1]) + 1
        while end < len(buf) and table[buf[end]]:
            step = np.flatnonzero(table[buf[end : end + SEGMENT]] == 0)
            end = end + int(step[0]) if len(step) else min(len(buf), end + SEGMENT)
        return end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one cut stay near ``limit`` bytes (one row at least)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size.astype(np.int64) + 1)
        at = 0
        while at < len(total):
            base = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """An order-dependent hash of every ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = (out ^ values[j : j + n]) * _M1
        out ^= out >> np.uint64(29)
    return mix(out)
