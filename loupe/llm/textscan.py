"""Vectorised scanning of text batches: words, lines and 64-bit hashes.

Spark hands every task Arrow batches; these helpers turn a batch's UTF-8 bytes
into numpy arrays of word (or line) spans and hashes.  A short span's hash mixes its
bytes eight at a time, for all spans at once; a long span gets a BLAKE2b digest, so no
family of texts collides by construction.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text scanned at once; a longer document is scanned alone, whole.
CHUNK_BYTES = 1 << 20
#: The same where many numbers are held for each word.
SMALL_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of words `[^\x20\x09-\x0D]+`.
NONSPACE = ~_SPACE
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (of lower-cased text).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

#: Spans up to so many bytes are hashed eight bytes at a time by mixing, longer ones by BLAKE2b.
SHORT = 32
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])


class Scan:
    """One chunk of texts: ``data`` holds their bytes, text i is data[bounds[i]:bounds[i+1]]."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds = data, bounds
        self.n = len(bounds) - 1
        self._eights: np.ndarray | None = None

    def lowered(self) -> Scan:
        return Scan(LOWER[self.data], self.bounds)

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def spans(self, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of the maximal runs of bytes in the class ``of``; none crosses texts."""
        inside = of[self.data]
        if not len(inside):
            none = np.zeros(0, np.int64)
            return none, none, none
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        cuts = self.bounds[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(inside))]
        before[cuts] = False
        after[cuts - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, self.text_of(starts)

    def text_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, positions, "right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and text numbers of all lines, empty ones included; an empty text has one empty line."""
        breaks = np.flatnonzero(self.data == 0x0A)
        starts = np.concatenate([self.bounds[:-1], breaks + 1])
        owner = np.concatenate([np.arange(self.n), self.text_of(breaks)])
        order = np.lexsort((starts, owner))
        starts, owner = starts[order], owner[order]
        ends = np.empty_like(starts)
        if len(starts):
            ends[:-1] = starts[1:] - 1
            last = np.append(owner[1:] != owner[:-1], True)
            ends[last] = self.bounds[1:][owner[last]]
        return starts, ends, owner

    def hashes(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        """A 64-bit hash of each span's bytes and length; a span's path depends on its length only."""
        if self._eights is None:  # the eight bytes from each place on, zeros after the end
            padded = np.zeros(len(self.data) + 8, np.uint8)
            padded[: len(self.data)] = self.data
            self._eights = np.ndarray(len(self.data) + 1, "<u8", padded.data, strides=(1,))
        sizes = ends - starts
        out = mix(sizes.astype(np.uint64) + _SEEDS[which])
        open_, offset = np.flatnonzero(sizes <= SHORT), 0
        while len(open_):
            left = np.minimum(sizes[open_] - offset, 8)
            out[open_] = mix(out[open_] ^ (self._eights[starts[open_] + offset] & _MASKS[left]))
            offset += 8
            open_ = open_[sizes[open_] > offset]
        long = np.flatnonzero(sizes > SHORT)
        if len(long):
            view, salt = memoryview(np.ascontiguousarray(self.data)), bytes([which])
            digests = [hashlib.blake2b(view[a:b], digest_size=8, salt=salt).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
            out[long] = np.frombuffer(b"".join(digests), "<u8")
        return out

    def count_in(self, of: np.ndarray) -> np.ndarray:
        """Bytes of the class ``of`` in each text."""
        total = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(of[self.data], out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def scans(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES):
    """Yields (first row, row after the last, Scan) over a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    blob = column.buffers()[2]
    data = np.frombuffer(blob, np.uint8) if blob is not None and blob.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, Scan(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def windows(hashes: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` items inside one text, and each run's first item."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[k : k + n]
    first = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return mix(total[first]), first


def keyed(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts, for one sort over a whole chunk."""
    return mix(hashes ^ mix(owner.astype(np.uint64) + np.uint64(0x51ED27)))


def word_hashes(text: str) -> list[int]:
    """Hashes of a constant's words, equal to those of scanned words."""
    data = np.frombuffer(text.encode(), np.uint8)
    scan = Scan(data, np.array([0, len(data)]))
    s, e, _ = scan.spans(NONSPACE)
    return [int(x) for x in scan.hashes(s, e)]
