"""Columnar tokenising of Arrow string columns with numpy.

An Arrow string column is one byte buffer plus offsets, so word boundaries and
word hashes of thousands of documents come out of a few vector operations and
no per-word Python runs.  A word hash is a polynomial over the word's bytes
modulo 2**64, read off a prefix sum, then mixed; equal words always have equal
hashes, and callers that need certainty compare the bytes afterwards.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds the temporaries of one step.
SLICE_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)


#: Bytes hashed at once; bounds the tables of powers that a worker keeps (16 bytes for each).
BLOCK_BYTES = 1 << 20


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand up to a block."""

    def __init__(self):
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            m = max(n, 2 * len(self.up))
            for name, base in (("up", _P), ("down", _P_INV)):
                a = np.full(m, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))
        return self.up, self.down


_POWERS = _Powers()

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Word bytes when words are ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Word bytes when words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = True
ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE_BYTES):
    """Cuts a batch into runs of rows holding about ``most`` bytes of text each."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    buf: np.ndarray  # bytes, case already folded if asked for
    offsets: np.ndarray  # byte offsets of documents
    starts: np.ndarray  # byte offsets of words
    ends: np.ndarray
    doc: np.ndarray  # document (row) of each word
    first: np.ndarray  # first word of each document, plus the total

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends)


class Sums:
    """Prefix sums of a block, off which the hash of any span of it is read."""

    def __init__(self, buf: np.ndarray):
        up, self.down = _POWERS.get(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=self.sums[1:])

    def raw(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.down[starts]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.raw(starts, ends))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each byte span; equal spans have equal hashes. A long buffer is
    hashed block by block, a span longer than half a block in parts of that size."""
    if len(buf) <= BLOCK_BYTES:
        return Sums(buf).hashes(starts, ends)
    half = BLOCK_BYTES // 2
    out = np.zeros(len(starts), np.uint64)
    block = starts // half
    long = ends - starts > half
    block[long] = -1
    order = np.argsort(block, kind="stable")
    edge = np.searchsorted(block[order], np.arange(-(-len(buf) // half) + 1))
    for k in np.flatnonzero(np.diff(edge)):
        own, at = order[edge[k] : edge[k + 1]], int(k) * half
        out[own] = Sums(buf[at : at + BLOCK_BYTES]).raw(starts[own] - at, ends[own] - at)
    step = pow(_P, half, 1 << 64)
    for k in np.flatnonzero(long):
        total, scale = 0, 1
        for at in range(int(starts[k]), int(ends[k]), half):
            part = buf[at : min(at + half, int(ends[k]))]
            total += scale * int(Sums(part).raw(np.array([0]), np.array([len(part)]))[0])
            scale = scale * step % (1 << 64)
        out[k] = total % (1 << 64)
    return mix(out)


def words(column, table: np.ndarray = SPACED, lower: bool = False) -> Words:
    buf, off = flat(column)
    if lower:
        buf = LOWER[buf]
    n = len(buf)
    is_word = table[buf]
    before = np.zeros(n, bool)
    after = np.zeros(n, bool)
    before[1:] = is_word[:-1]
    after[:-1] = is_word[1:]
    inner = off[(off > 0) & (off < n)]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    first = np.searchsorted(starts, off, "left")
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    return Words(buf, off, starts, ends, doc, first)


def blocks(column, table: np.ndarray, span: int, most: int = SLICE_BYTES):
    """(column, words to skip): a single long text in blocks cut between words. A block begins
    ``span`` words before the one before it ends, so every run of ``span`` words lies in one;
    what begins at its first word (the words to skip) was in the block before."""
    if len(column) != 1 or len(flat(column)[0]) <= most:
        yield column, 0
        return
    buf, _ = flat(column)
    begin, skip, end = 0, 0, 0
    while end < len(buf):
        end = max(end + 1, begin + most)
        while end < len(buf):  # to the next byte between words
            ahead = np.flatnonzero(~table[LOWER[buf[end : end + most]]])
            if len(ahead):
                end += int(ahead[0])
                break
            end = min(end + most, len(buf))
        end = min(end, len(buf))
        block = pa.array([buf[begin:end].tobytes()], pa.large_binary())
        starts = words(block, table, lower=True).starts
        if end < len(buf) and len(starts) <= span:
            continue  # a few endless words: the block grows
        yield block, skip
        if len(starts) > span:
            begin, skip = begin + int(starts[-span]), 1


def grams(w: Words, h: np.ndarray, offsets: tuple[int, ...], salt: int, skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the words at ``i + o`` for each o, for every i from ``skip`` on whose last word
    lies in the same document; returns the hashes and their documents."""
    last = offsets[-1]
    if len(h) <= last:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(h) - last
    ok = w.doc[:n] == w.doc[last:]
    ok[:skip] = False
    out = np.full(n, salt, np.uint64)
    for o in offsets:
        out = out * np.uint64(_P) + h[o : o + n]
    return mix(out[ok]), w.doc[:n][ok]
