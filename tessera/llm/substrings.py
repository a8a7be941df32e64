"""Substring dedup with difference-cover anchors.

Words are ``[^\\x20\\x09-\\x0D]+``; a window is ``WINDOW`` = 13 consecutive words of one
document. A word is removed if it lies in a window whose word sequence also starts in
a document with a smaller doc_id.

Only windows that can match are compared. {0, 1, 3} is a difference cover modulo 7:
for any two positions there is a shift below 7 that brings both into the cover. So if
two documents share 13 words from positions p and q on, they share the ``ANCHOR`` = 7
words that start at p + s and q + s, both cover positions, for some s in 0..6. Round
one sends the hashes of the 7-word anchors at cover positions (3 of 7) to buckets,
which answer with those that occur in several documents. Every window that holds such
an anchor is extended to its 13 words; round two sends these windows' hashes with the
smallest doc_id of the chunk, and buckets answer with the smallest doc_id of all.
Windows are told apart by 64 bits and, independently, the bits that choose the bucket
and 32 more.

A task holds the texts of one chunk and about 15 bytes for each of their bytes.

Defined results: null and empty texts have no words; a document never removes its own
words, nor do rows of equal doc_id each other's; a null doc_id is larger than any other
and never a source for another null; documents shorter than a window stay whole; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import chunks
from tessera.llm import textbatch as tb
from tessera.llm.simhash import _joined

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1

_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _runs(h: np.ndarray, n: int, odd: np.uint64) -> np.ndarray:
    """A hash of the n words from each word on (meaningless where a document ends)."""
    out = np.zeros(max(len(h) - n + 1, 0), np.uint64)
    for o in range(n):
        out = out * odd + h[o : o + len(out)]
    return tb.mix(out)


class _Chunk:
    """Word hashes of a chunk's documents, and where windows of given lengths fit."""

    def __init__(self, table: pa.Table):
        hashes, counts = [], []
        for batch in table.combine_chunks().to_batches():
            for part in tb.slices(batch):
                w = tb.words(part.column("text"))
                hashes.append(w.hashes())
                counts.append(w.counts)
        self.h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.ids = chunks.ids(table.column("doc_id"))
        self.place = np.arange(len(self.h)) - self.first[self.doc]

    def fits(self, n: int) -> np.ndarray:
        return np.flatnonzero(self.place + n <= self.counts[self.doc])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the cover's anchors."""
        at = self.fits(ANCHOR)
        at = at[np.isin(self.place[at] % PERIOD, COVER)]
        return at, _runs(self.h, ANCHOR, _ODD[0])[at]

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the windows at these positions."""
        return _runs(self.h, WINDOW, _ODD[0])[at], _runs(self.h, WINDOW, _ODD[1])[at]


def _bucket_rows(chunk: int, bucket: np.ndarray, n: int, columns: list[np.ndarray]) -> pa.Table:
    """One row for each bucket with the arrays of its entries. ``bucket``: sorted."""
    edge = np.searchsorted(bucket, np.arange(n + 1))
    own = np.flatnonzero(np.diff(edge))
    arrays = [pa.array(np.full(len(own), chunk), pa.int32()), pa.array(own, pa.int32())]
    arrays += [pa.array([chunks.pack(c[edge[b] : edge[b + 1]]) for b in own], pa.binary()) for c in columns]
    return pa.Table.from_arrays(arrays, names=["chunk", "bucket", *"abc"[: len(columns)]])


def _shared_anchors(docs: DataFrame, n: int) -> DataFrame:
    """(chunk, bucket, a): the chunk's anchors that occur in several documents."""

    def send(table: pa.Table) -> pa.Table:
        c = _Chunk(table)
        at, h = c.anchors()
        owner = c.ids[c.doc[at]]
        order = np.lexsort((owner, h))
        h, owner = h[order], owner[order]
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        last = (np.append(first[1:], len(h)) - 1)[: len(first)]
        several = owner[first] != owner[last]
        # The lowest bit says that the chunk has the anchor in several documents.
        value = (h[first] & ~np.uint64(1)) | several.astype(np.uint64)
        bucket = (value >> np.uint64(1)) % np.uint64(n)
        by = np.argsort(bucket, kind="stable")
        return _bucket_rows(table.column("chunk")[0].as_py(), bucket[by], n, [value[by]])

    def answer(table: pa.Table) -> pa.Table:
        lists = [chunks.unpack(x) for x in table.column("a").to_pylist()]
        every = np.concatenate(lists)
        plain = np.sort(every & ~np.uint64(1))
        met = np.unique(np.concatenate([plain[1:][plain[1:] == plain[:-1]], every[(every & np.uint64(1)) > 0] & ~np.uint64(1)]))
        replies = [chunks.pack(v[chunks.among(met, v)]) for v in (x & ~np.uint64(1) for x in lists)]
        return pa.Table.from_arrays([table.column("chunk"), table.column("bucket"), pa.array(replies, pa.binary())], names=["chunk", "bucket", "a"])

    sent = docs.groupBy("chunk").applyInArrow(send, "chunk int, bucket int, a binary")
    return sent.groupBy("bucket").applyInArrow(answer, "chunk int, bucket int, a binary")


def _all(table: pa.Table, name: str) -> np.ndarray:
    lists = [chunks.unpack(x) for x in table.column(name).to_pylist()]
    return np.concatenate(lists) if lists else np.zeros(0, np.uint64)


def _least_sources(docs: DataFrame, anchors: DataFrame, n: int) -> DataFrame:
    """(chunk, bucket, a, b, c): windows (two hashes) that start in a smaller document
    than any the chunk has them in, and that document."""

    def send(key, own: pa.Table, answers: pa.Table) -> pa.Table:
        c = _Chunk(own)
        at, h = c.anchors()
        hit = np.zeros(len(c.h) + WINDOW, np.int64)
        hit[at[chunks.among(np.sort(_all(answers, "a")), h & ~np.uint64(1))]] = 1
        before = np.concatenate([[0], np.cumsum(hit)])
        at = c.fits(WINDOW)
        at = at[before[at + PERIOD] > before[at]]
        x, y = c.windows(at)
        owner = c.ids[c.doc[at]]
        y = y & np.uint64(0xFFFFFFFF) | (y % np.uint64(n)) << np.uint64(32)
        order = np.lexsort((owner, y, x))
        x, y, owner = x[order], y[order], owner[order]
        if len(x):
            first = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
            x, y, owner = x[first], y[first], owner[first]
        bucket = y >> np.uint64(32)
        by = np.argsort(bucket, kind="stable")
        return _bucket_rows(key[0].as_py(), bucket[by], n, [x[by], y[by], owner[by]])

    def answer(table: pa.Table) -> pa.Table:
        lists = [[chunks.unpack(v) for v in table.column(name).to_pylist()] for name in "abc"]
        x, y, owner = (np.concatenate(v) for v in lists)
        owner = owner.view(np.int64)
        part = np.repeat(np.arange(table.num_rows), [len(v) for v in lists[0]])
        order = np.lexsort((owner, y, x))
        x, y, owner, part = x[order], y[order], owner[order], part[order]
        first = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
        least = owner[np.flatnonzero(first)][np.cumsum(first) - 1]
        told = np.flatnonzero(least < owner)
        told = told[np.argsort(part[told], kind="stable")]
        edge = np.searchsorted(part[told], np.arange(table.num_rows + 1))
        cut = [[chunks.pack(v[told[a:b]]) for a, b in zip(edge, edge[1:])] for v in (x, y, least.view(np.uint64))]
        return pa.Table.from_arrays([table.column("chunk"), table.column("bucket"), *[pa.array(v, pa.binary()) for v in cut]], names=["chunk", "bucket", *"abc"])

    sent = docs.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(send, "chunk int, bucket int, a binary, b binary, c binary")
    return sent.groupBy("bucket").applyInArrow(answer, "chunk int, bucket int, a binary, b binary, c binary")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int | None = None) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256 and
    kept (the words that stay, joined by one space)."""
    total, _ = chunks.sized(docs, text)
    own = chunks.dealt(docs, total, doc_id, text, chunk_bytes)
    words = total / 6
    anchors = _shared_anchors(own, chunks.buckets(words * len(COVER) / PERIOD))
    n = chunks.buckets(words / 2)
    sources = _least_sources(own, anchors, n)

    def finish(key, table: pa.Table, answers: pa.Table) -> pa.Table:
        c = _Chunk(table)
        at = c.fits(WINDOW)
        x, y = c.windows(at)
        y = y & np.uint64(0xFFFFFFFF) | (y % np.uint64(n)) << np.uint64(32)
        owner = c.ids[c.doc[at]]
        told = [_all(answers, name) for name in "abc"]
        xs, ys = np.concatenate([x, told[0]]), np.concatenate([y, told[1]])
        source = np.concatenate([owner, told[2].view(np.int64)])
        order = np.lexsort((source, ys, xs))
        xs, ys = xs[order], ys[order]
        first = np.append(True, (xs[1:] != xs[:-1]) | (ys[1:] != ys[:-1]))[: len(xs)]
        least = np.empty(len(xs), np.int64)
        least[order] = source[order][np.flatnonzero(first)][np.cumsum(first) - 1]
        hit = at[least[: len(at)] < owner]
        cover = np.zeros(len(c.h) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + WINDOW, -1)
        keep = np.cumsum(cover[:-1]) == 0
        removed = np.bincount(c.doc[~keep], minlength=len(c.counts))
        kept = []
        row = 0
        for batch in table.combine_chunks().to_batches():
            for part in tb.slices(batch):
                w = tb.words(part.column("text"))
                joined, starts, ends = _joined(w)
                base = c.first[row]
                for k in range(part.num_rows):
                    a, b = w.first[k], w.first[k + 1]
                    kept.append(chunks.joined_runs(joined, starts[a:b], ends[a:b], keep[base + a : base + b]))
                row += part.num_rows
        return pa.Table.from_arrays([table.column("doc_id"), pa.array(c.counts.astype(np.int64)), pa.array(removed), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array([k.decode() for k in kept], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return own.groupBy("chunk").cogroup(sources.groupBy("chunk")).applyInArrow(finish, schema)
