"""Line dedup that can be taken back: sharded cuckoo filters over exact reference counts.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased.
A key of at least ``LEAST`` code points that at least two documents hold loses its lines in all
of them but the smallest doc_id; other lines stay.

An index of the documents inserted so far has three tables:

* ``references``: one row for each key (a 128-bit digest) of each document. It is what
  deletion goes back to, and is only read for keys that the filters name.
* ``filters``: for each shard of keys, a cuckoo filter with one fingerprint for each distinct
  key. Keys that are inserted come as sorted lists, which tasks have freed of repetitions, so a
  key that a third of all documents hold is a few entries. A key that its shard's filter
  holds already, be it from this list, another list or an earlier insertion, is held again.
  Keys held once, by far the most, go no further than their filter.
* ``counts``: for each key held again, the exact number of references and the smallest and
  largest doc_id, by an aggregation with partial results. What a filter took for known by a
  collision of fingerprints is found to be held once here.

Deleting documents takes their references away, counts what is left of the keys they held,
and deletes fingerprints of keys that nobody holds any more; lines that were dropped
for their sake stay from then on. A shard's task holds one filter, which grows by further
tables until it is rebuilt, and the lists sent to it.

Defined results: null and empty texts are one empty line; documents are told apart by doc_id, so rows
that repeat one lose nothing to each other; rows without doc_id count together as one document
beyond all others, which ``delete`` doesn't reach; inserting a document again adds
nothing to what it holds; deleting an unknown one does nothing; an empty table gives none; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chunks, frames
from tessera.llm import textbatch as tb

LEAST = 10

_BLANK = b" \t\n\x0b\x0c\r"
_LOWER = bytes(tb.LOWER)

#: Keys that a task gathers before it sends them, without repetitions, to the shards.
GATHER = 1 << 18

REFERENCES = "hi long, lo long, doc_id long"
FILTERS = "shard int, filter binary"
COUNTS = "hi long, lo long, n long, least long, most long"


class Cuckoo:
    """A cuckoo filter of 64-bit hashes: buckets of four 16-bit fingerprints, two buckets a hash,
    inserted and deleted many at a time. A table that is full is followed by another of its
    size: two hashes that look alike to one table must do so to all, else deleting one could take the other's
    fingerprint."""

    SLOTS, FILL, KICKS = 4, 0.8, 64

    def __init__(self, tables: list[np.ndarray] | None = None):
        self.tables = tables or []

    @classmethod
    def read(cls, data: bytes) -> "Cuckoo":
        tables, at = [], 0
        while at < len(data):
            n = int.from_bytes(data[at : at + 8], "little")
            tables.append(np.frombuffer(data, np.uint16, n * cls.SLOTS, at + 8).reshape(n, cls.SLOTS).copy())
            at += 8 + 2 * n * cls.SLOTS
        return cls(tables)

    def write(self) -> bytes:
        return b"".join(len(t).to_bytes(8, "little") + t.tobytes() for t in self.tables)

    @staticmethod
    def _prints(h: np.ndarray) -> np.ndarray:
        """Fingerprints, never 0, which stands for a free slot."""
        return (tb.mix(h) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)

    @staticmethod
    def _other(bucket: np.ndarray, prints: np.ndarray, n: int) -> np.ndarray:
        """The second bucket of a fingerprint, from either of them. n: a power of two."""
        return bucket ^ (tb.mix(prints.astype(np.uint64)) & np.uint64(n - 1)).astype(np.int64)

    def _places(self, table: np.ndarray, h: np.ndarray):
        prints = self._prints(h)
        first = (tb.mix(h ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(len(table) - 1)).astype(np.int64)
        return prints, first, self._other(first, prints, len(table))

    def holds(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), bool)
        for table in self.tables:
            prints, a, b = self._places(table, h)
            out |= (table[a] == prints[:, None]).any(1) | (table[b] == prints[:, None]).any(1)
        return out

    def _grow(self, n: int) -> None:
        size = len(self.tables[0]) if self.tables else 1 << (max(int(n / self.FILL / self.SLOTS), 16) - 1).bit_length()
        self.tables.append(np.zeros((size, self.SLOTS), np.uint16))

    def reserve(self, n: int) -> None:
        """Makes an empty filter's table large enough for n."""
        if not self.tables:
            self._grow(n)

    def insert(self, h: np.ndarray) -> None:
        """Distinct hashes, each with a fingerprint of its own even if another has the same."""
        while len(h):
            if self.tables:
                h = self._into(self.tables[-1], h)
            if len(h):
                self._grow(len(h))

    def _into(self, table: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Fills the table as far as it can; returns the hashes for the next one. Fingerprints are
        moved only while none is lost: one that finds no place ends where its chain began."""
        free = int(self.FILL * table.size) - int(np.count_nonzero(table))
        later, h = h[max(free, 0) :], h[: max(free, 0)]
        prints, a, b = self._places(table, h)
        left = np.arange(len(h))
        for bucket in (a, b):
            left = left[~self._settle(table, bucket[left], prints[left])]
        unplaced = [k for k in left.tolist() if not self._kick(table, int(a[k]), prints[k])]
        return np.concatenate([h[unplaced], later])

    def _settle(self, table: np.ndarray, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """Into free slots of these buckets; returns which were settled."""
        done = np.zeros(len(bucket), bool)
        order = np.argsort(bucket, kind="stable")
        own, first, size = np.unique(bucket[order], return_index=True, return_counts=True)
        place = np.arange(len(order)) - np.repeat(first, size)  # among those of its bucket
        free = table[bucket[order]] == 0
        rank = np.cumsum(free, 1) - 1
        fits = free.sum(1) > place
        slot = np.argmax(free & (rank == place[:, None]), 1)
        table[bucket[order][fits], slot[fits]] = prints[order][fits]
        done[order[fits]] = True
        return done

    def _kick(self, table: np.ndarray, bucket: int, value: np.uint16) -> bool:
        undo = []
        for k in range(self.KICKS):
            row = table[bucket]
            slot = np.flatnonzero(row == 0)
            if len(slot):
                row[slot[0]] = value
                return True
            at = (k * 7 + int(value)) % self.SLOTS
            undo.append((bucket, at, row[at]))
            row[at], value = value, row[at]
            bucket = int(self._other(np.array([bucket]), np.array([value], np.uint16), len(table))[0])
        for bucket, at, old in reversed(undo):
            table[bucket, at] = old
        return False

    def delete(self, h: np.ndarray) -> None:
        """Distinct hashes that were inserted."""
        for table in self.tables:
            prints, a, b = self._places(table, h)
            left = np.ones(len(h), bool)
            for k in range(len(h)):
                for bucket in (a[k], b[k]):
                    slot = np.flatnonzero(table[bucket] == prints[k])
                    if left[k] and len(slot):
                        table[bucket, slot[0]] = 0
                        left[k] = False
            h = h[left]


@dataclass(frozen=True)
class Index:
    references: DataFrame
    filters: DataFrame
    counts: DataFrame
    shards: int

    def save(self, path: str) -> None:
        for name in ("references", "filters", "counts"):
            getattr(self, name).write.parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, shards: int) -> "Index":
        """``shards``: as when the index was made."""
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("references", "filters", "counts")), shards)


def empty(spark: SparkSession, shards: int) -> Index:
    return Index(*(spark.createDataFrame([], schema) for schema in (REFERENCES, FILTERS, COUNTS)), shards)


def keys(text: bytes, least: int = LEAST) -> list[bytes | None]:
    """The digest of each line's key; None for a line that always stays."""
    out: list[bytes | None] = []
    for line in text.translate(_LOWER).split(b"\n"):
        key = line.strip(_BLANK)
        long = len(key) >= 4 * least or len(key) >= least and len(key.decode("utf-8", "surrogatepass")) >= least
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def _bytes(value: pa.Scalar) -> bytes:
    return (value.as_py() or "").encode("utf-8", "surrogatepass")


def references(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(hi, lo, doc_id) for each distinct key of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch):
                found = [(k, n) for n, value in enumerate(part.column("text")) for k in {*keys(_bytes(value), least)} if k]
                halves = np.frombuffer(b"".join(k for k, _ in found), ">i8").astype(np.int64).reshape(-1, 2)
                owner = chunks.ids(part.column("doc_id"))[[n for _, n in found]] if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(owner)], names=["hi", "lo", "doc_id"])

    frames.small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, REFERENCES)


def _lists(refs: DataFrame, shards: int) -> DataFrame:
    """(shard, once, several): keys of a task's rows, by shard, without repetitions: those of one
    document, and those of several."""

    def send(once: list, owners: list) -> Iterator[pa.RecordBatch]:
        hi, owner = np.concatenate(once), np.concatenate(owners)
        shard = hi % shards
        order = np.lexsort((owner, hi.view(np.uint64), shard))
        hi, owner, shard = hi[order], owner[order], shard[order]
        first = np.flatnonzero(np.append(True, hi[1:] != hi[:-1]))
        last = np.append(first[1:], len(hi)) - 1
        several = owner[first] != owner[last]
        hi, shard = hi[first], shard[first]
        for s in np.unique(shard):
            own = shard == s
            yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), *(pa.array([chunks.pack(hi[own & which])], pa.binary()) for which in (~several, several))], names=["shard", "once", "several"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        his, owners, n = [], [], 0
        for batch in batches:
            his.append(batch.column("hi").to_numpy())
            owners.append(batch.column("doc_id").to_numpy())
            n += batch.num_rows
            if n >= GATHER:
                yield from send(his, owners)
                his, owners, n = [], [], 0
        if n:
            yield from send(his, owners)

    return refs.select("hi", "doc_id").mapInArrow(run, "shard int, once binary, several binary")


def _inserted(lists: DataFrame, filters: DataFrame) -> DataFrame:
    """(shard, filter, again, unsure): each shard's filter with the lists inserted, and the keys that
    it held already when they came. Those of them that it held when they came first have no fingerprint of
    their own unless they were inserted earlier: where nothing was, they get one at once; else they are unsure."""

    def run(key, sent: pa.Table, known: pa.Table) -> pa.Table:
        cuckoo = Cuckoo.read(known.column("filter")[0].as_py()) if known.num_rows else Cuckoo()
        prior = bool(cuckoo.tables)
        lists = [(chunks.unpack(row[name]), name == "several") for row in sent.select(["once", "several"]).to_pylist() for name in ("once", "several")]
        cuckoo.reserve(sum(len(h) for h, _ in lists))
        again, early = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for h, several in lists:
            held = cuckoo.holds(h)
            cuckoo.insert(h[~held])
            again.append(h if several else h[held])
            early.append(h[held])
        # Of the keys held when they came, those that no list before had brought.
        unsure = np.unique(np.concatenate(early))
        came = np.zeros(len(unsure), bool)
        first = np.zeros(len(unsure), bool)
        for (h, _), met in zip(lists, early[1:]):
            own = np.searchsorted(unsure, met)
            first[own[~came[own]]] = True
            came[np.searchsorted(unsure, h[chunks.among(unsure, h)])] = True
        unsure = unsure[first]
        if not prior:
            cuckoo.insert(unsure)
            unsure = unsure[:0]
        arrays = [pa.array([np.unique(x).view(np.int64)], pa.list_(pa.int64())) for x in (np.concatenate(again), unsure)]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([cuckoo.write()], pa.binary()), *arrays], names=["shard", "filter", "again", "unsure"])

    return lists.groupBy("shard").cogroup(filters.groupBy("shard")).applyInArrow(run, f"{FILTERS}, again array<long>, unsure array<long>")


def _changed(filters: DataFrame, hashes: DataFrame, shards: int, change: str) -> DataFrame:
    """The filters with these keys inserted or deleted."""

    def run(key, known: pa.Table, own: pa.Table) -> pa.Table:
        cuckoo = Cuckoo.read(known.column("filter")[0].as_py()) if known.num_rows else Cuckoo()
        getattr(cuckoo, change)(np.sort(own.column("hi").to_numpy().view(np.uint64)))
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([cuckoo.write()], pa.binary())], names=["shard", "filter"])

    dealt = hashes.withColumn("shard", F.pmod("hi", F.lit(shards)).cast("int"))
    return filters.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(run, FILTERS)


def _counted(refs: DataFrame) -> DataFrame:
    """Exact counts of references; a document that was inserted twice counts once for what it decides."""
    return refs.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))


def insert(index: Index, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> Index:
    new = frames.stored(references(docs, doc_id, text, least))
    made = frames.stored(_inserted(_lists(new, index.shards), index.filters))
    again = made.select(F.explode("again").alias("hi"))
    every = index.references.unionByName(new)
    counts = _counted(every.join(again, "hi", "left_semi")).unionByName(index.counts.join(again, "hi", "left_anti"))
    filters = index.filters.join(made, "shard", "left_anti").unionByName(made.select("shard", "filter"))
    unsure = frames.stored(made.select(F.explode("unsure").alias("hi")).join(index.references, "hi", "left_anti"))
    if not unsure.isEmpty():
        filters = frames.stored(_changed(filters, unsure, index.shards, "insert"))
    return replace(index, references=every, filters=filters, counts=frames.stored(counts))


def rebuilt(index: Index, shards: int) -> Index:
    """The index with filters made anew from its references: one table each, in as many shards as are
    wanted now. For an index that has outgrown the shards it began with."""
    made = _inserted(_lists(index.references, shards), index.filters.limit(0))
    return replace(index, filters=frames.stored(made.select("shard", "filter")), shards=shards)


def delete(index: Index, doc_ids: DataFrame) -> Index:
    """Without the documents of these ids (the first column)."""
    gone = doc_ids.select(F.col(f"`{doc_ids.columns[0]}`").cast("long").alias("doc_id")).distinct()
    left = frames.stored(index.references.join(gone, "doc_id", "left_anti").select("hi", "lo", "doc_id"))
    held = frames.stored(index.references.join(gone, "doc_id", "left_semi").select("hi").distinct())
    still = left.join(held, "hi", "left_semi")
    lost = held.join(still.select("hi").distinct(), "hi", "left_anti")
    filters = _changed(index.filters, lost, index.shards, "delete")
    # Only keys that were held again have counts.
    counts = _counted(still.join(index.counts, "hi", "left_semi")).unionByName(index.counts.join(held, "hi", "left_anti"))
    return Index(left, frames.stored(filters), frames.stored(counts), index.shards)


def drops(index: Index) -> DataFrame:
    """(doc_id, hi, lo): keys whose lines a document loses."""
    shared = index.counts.filter("least < most").select("hi", "lo", "least")
    return index.references.join(shared, ["hi", "lo"]).filter("doc_id > least").select("doc_id", "hi", "lo")


def apply(index: Index, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, kept) for each row of ``docs``, whose documents
    are in the index."""
    lost = drops(index).groupBy(F.col("doc_id").alias("_own")).agg(F.collect_set(F.struct("hi", "lo")).alias("lost"))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    own = own.withColumn("_own", F.coalesce("doc_id", F.lit(chunks.NO_ID)))
    # A hash join, as sorting would move whole texts about once more.
    both = own.join(lost.hint("shuffle_hash"), "_own", "left").select("doc_id", "text", F.col("lost.hi").alias("hi"), F.col("lost.lo").alias("lo"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch):
                rows = []
                for value, hi, lo in zip(part.column("text"), part.column("hi"), part.column("lo")):
                    text = _bytes(value)
                    lines, kept = text.count(b"\n") + 1, text
                    n = lines
                    if hi.is_valid:
                        halves = np.array([hi.as_py(), lo.as_py()], np.int64).T.astype(">i8").tobytes()
                        gone = {halves[k : k + 16] for k in range(0, len(halves), 16)}
                        stay = [line for line, k in zip(text.split(b"\n"), keys(text, least)) if k not in gone]
                        n, kept = len(stay), b"\n".join(stay)
                    rows.append((lines, lines - n, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass")))
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string())))], names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"])

    return both.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept string")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """All documents inserted into an empty index, and what stays of them."""
    total, _ = chunks.sized(docs, text)
    index = insert(empty(docs.sparkSession, chunks.buckets(total / 32)), docs, doc_id, text, least)
    return apply(index, docs, doc_id, text, least)
