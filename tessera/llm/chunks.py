"""Documents dealt into chunks of bounded size, and number lists sent between them.

Operators that compare all documents with all others here work in rounds: each chunk
sends sorted lists of hashes to buckets (one row for each chunk and bucket, holding a
compressed array), each bucket compares the lists it has got and answers each chunk,
and the chunk joins the answers with its documents.  A chunk sends a hash once however
often it holds it, so a bucket gets at most one entry of a hot key from each chunk.
Spark deals both sides: chunks by a hash of the document id, buckets by bits of the
hash.
"""

from __future__ import annotations

import math

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Text in a chunk, on average, at least and at most. A document is never split over chunks.
CHUNK_BYTES, MOST_CHUNK_BYTES = 4 << 20, 64 << 20

#: doc_id of rows without one: no document is smaller than they are large.
NO_ID = np.iinfo(np.int64).max


def sized(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Bytes of text and number of rows."""
    got = docs.agg(F.sum(F.octet_length(text)).alias("b"), F.count("*").alias("n")).first()
    return int(got["b"] or 0), int(got["n"])


def chunk_size(total: int) -> int:
    """Grows with the square root of the corpus, and buckets do too: else the lists between
    them would shrink to a hash each. A task's memory is the limit."""
    return min(max(CHUNK_BYTES, math.isqrt(total << 14)), MOST_CHUNK_BYTES)


def dealt(docs: DataFrame, total: int, doc_id: str = "doc_id", text: str = "text", chunk_bytes: int | None = None) -> DataFrame:
    """(chunk, doc_id, text): rows of one doc_id and text share a chunk. A null id is
    dealt by its text."""
    n = max(1, math.ceil(total / (chunk_bytes or chunk_size(total))))
    key = F.xxhash64(F.lit("chunk"), F.coalesce(F.col(doc_id).cast("string"), F.col(text)))
    return docs.select(F.pmod(key, F.lit(n)).cast("int").alias("chunk"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def buckets(entries: float) -> int:
    """How many buckets hold one million to four million entries each, the more the more
    entries there are."""
    return max(1, math.ceil(entries / min(max(1 << 20, 4 * math.sqrt(entries)), 1 << 22)))


def pack(a: np.ndarray) -> bytes:
    """An array of 64-bit integers, best sorted: differences, bytes of one weight
    together, compressed."""
    a = a.view(np.uint64)
    d = a.copy()
    d[1:] -= a[:-1]
    return zstandard.compress(d.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64), dtype=np.uint64)


def among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def ids(column) -> np.ndarray:
    """A column of ids as int64, null as NO_ID."""
    return column.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


def joined_runs(text: bytes, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> bytes:
    """The kept spans joined by one byte of what separates them in ``text``, where
    every two spans have exactly one byte between them."""
    if keep.all():
        return text[starts[0] : ends[-1]] if len(starts) else b""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], keep.view(np.int8), [0]])))
    return b" ".join(text[starts[a] : ends[b - 1]] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()))
