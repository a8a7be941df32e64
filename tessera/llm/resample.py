"""Importance resampling of documents towards the word distribution of a target.

A document's words are runs of digits, a-z and characters beyond ASCII after A-Z are
lower-cased. Both happen in UTF-8 with one table of 256 bytes that lower-cases letters and
turns every other ASCII byte into a blank, so ``bytes.split`` gives the words. Features are all
runs of 1 to ``ngrams`` words; a run's bucket is the crc32 of the words joined by blanks,
which the next word's crc32 continues from the seed of the run before it. Counters reduce words
to their distinct ones before anything is hashed, tasks reduce buckets to one row each, and
Spark sums those.

A bucket's gain is the floored log ratio (thousandths) of its smoothed shares in the target
and in the documents; a document's weight is the floored mean gain of its features. Its score
adds Gumbel noise that its id alone decides, so the highest scores are a draw without
replacement by weight. Scores are integers within a range that the size of a corpus barely
moves: counts for each score give the least score drawn, and only rows from there on are sorted.

A task holds one document's words and at most ``MEMO`` known words; what is collected is one
number for each bucket, and one for each distinct score.

Defined results: null and empty texts have no features, weigh 0 and are never drawn where
``least_words`` is positive; a null doc_id counts as an empty one and comes last of ties; rows
that repeat a doc_id are rows of their own with equal noise, and one of them may be drawn
alone; without documents nothing is drawn; with an empty target all gains follow from the
smoothing; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import frames
from tessera.operators import ordering

#: Lower-cases A-Z and blanks every ASCII byte that is neither letter nor digit.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: Distinct runs whose bucket a task remembers.
MEMO = 1 << 18


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(TABLE).split()


class Buckets:
    """Buckets of a document's features, with multiplicity; each distinct run is hashed once."""

    def __init__(self, ngrams: int, buckets: int):
        self.ngrams, self.buckets = ngrams, buckets
        self.known: dict[tuple[bytes, ...], int] = {}

    def _crc(self, run: tuple[bytes, ...]) -> int:
        """Of the run joined by blanks: each word continues from the crc of those before it."""
        return reduce(lambda seed, word: zlib.crc32(word, zlib.crc32(b" ", seed)), run[1:], zlib.crc32(run[0]))

    def of(self, w: list[bytes]) -> Counter:
        found: Counter = Counter()
        if len(self.known) > MEMO:
            self.known.clear()
        for n in range(1, self.ngrams + 1):
            for run, times in Counter(zip(*(w[k:] for k in range(n)))).items():
                at = self.known.get(run)
                if at is None:
                    at = self.known[run] = self._crc(run) % self.buckets
                found[at] += times
        return found


def totals(docs: DataFrame, text: str = "text", ngrams: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of the whole table fall in each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucketed, sums = Buckets(ngrams, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for value in batch.column(0):
                for at, n in bucketed.of(words(value.as_py())).items():
                    sums[at] += n
        own = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(sums[own])], names=["bucket", "n"])

    frames.small_batches(docs.sparkSession)
    out = np.zeros(buckets, np.int64)
    for row in docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(target: np.ndarray, corpus: np.ndarray) -> list[int]:
    t, s, n = float(target.sum()), float(corpus.sum()), float(len(target))
    return [math.floor(1000 * math.log((a + 1.0) * (s + n) / ((b + 1.0) * (t + n)))) for a, b in zip(target.tolist(), corpus.tolist())]


def noise(doc_id: str | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id or ''}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], doc_id: str = "doc_id", text: str = "text", ngrams: int = 1, seed: int = 2024) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) for each row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucketed = Buckets(ngrams, len(gain))
        for batch in batches:
            rows = []
            for key, value in zip(batch.column("key").to_pylist(), batch.column("text")):
                w = words(value.as_py())
                found = bucketed.of(w)
                n = found.total()
                weight = sum(gain[at] * times for at, times in found.items()) // n if n else 0
                rows.append((len(w), n, weight, weight + noise(key, seed)))
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "n_words", "n_features", "weight", "score"])

    frames.small_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_id).cast("string").alias("key"), F.col(text).alias("text"))
    return own.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", ngrams: int = 1, buckets: int = 10_000, least_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row; rank is null where the row isn't
    drawn."""
    gain = gains(totals(target, text, ngrams, buckets), totals(docs, text, ngrams, buckets))
    rows = frames.stored(scored(docs, gain, doc_id, text, ngrams, seed))
    able = rows.filter(F.col("n_words") >= least_words)
    counts = sorted(((r.score, r.n) for r in able.groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draw = percent * sum(n for _, n in counts) // 100
    least, above = None, 0
    for value, n in counts:
        if above >= draw:
            break
        least, above = value, above + n
    columns = ["doc_id", "n_features", "weight", "score"]
    if least is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    chosen = (F.col("n_words") >= least_words) & (F.col("score") >= least)
    placed = ordering.ordinal(rows.filter(chosen), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), name="_rank")
    rank = F.when(F.col("_rank") < draw, F.col("_rank") + 1).cast("long").alias("rank")
    return placed.select(*columns, rank).unionByName(rows.filter(~chosen).select(*columns, F.lit(None).cast("long").alias("rank")))
