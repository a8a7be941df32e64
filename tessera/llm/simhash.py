"""SimHash near-duplicates with pigeonring filtering.

Fingerprints: A-Z is lower-cased, words are ``[^\\x20\\x09-\\x0D]+``, shingles are three
consecutive words joined by one space (fewer words: the whole sequence), repeats
included. A bit is 1 if it is set in over half of the shingles' XXH64 values
(UTF-8, seed 42). No word: fingerprint zero. Fingerprints link at ``TAU`` = 2 or
fewer differing bits.

Candidates, over distinct fingerprints only: the 64 bits lie on a ring of eight
8-bit segments. If at most 2 bits differ in all, the pigeonring principle gives a
start from which every chain of ``l`` consecutive segments has at most ``l * 2 / 8``
differing bits: none in the first three, at most one in the first seven. So a chain's three
exact segments are its key, eight for each fingerprint, and fingerprints of one key are joined on
the budget of the longer chain, before the full Hamming distance. A key that over ``CROWDED``
distinct fingerprints share is split by the chain's next segments: of the four after the exact ones at
most one differs, so leaving out each of them in turn gives four keys of six exact segments
(48 bits), of which every link has one. Such a key leaves 16 bits open, so however large
the corpus and however dense a group is, at most 2**16 distinct fingerprints share it, and
it is those that are near copies of each other already. No pair is left out either way.

Components come from alternating large-star and small-star rounds on the links.

A task holds about 15 bytes for each byte of a long text.

Defined results: null text counts as empty; all texts without words share
fingerprint zero; repeated rows (also of one doc_id) get equal results; a null doc_id
takes part in linking, but never is a component id unless all ids in it are null.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import frames
from tessera.llm import textbatch as tb

TAU = 2
SEGMENTS, WIDTH = 8, 8
#: Segments that a chain has exact, and how far it goes with at most one differing bit.
EXACT, REACH = 3, 7
#: Distinct fingerprints of one chain's exact segments that are joined as they are; more are split.
CROWDED = 64
#: Shingles hashed at once; bounds the bits of a long text that are held.
AT_ONCE = 1 << 18


def _joined(w: tb.Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with exactly one space after each, and where each begins and ends."""
    size = w.ends - w.starts
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, np.uint8)
    inner = tb.SPACED[w.buf]
    gap = np.ones(len(out), bool)
    gap[ends] = False
    out[gap] = w.buf[inner]
    return out.tobytes(), starts, ends


def fingerprints(column, shingle: int = 3) -> np.ndarray:
    """One unsigned 64-bit fingerprint for each text of an Arrow column."""
    w = tb.words(column, tb.SPACED, lower=True)
    n_docs = len(w.first) - 1
    text, starts, ends = _joined(w)
    counts = w.counts
    n = np.where(counts == 0, 0, np.maximum(counts - shingle + 1, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(n_docs, np.uint64)
    if not first[-1]:
        return out
    of = xxhash.xxh64_intdigest
    some = np.flatnonzero(n)
    ones = np.zeros((n_docs, 64), np.int64)
    for begin in range(0, int(first[-1]), AT_ONCE):
        place = np.arange(begin, min(begin + AT_ONCE, int(first[-1])))
        doc = np.searchsorted(first, place, "right") - 1
        lead = place - first[doc] + w.first[doc]
        last = np.minimum(lead + shingle, w.first[doc + 1]) - 1
        h = np.fromiter((of(text[s:e], 42) for s, e in zip(starts[lead].tolist(), ends[last].tolist())), np.uint64, len(lead))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edge = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        ones[doc[edge]] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    major = (2 * ones[some] > n[some][:, None]).astype(np.uint8)
    out[some] = np.packbits(major, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprinted(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint as a (signed) long of the same 64 bits."""

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(fingerprints(part.column(text)).view(np.int64))]

    return frames.append(docs, [T.StructField(name, T.LongType())], compute, text)


def _mask(start: int, segments: Iterable[int]) -> Column:
    """Ones in the ring's segments that are so far after ``start``, as a signed long."""
    x = sum(((1 << WIDTH) - 1) << ((start + k) % SEGMENTS * WIDTH) for k in segments)
    return F.lit(x - (1 << 64) if x >> 63 else x)


def _of_start(masks: list[Column]) -> Column:
    return F.get(F.array(*masks), F.col("start"))


def _shared(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows whose key another fingerprint has too, with their number ``n``. Counts are merged before the shuffle."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")
    return frames.stored(rows.join(counts, by))


def _pairs(rows: DataFrame, by: list[str]) -> DataFrame:
    """Pairs (a, b), a > b, of one key whose chain keeps its budget: the mask of its segments rides along."""
    x, y = rows.alias("x"), rows.alias("y")
    on = reduce(Column.__and__, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in by])
    differ = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    chain = F.bit_count(differ.bitwiseAND(F.col("x.reach"))) <= REACH * TAU // SEGMENTS
    return x.join(y, on & (F.col("x.fp") > F.col("y.fp")) & chain).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def candidates(distinct: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Pairs (a, b), a > b, perhaps repeated, with a chain within its budgets; all links are among them.
    ``distinct``: one row for each fingerprint ``fp``, already materialised."""
    exact = F.array(*[_mask(s, range(EXACT)) for s in range(SEGMENTS)])
    reach = [_mask(s, range(REACH)) for s in range(SEGMENTS)]
    chains = distinct.select("fp", F.posexplode(exact).alias("start", "mask")).select("fp", "start", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    held = _shared(chains, ["start", "key"]).withColumn("reach", _of_start(reach))
    few = _pairs(held.filter(F.col("n") <= crowded), ["start", "key"])
    without = [F.array(*[_mask(s, [k for k in range(REACH) if k != out]) for out in range(EXACT, REACH)]) for s in range(SEGMENTS)]
    split = held.filter(F.col("n") > crowded).select("fp", "start", "reach", F.posexplode(_of_start(without)).alias("out", "mask"))
    split = _shared(split.select("fp", "start", "reach", "out", F.col("fp").bitwiseAND(F.col("mask")).alias("key")), ["start", "out", "key"])
    return few.unionByName(_pairs(split, ["start", "out", "key"]))


def links(distinct: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b), a > b, that connect just what is within TAU bits."""
    return candidates(distinct, crowded).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= TAU).distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge list (a, b): root is the smallest
    node it is connected to. Rounds double the reach, so few are needed."""
    at = frames.stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    for _ in range(most_rounds):
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: every larger neighbour of a moves to the smallest node around a.
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        # Small star: a and its smaller neighbours move to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").union(least.select("a", F.col("m").alias("b"))).distinct()
        after = frames.stored(small)
        # Done when the forest is flat: no node is both a child and a root, and no child has two.
        deep = after.select("a").intersect(after.select("b")).limit(1).count()
        wide = after.groupBy("a").count().filter("count > 1").limit(1).count()
        at = after
        if not deep and not wide:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = at.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return at.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits) and
    component_id (the smallest doc_id reachable over links)."""
    prints = frames.stored(fingerprinted(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"))
    distinct = frames.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp")))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of their component. An id stays
    with all its rows if it stays for one; rows without an id stay."""
    own = F.col("doc_id") == F.col("component_id")
    ids = near_duplicates(docs, doc_id, text).filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or(own).alias("stays"))
    gone = ids.filter(~F.col("stays")).select(F.col("doc_id").alias("_id"))
    return docs.join(gone, docs[doc_id] == gone["_id"], "left_anti")
