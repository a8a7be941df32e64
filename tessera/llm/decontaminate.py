"""Benchmark decontamination by latent semantic retrieval.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lower-cased text. A document's passages are its
spans of 64 words, one every 32 words. The terms are the benchmark's words; passages
are rows of a TF-IDF matrix over them (a term counts once in a passage; its weight
falls to zero where over ``max_df`` of all passages hold it; but the eight rarest terms of
each window always keep theirs, so an item that leaks into a large part of the corpus is
found too). An item is searched by its windows: the whole of it, or, if it has over 64
words, its spans of 64 words, one every 32 words and one at its end.

1. One pass counts every term's passage frequency over the whole corpus.
2. One pass takes the randomised SVD: with a fixed Gaussian test matrix W each task sums
   A'(A W) over its passages; the sums are added up, and the Nystrom form of A'A gives
   the leading right singular vectors, as many as there are windows and 16 more, but at
   most ``rank``.
3. One pass projects windows, and passages with two terms of weight or more (one, if a
   window has fewer than four terms), on these and takes as candidates all pairs with a
   cosine of ``least_cosine`` or more where the passage reaches ``least_share`` of the
   window's own length along the window. For each candidate the words around the passage
   are compared with the whole item: the longest common subsequence must cover ``least_lcs``
   of the item's words, and ``least_answer`` of its answer, i.e. its five rarest terms, must stand there; or
   else that share of the five rarest of each of its windows, and of an item of one window
   of all its terms weighted by their rarity (a reworded leak may lack just the rarest). So reworded passages are found as well as verbatim ones. The cosine
   reported is that of the window nearest to the passage.

Windows are handled in blocks of about ``block`` windows, several blocks to a group, as many as
have ``most_bytes`` of vectors together; the windows of a longer item lie in several blocks.
So what is broadcast or sent to the driver at once is bounded whatever the size of corpus and
benchmark; step 1 is one pass for all groups, steps 2 and 3 are one for each, and no texts are written
anew: what several groups find meets by the digests of the few texts with leaks. The benchmark is a stated query set against
all passages. A task holds about 30 bytes for each byte of a long text.

Defined results: null and empty texts and items without words match nothing; repeated
documents get equal results, repeated items a result each; a null item_id is reported
as null; an empty benchmark or corpus gives no matches; a column named like the output
is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import frames
from tessera.llm import textbatch as tb

STRIDE = 32
ANSWER = 5
OWN = 8


@dataclass(frozen=True)
class Rules:
    max_df: float = 0.002
    rank: int = 256
    least_cosine: float = 0.35
    least_share: float = 0.3
    least_lcs: float = 0.6
    least_answer: float = 0.6
    block: int = 240
    most_bytes: int = 64 << 20


@dataclass(frozen=True)
class Item:
    number: int  # of the benchmark's row
    item_id: object
    text: str | None
    windows: tuple[tuple[int, int], ...]  # first word, end; those to search in a block


def _windows(n: int) -> tuple[tuple[int, int], ...]:
    """The spans by which an item of ``n`` words is searched."""
    if n <= 2 * STRIDE:
        return ((0, n),)
    return tuple((a, a + 2 * STRIDE) for a in (*range(0, n - 2 * STRIDE, STRIDE), n - 2 * STRIDE))


def _blocks(rows: list, rules: Rules) -> list[list[Item]]:
    """The benchmark's rows (i, t, h: their hash) dealt by hash into blocks of about ``block``
    windows, none of more than ``block`` and ``rank``."""
    w = tb.words(pc.utf8_lower(pa.array([r["t"] for r in rows], pa.string())), tb.ALNUM)
    items = [Item(k, r["i"], r["t"], _windows(int(n))) for k, (r, n) in enumerate(zip(rows, w.counts))]
    n_blocks = max(1, -(-sum(len(x.windows) for x in items) // rules.block))
    most = max(rules.block, rules.rank)
    dealt: dict[int, list[Item]] = {}
    for x in items:
        dealt.setdefault(rows[x.number]["h"] % n_blocks, []).append(x)
    out = []
    for b in sorted(dealt):
        here: list[Item] = []
        for x in dealt[b]:
            for at in range(0, len(x.windows), most):
                part = replace(x, windows=x.windows[at : at + most])
                if here and sum(len(y.windows) for y in here) + len(part.windows) > most:
                    out.append(here)
                    here = []
                here.append(part)
        out.append(here)
    return out


class Words:
    """Words looked for, by their hashes (sorted)."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[hashes & np.uint64(0xFFFF)] = True

    def known(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words that are terms, and their terms."""
        at = np.flatnonzero(self.maybe[h & np.uint64(0xFFFF)])
        if not len(self.hashes):
            return at[:0], at[:0]
        term = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        real = self.hashes[term] == h[at]
        return at[real], term[real]


class Terms(Words):
    """The words of a block of items."""

    def __init__(self, items: list[Item]):
        self.numbers = [x.number for x in items]
        self.item_ids = [x.item_id for x in items]
        w = tb.words(pc.utf8_lower(pa.array([x.text for x in items], pa.string())), tb.ALNUM)
        h = w.hashes()
        super().__init__(np.unique(h))
        at = np.searchsorted(self.hashes, h)
        self.items = [at[a:b] for a, b in zip(w.first, w.first[1:])]
        self.windows = [own[a:b] for own, x in zip(self.items, items) for a, b in x.windows]
        self.owner = np.repeat(np.arange(len(items)), [len(x.windows) for x in items])


class Passages:
    def __init__(self, column):
        self.w = tb.words(pc.utf8_lower(column), tb.ALNUM)
        self.h = self.w.hashes()
        counts = self.w.counts
        self.strides = -(-counts // STRIDE)
        self.per_doc = np.where(counts > 0, np.maximum(self.strides - 1, 1), 0)
        self.first = np.concatenate([[0], np.cumsum(self.per_doc)])

    def entries(self, at: np.ndarray, term: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (passage, term) pairs; a word lies in two passages, at an end in one."""
        doc = self.w.doc[at]
        stride = (at - self.w.first[doc]) // STRIDE
        here = np.minimum(stride, self.per_doc[doc] - 1)
        before = np.maximum(stride - 1, 0)
        key = np.concatenate([(self.first[doc] + p) * n_terms + term for p in (here, before)])
        key = np.unique(key)
        return key // n_terms, key % n_terms


def _frequencies(docs: DataFrame, words: Words, text: str) -> tuple[np.ndarray, int]:
    """How many passages hold each word, and how many passages there are."""
    size = len(words.hashes)
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def count(batches):
        total, passages = np.zeros(size, np.int64), 0
        for batch in batches:
            for part in tb.slices(batch):
                p = Passages(part.column("text"))
                passages += int(p.first[-1])
                _, term = p.entries(*sent.value.known(p.h), max(size, 1))
                total += np.bincount(term, minlength=size)[:size]
        flat = np.concatenate([np.array([passages]), total])
        some = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], names=["at", "n"])

    # One row for each word at most, so as many as the benchmark has.
    rows = docs.select(F.col(text).alias("text")).mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(1 + size, np.int64)
    for r in rows:
        flat[r["at"]] = r["n"]
    return flat[1:], int(flat[0])


def _weights(m: Terms, df: np.ndarray, n: int, max_df: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the terms, and their plain inverse document frequencies."""
    idf = np.log((n + 1) / (df + 1)) + 1e-3
    weight = np.zeros(len(idf))
    for window in m.windows:  # an item's other words may be another block's to search
        weight[window] = np.maximum(idf[window] + np.log(max_df), 0.0)
    for window in m.windows:
        rare = _rarest(window, idf, OWN)
        weight[rare] = idf[rare]
    return weight, idf


def _rarest(item: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    terms = np.unique(item)
    return terms[np.lexsort((terms, -idf[terms]))[:n]]


def _test_matrix(m: Terms, rank: int) -> np.ndarray:
    return np.random.default_rng(7).standard_normal((len(m.hashes), rank))


def _singular_vectors(docs: DataFrame, models: list[Terms], weights: list[np.ndarray], ranks: list[int], text: str) -> list[np.ndarray]:
    """Leading right singular vectors of each block's passage matrix."""
    sent = docs.sparkSession.sparkContext.broadcast((models, weights, ranks))

    def sketch(batches):
        own, ws, rs = sent.value
        tests = [_test_matrix(m, r) for m, r in zip(own, rs)]
        sums = [np.zeros_like(t) for t in tests]
        seen = [np.zeros(len(t), bool) for t in tests]
        for batch in batches:
            for part in tb.slices(batch):
                p = Passages(part.column("text"))
                for m, w, test, total, s in zip(own, ws, tests, sums, seen):
                    at, term = m.known(p.h)
                    some = w[term] > 0
                    passage, term = p.entries(at[some], term[some], max(len(m.hashes), 1))
                    if not len(term):
                        continue
                    edge = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
                    y = np.add.reduceat(test[term] * w[term][:, None], edge, axis=0)
                    y = np.repeat(y, np.diff(np.append(edge, len(term))), axis=0) * w[term][:, None]
                    by = np.argsort(term, kind="stable")
                    first = np.flatnonzero(np.append(True, term[by][1:] != term[by][:-1]))
                    total[term[by][first]] += np.add.reduceat(y[by], first, axis=0)
                    s[term] = True
        for k, (total, s) in enumerate(zip(sums, seen)):
            touched = np.flatnonzero(s)
            for at in range(0, len(touched), 2000):
                few = touched[at : at + 2000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(few), k), pa.int32()), pa.array(few), pa.array([x.tobytes() for x in total[few]], pa.binary())], names=["block", "term", "row"])

    def add(batches):
        """Sums rows of one term; the terms of a task are at most the benchmark's."""
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, t, row in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(row)
                total[k, t] = total[k, t] + x if (k, t) in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.int32()), pa.array([t for _, t in total], pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["block", "term", "row"])

    schema = "block int, term long, row binary"
    rows = docs.select(F.col(text).alias("text")).mapInArrow(sketch, schema)
    tables = rows.repartition("term").mapInArrow(add, schema).toArrow()
    out = []
    block = tables.column("block").to_numpy()
    for k, (m, r) in enumerate(zip(models, ranks)):
        test = _test_matrix(m, r)
        b = np.zeros_like(test)
        mine = tables.filter(pa.array(block == k))
        for t, row in zip(mine.column("term").to_pylist(), mine.column("row").to_pylist()):
            b[t] = np.frombuffer(row)
        # Nystrom: A'A is about B (W'B)^-1 B', with a small shift for stability.
        shift = 1e-6 * max(np.linalg.norm(b), 1e-12)
        b = b + shift * test
        core = test.T @ b
        values, vectors = np.linalg.eigh((core + core.T) / 2)
        good = values > 1e-9 * max(values.max(initial=0.0), 1e-300)
        half = b @ (vectors[:, good] / np.sqrt(values[good]))
        u, s, _ = np.linalg.svd(half, full_matrices=False)
        out.append(u[:, s > 1e-9 * max(s.max(initial=0.0), 1e-300)])
    return out


def _common_subsequence(item: np.ndarray, region: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    where: dict[int, int] = {}
    for i, t in enumerate(item.tolist()):
        where[t] = where.get(t, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for t in region.tolist():
        if m := where.get(t, 0):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(item) - row.bit_count()


@dataclass(frozen=True)
class Model:
    terms: Terms
    weight: np.ndarray
    idf: np.ndarray
    vectors: np.ndarray

    @cached_property
    def loaded(self) -> np.ndarray:
        """Each term's singular vectors times its weight."""
        return (self.vectors * self.weight[:, None]).astype(np.float32)

    @cached_property
    def least_terms(self) -> int:
        return 1 if any(0 < len(np.unique(window)) < 4 for window in self.terms.windows) else 2

    def latent_windows(self) -> np.ndarray:
        z = np.zeros((len(self.terms.windows), self.vectors.shape[1]), np.float32)
        for k, window in enumerate(self.terms.windows):
            z[k] = self.loaded[np.unique(window)].sum(axis=0)
        return z

    def answers(self) -> list[tuple[tuple[dict[int, float], float], ...]]:
        """What counts as an item's answer, as weights of terms and their sum: its rarest terms; or else, of an
        item of one window all its terms by their rarity, of a longer one the rarest of all windows."""
        out = []
        for item in self.terms.items:
            spans = _windows(len(item))
            own = {t: 1.0 for t in _rarest(item, self.idf, ANSWER).tolist()}
            if len(spans) > 1:
                more = {t: 1.0 for a, b in spans for t in _rarest(item[a:b], self.idf, ANSWER).tolist()}
            else:
                more = {t: float(self.idf[t]) for t in np.unique(item).tolist()}
            out.append(tuple((weights, sum(weights.values()) or 1.0) for weights in (own, more)))
        return out


def _unit(z: np.ndarray) -> np.ndarray:
    size = np.sqrt((z * z).sum(axis=1, keepdims=True))
    return np.divide(z, size, out=np.zeros_like(z), where=size > 1e-12)


def _matches(p: Passages, model: Model, windows: np.ndarray, answers: list[tuple[tuple[dict[int, float], float], ...]], rules: Rules) -> dict[tuple[int, int], tuple[float, float, float]]:
    """(row, item number) -> (cosine, share of the item in order, share of its answer)."""
    terms = model.terms
    at, term = terms.known(p.h)
    some = model.weight[term] > 0
    passage, known = p.entries(at[some], term[some], max(len(terms.hashes), 1))
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    if not len(known) or not windows.size:
        return found
    edge = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    size = np.diff(np.append(edge, len(known)))
    enough = size >= model.least_terms
    known, passage = known[np.repeat(enough, size)], passage[np.repeat(enough, size)]
    if not len(known):
        return found
    edge = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    z = np.empty((len(edge), model.vectors.shape[1]), np.float32)
    for s in range(0, len(edge), 4096):  # bounds the gathered vectors
        e = min(s + 4096, len(edge))
        a, b = edge[s], edge[e] if e < len(edge) else len(known)
        z[s:e] = np.add.reduceat(model.loaded[known[a:b]], edge[s:e] - a, axis=0)
    along = z @ _unit(windows).T  # lengths of the passages along the windows
    cosine = along / np.maximum(np.sqrt((z * z).sum(axis=1)), 1e-12)[:, None]
    near = (cosine >= rules.least_cosine) & (along >= rules.least_share * np.sqrt((windows * windows).sum(axis=1)))
    every = np.full(len(p.h), -1, np.int64)
    every[at] = term
    nearest: dict[tuple[int, int], float] = {}
    for k, j in zip(*(x.tolist() for x in np.nonzero(near))):
        i = int(terms.owner[j])
        nearest[k, i] = max(nearest.get((k, i), -1.0), float(cosine[k, j]))
    compared: dict[tuple[int, int, int], tuple[float, float]] = {}  # passages of one short text have one region
    for (k, i), c in nearest.items():
        at_passage = int(passage[edge[k]])
        doc = int(np.searchsorted(p.first, at_passage, "right")) - 1
        item = terms.items[i]
        begin = int(p.w.first[doc]) + (at_passage - int(p.first[doc])) * STRIDE
        a, b = max(begin - len(item), int(p.w.first[doc])), min(begin + 2 * STRIDE + len(item), int(p.w.first[doc + 1]))
        if (a, b, i) not in compared:
            region = every[a:b]
            stand = set(region.tolist())
            answer = max(sum(x for t, x in own.items() if t in stand) / total for own, total in answers[i])
            compared[a, b, i] = (_common_subsequence(item, region) / len(item) if answer >= rules.least_answer else 0.0, answer)
        lcs, answer = compared[a, b, i]
        if answer >= rules.least_answer and lcs >= rules.least_lcs:
            found[doc, i] = max(found.get((doc, i), (0.0, 0.0, 0.0)), (lcs, answer, c))
    return {key: (c, l, a) for key, (l, a, c) in found.items()}


def _rank(m: Terms, rules: Rules) -> int:
    return min(len(m.windows) + 16, rules.rank, max(len(m.hashes), 1))


def _groups(blocks: list[list[Item]], rules: Rules) -> list[list[Terms]]:
    """Blocks for a pass each, with vectors of ``most_bytes`` together, one block at least."""
    out: list[list[Terms]] = []
    size = 0
    for block in blocks:
        m = Terms(block)
        own = 8 * len(m.hashes) * _rank(m, rules)
        if not out or size + own > rules.most_bytes:
            out.append([])
            size = 0
        out[-1].append(m)
        size += own
    return out


def fit(docs: DataFrame, terms: list[Terms], frequencies: list[np.ndarray], passages: int, text: str, rules: Rules) -> list[Model]:
    weighed = [_weights(m, df, passages, rules.max_df) for m, df in zip(terms, frequencies)]
    vectors = _singular_vectors(docs, terms, [w for w, _ in weighed], [_rank(m, rules) for m in terms], text)
    return [Model(m, w, idf, v) for m, (w, idf), v in zip(terms, weighed, vectors)]


def flagged(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", rules: Rules = Rules(), name: str = "leaks") -> DataFrame:
    """``docs`` with ``leaks``: array of (number of the benchmark's row, item_id, cosine, lcs,
    answer), empty for clean rows."""
    bench = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    entry = T.StructType([T.StructField("number", T.LongType()), T.StructField("item_id", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("cosine", "lcs", "answer")]])
    held = T.StructField(name, T.ArrayType(entry))
    # The driver cuts the benchmark into blocks, so its texts have to fit in there.
    blocks = _blocks(bench.withColumn("h", F.xxhash64("i", "t")).orderBy("i", "t").collect(), rules)
    groups = _groups(blocks, rules) or [[]]
    every = np.unique(np.concatenate([np.zeros(0, np.uint64), *(m.hashes for terms in groups for m in terms)]))
    counts, passages = _frequencies(docs, Words(every), text)
    models = lambda terms: fit(docs, terms, [counts[np.searchsorted(every, m.hashes)] for m in terms], passages, text, rules)
    if len(groups) == 1:
        return _searched(docs, models(groups[0]), text, held, rules)
    # Leaks follow from the text alone, so what groups find is kept by the text's digest.
    own = docs.select(F.sha2(F.col(text), 256).alias("_text"), F.col(text).alias("text"))
    found = [_searched(own, models(terms), "text", T.StructField("leaks", held.dataType), rules).filter(F.size("leaks") > 0).select("_text", F.explode("leaks").alias("x")) for terms in groups]
    # An item's windows may lie in several groups.
    best = reduce(DataFrame.unionAll, found).groupBy("_text", "x.number", "x.item_id").agg(F.max(F.struct("x.lcs", "x.answer", "x.cosine")).alias("b"))
    leaks = best.groupBy("_text").agg(F.collect_list(F.struct("number", "item_id", "b.cosine", "b.lcs", "b.answer")).alias("_leaks"))
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != name.lower()])
    kept = [F.col(f"`{c}`") for c in docs.columns]
    both = docs.join(leaks, F.sha2(docs[f"`{text}`"], 256) == leaks["_text"], "left")
    return both.select(*kept, F.coalesce("_leaks", F.array()).cast(held.dataType).alias(name))


def _searched(docs: DataFrame, models: list[Model], text: str, held: T.StructField, rules: Rules) -> DataFrame:
    """``docs`` with the leaks of a group of blocks."""
    sent = docs.sparkSession.sparkContext.broadcast(models)
    kind = pa.list_(pa.struct([("number", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64())]))
    cache: dict = {}

    def compute(part: pa.RecordBatch) -> list[pa.Array]:
        if not cache:
            cache["m"] = [(m, m.latent_windows(), m.answers()) for m in sent.value]
        p = Passages(part.column(text))
        best: list[dict[int, tuple]] = [{} for _ in range(part.num_rows)]
        for m, windows, answers in cache["m"]:
            for (row, i), (c, l, a) in sorted(_matches(p, m, windows, answers, rules).items()):
                number, new = m.terms.numbers[i], (l, a, c, m.terms.item_ids[i])
                if number not in best[row] or new[:3] > best[row][number][:3]:
                    best[row][number] = new
        out = [[{"number": n, "item_id": i, "cosine": c, "lcs": l, "answer": a} for n, (l, a, c, i) in x.items()] for x in best]
        return [pa.array(out, kind)]

    return frames.append(docs, [held], compute, text)


def matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row for each document and item that it leaks."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return flagged(own, benchmark, rules=rules).select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*").drop("number")
