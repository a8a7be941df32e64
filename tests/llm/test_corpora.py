"""Operators that compare all texts with each other, against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import chunks, classify, decontaminate, exact, licenses, sentencepiece_fst, simhash, substrings, suffixes
from tessera.llm.queries import MODEL_PATH, ORACLE_SQL

SYLLABLES = "an be ce di eo fu ga hi jo ku".split()


def prose(r, n):
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randrange(1, 4))) for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, repeats within a text, and odd rows."""
    r = random.Random(5)
    passage = prose(r, 120)
    rows = [prose(r, r.randrange(5, 200)) for _ in range(40)]
    rows += [f"{prose(r, 15)} {passage} {prose(r, 15)}" for _ in range(6)]
    long = prose(r, 400)
    rows += [long, long, long.replace(" ", "\n"), long + " end"]
    near = long.split()
    for _ in range(12):
        k = r.randrange(len(near))
        rows.append(" ".join([*near[:k], "new", *near[k + 1 :]]))
    rows += [f"{prose(r, 9)} {passage[:350]} {prose(r, 9)}", f"{prose(r, 7)} {passage[50:399]}", f"{passage[:310]}", "la " * 700, "la " * 50, f"{passage} {prose(r, 5)} {passage}", "é" * 300, "", None, " ", "\t\n", "a b", "b a", "a  b", "x" * 399, "x" * 400, "x" * 399]
    r.shuffle(rows)
    ids = list(range(100, 100 + len(rows)))
    rows, ids = rows + [rows[0], rows[3], "no id", "no id", None], ids + [ids[0], ids[3], None, None, None]
    return list(zip(ids, rows))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").withColumn("Kept", F.lit(1)).withColumn("chunk", F.lit("x")).repartition(5)


def same(got, want):
    show = lambda rows: sorted(repr([None if x is None or x != x else x.item() if isinstance(x, np.generic) else int(x) if isinstance(x, float) else x for x in r]) for r in rows)
    assert show(got) == show(want)


# --- exact dedup -------------------------------------------------------------------


@pytest.mark.parametrize("block", [7, 4096])
def test_exact(docs, block):
    rows = [(i, t or "", re.sub(r"[\x20\x09-\x0D]", "", t or "")) for i, t in corpus()]
    groups = {}
    for i, t, n in rows:
        groups.setdefault(n, []).append((-len(t), i is None, i or 0, i))
    want = []
    for i, t, n in rows:
        best = min(groups[n])
        want.append((i, best[3], len(groups[n]), i == best[3] and -len(t) == best[0], hashlib.sha256(n.encode()).hexdigest()))
    got = exact.exact_duplicates(docs, block=block).drop("n_chars").collect()
    same(got, want)


def test_exact_rows_that_stay(docs):
    left = exact.without_copies(docs, block=50)
    assert left.columns == docs.columns
    norms = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in left.collect()]
    assert set(norms) == {re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in corpus()}
    assert exact.exact_duplicates(docs.limit(0)).count() == 0


def test_exact_plan_is_native(docs):
    plan = exact.exact_duplicates(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert "op8_exact_dedup" in ORACLE_SQL


# --- simhash -----------------------------------------------------------------------


def plain_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(points, near):
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in itertools.combinations(points, 2):
        if near(a, b):
            root[find(a)] = find(b)
    return {p: find(p) for p in points}


def test_simhash(docs):
    rows = [(i, plain_fingerprint(t)) for i, t in corpus()]
    root = classes({f for _, f in rows}, lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, f in rows:
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    same(simhash.near_duplicates(docs).collect(), [(i, f"{f:016x}", least.get(root[f])) for i, f in rows])
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {None, *(i for i, f in rows if i == least.get(root[f]))}


def test_links_in_dense_groups(spark):
    r = random.Random(6)
    points = set()
    for _ in range(6):
        centre = r.getrandbits(64)
        points.add(centre)
        for _ in range(25):
            x = centre
            for _ in range(r.randrange(1, 5)):
                x ^= 1 << r.randrange(64)
            points.add(x)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    got = simhash.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))).collect()
    have = {r.node & (1 << 64) - 1: r.root for r in got}
    want = classes(points, lambda a, b: (a ^ b).bit_count() <= 2)
    linked = {p for p, n in Counter(want.values()).items() if n > 1}
    assert set(have) == {p for p in points if want[p] in linked}
    assert {frozenset(p for p in have if have[p] == x) for x in set(have.values())} == {frozenset(p for p in points if want[p] == x) for x in linked}


@pytest.mark.parametrize("crowded", [2, 64, 10**9])
def test_chains_find_all_links_and_prune(spark, crowded):
    """All places of one and two differing bits, and random ones: every link is a candidate, and
    chains leave fewer pairs than share three segments."""
    r = random.Random(8)
    whole = (1 << 64) - 1
    centre = r.getrandbits(64)
    points = {centre ^ (1 << i | 1 << j) for i, j in itertools.combinations_with_replacement(range(0, 64, 3), 2)} | {centre}
    points |= {centre ^ sum(1 << k for k in r.sample(range(64), 3)) for _ in range(200)} | {r.getrandbits(64) for _ in range(200)}
    pairs = list(itertools.combinations(sorted(points, key=lambda p: p - (1 << 64) if p >> 63 else p), 2))
    ring = lambda x, start, n: (x >> 8 * start | x << 64 - 8 * start) & (1 << 8 * n) - 1
    sharing = {(b, a) for a, b in pairs if any(ring(a ^ b, s, 3) == 0 for s in range(8))}
    chained = {(b, a) for a, b in pairs if any(ring(a ^ b, s, 3) == 0 and ring(a ^ b, s, 7).bit_count() <= 1 for s in range(8))}
    linked = {(b, a) for a, b in pairs if (a ^ b).bit_count() <= 2}
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
    of = lambda rows: {(x.a & whole, x.b & whole) for x in rows.collect()}
    found = of(simhash.candidates(df, crowded))
    assert found == chained and linked == of(simhash.links(df, crowded)) and linked <= chained
    assert 0 < len(linked) < len(chained) < len(sharing) / 2


def test_components_of_a_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}
    assert simhash.components(edges.limit(0)).count() == 0


# --- repeated strings and windows --------------------------------------------------


def plain_repeats(rows, size=400):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(b[k : k + size] for b in texts for k in range(len(b) - size + 1))
    for (i, _), b in zip(rows, texts):
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k] += 1
                gone[k + size] -= 1
        keep = np.cumsum(gone[:-1]) == 0
        left = np.frombuffer(b, np.uint8)[keep].tobytes()
        yield i, len(b), len(b) - len(left), int(np.count_nonzero(np.diff(np.concatenate([[1], keep.astype(int)])) == -1)), hashlib.sha256(left).hexdigest(), left


@pytest.mark.parametrize("args", [{}, {"chunk_bytes": 3000, "hot": 1, "shard_bytes": 2000}, {"chunk_bytes": 3000, "hot": 3, "shard_bytes": 9000}])
def test_suffixes(docs, args):
    got = suffixes.remove_repeats(docs, **args).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared")
    same(got.collect(), [(*x[:5], y[2]) for x, y in zip(plain_repeats(corpus()), plain_repeats(corpus(), suffixes.SHORT))])


def test_long_documents_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_BLOCK", 1500)
    r = random.Random(8)
    part = prose(r, 150)
    chunk = pa.table({"doc_id": [1, 2], "text": [prose(r, 300) + part + prose(r, 300), "x" * 5000]})
    seen = {}
    for part in suffixes._Chunk(chunk).pieces():
        for p, (row, start, windows) in enumerate(zip(part.row.tolist(), part.start.tolist(), part.windows.tolist())):
            whole = chunk.column("text")[row].as_py().encode()
            assert part.data(p) == whole[start : start + windows + 399]  # cut off at the document's end
            assert part.whole[p] == max(0, len(part.data(p)) - 399)
            for k in range(windows):
                assert (row, start + k) not in seen
                seen[row, start + k] = True
    assert len(seen) == sum(len(t) - suffixes.SHORT + 1 for t in chunk.column("text").to_pylist())


def test_suffix_ranks_and_common_prefixes():
    r = random.Random(9)
    pieces = ["".join(r.choice("ab") for _ in range(r.randrange(20, 60))).encode() for _ in range(30)]
    size = np.array([len(p) for p in pieces])
    ends = np.cumsum(size)
    text = np.frombuffer(b"".join(pieces), np.uint8)
    stop = np.repeat(ends, size)
    suffix = [text[i : stop[i]].tobytes() for i in range(len(text))]
    rank, half = suffixes.suffix_ranks(text, stop, 64)
    order = np.argsort(rank, kind="stable")
    assert [suffix[i] for i in order] == sorted(suffix)
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))
    got = suffixes.common_prefixes(text, ends - size, ends, order, place, 64)
    for a, b in zip(order, order[1:]):
        n = 0
        while n < min(len(suffix[a]), len(suffix[b])) and suffix[a][n] == suffix[b][n]:
            n += 1
        assert got[b] == n and (half[a] == half[b]) == (suffix[a][:32] == suffix[b][:32])


def test_common_prefixes_of_ranks_by_a_bounded_depth():
    """Pieces equal further than ranks tell, in the other order after that."""
    r = random.Random(22)
    base = bytes(r.randrange(97, 123) for _ in range(700))
    pieces = [base[:k] + bytes([r.randrange(97, 123)]) + bytes(r.randrange(97, 123) for _ in range(20)) for k in (430, 520, 530, 560, 600, 640, 660) for _ in range(4)]
    r.shuffle(pieces)
    windows = np.array([len(p) - suffixes.SHORT + 1 for p in pieces])
    at, twice, text = suffixes._repeats(pieces, windows)
    starts = [(k, s) for k, p in enumerate(pieces) for s in range(len(p) - suffixes.SHORT + 1)]
    for size in (suffixes.SHORT, 400):
        seen = Counter(pieces[k][s : s + size] for k, s in starts if s + size <= len(pieces[k]))
        assert twice[size].tolist() == [s + size <= len(pieces[k]) and seen[pieces[k][s : s + size]] > 1 for k, s in starts]


def plain_windows(rows, size=13):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    big = chunks.NO_ID
    least = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            least[key] = min(least.get(key, big), big if i is None else i)
    for (i, _), w in zip(rows, words):
        keep = [True] * len(w)
        for k in range(len(w) - size + 1):
            if least[tuple(w[k : k + size])] < (big if i is None else i):
                keep[k : k + size] = [False] * size
        left = " ".join(x for x, k in zip(w, keep) if k)
        yield i, len(w), len(w) - sum(keep), hashlib.sha256(left.encode()).hexdigest(), left


@pytest.mark.parametrize("chunk_bytes", [2000, 1 << 22])
def test_substrings(docs, chunk_bytes):
    same(substrings.deduplicate(docs, chunk_bytes=chunk_bytes).collect(), plain_windows(corpus()))


def test_difference_cover():
    n = substrings.PERIOD
    assert all(any((i + s) % n in substrings.COVER and (j + s) % n in substrings.COVER for s in range(n)) for i in range(n) for j in range(n))


def test_empty_tables(docs):
    none = docs.limit(0)
    assert suffixes.remove_repeats(none).count() == substrings.deduplicate(none).count() == simhash.near_duplicates(none).count() == 0


def test_chunks_grow_with_the_corpus():
    sizes = [chunks.chunk_size(10**n) for n in range(6, 15)]
    assert sizes == sorted(sizes) and sizes[0] == chunks.CHUNK_BYTES and sizes[-1] == chunks.MOST_CHUNK_BYTES
    assert chunks.buckets(0) == 1 and all(0.99 * (1 << 20) <= 10**n / chunks.buckets(10**n) <= 1 << 22 for n in range(9, 15))
    # A chunk's list for a bucket, at one entry for 100 bytes.
    for total in (10**9, 10**11, 10**13):
        assert chunks.chunk_size(total) / 100 / chunks.buckets(total / 100) > 5


def test_packed_lists():
    for a in ([], [5], [0, 2**64 - 1, 3], list(range(1000))):
        assert chunks.unpack(chunks.pack(np.array(a, np.uint64))).tolist() == a


# --- decontamination ---------------------------------------------------------------


def test_decontamination(spark):
    r = random.Random(10)
    items = [(i, prose(r, 30)) for i in range(20)] + [(90, ""), (91, None), (None, prose(r, 25)), (92, prose(r, 4))]
    rows, want = [], set()
    for d in range(120):
        words = prose(r, r.randrange(20, 300)).split()
        if d % 5 == 0:
            i, t = items[d % 20]
            own = t.split()
            if d % 10 == 0:  # a paraphrase: some words changed or left out
                own = [x for k, x in enumerate(own) if k % 7 != 3]
                own[1] = "other"
            at = r.randrange(len(words))
            words[at:at] = own
            want.add((d, i))
        rows.append((d, " ".join(words)))
    rows += [(500, None), (501, ""), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for rules in (decontaminate.Rules(), decontaminate.Rules(block=7, most_bytes=60_000)):
        got = decontaminate.matches(docs, bench, rules=rules).toPandas()
        assert {(int(d), int(i)) for d, i in zip(got.doc_id, got.item_id)} == want
        assert Counter(got.doc_id)[0] == 2
    # Recall of the search against comparing all texts with all items of 25 words or more.
    all_pairs = plain_leaks([(d, t) for d, t in rows if t], [(i, t) for i, t in items if t and len(t.split()) >= 25])
    assert len(all_pairs & want) >= 0.9 * len(all_pairs) and len(all_pairs) >= 20
    assert decontaminate.matches(docs, bench.limit(0)).count() == decontaminate.matches(docs.limit(0), bench).count() == 0
    flagged = decontaminate.flagged(docs.withColumn("LEAKS", F.lit(1)), bench)
    assert flagged.columns == ["doc_id", "text", "leaks"] and flagged.count() == len(rows)


def plain_leaks(rows, items, least=0.6):
    """Pairs whose longest common subsequence covers the item's share, by the full table."""
    out = set()
    for (d, t), (i, item) in itertools.product(rows, items):
        a, b = np.array(item.split()), t.split()
        row = np.zeros(len(a) + 1, int)
        for x in b:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(a == x, row[:-1] + 1, 0)))
        if row[-1] >= least * len(a):
            out.add((d, i))
    return out


@pytest.mark.parametrize("rules", [decontaminate.Rules(), decontaminate.Rules(block=8, rank=8, most_bytes=40_000)])
def test_decontamination_of_long_items(spark, rules):
    r = random.Random(13)
    words = [f"w{k}" for k in range(600)]  # the first are common
    drawn = lambda n: [words[int(600 * r.random() ** 2)] for _ in range(n)]
    items = [(i, " ".join(drawn(n))) for i, n in enumerate((64, 65, 100, 300, 300, 500, 500, 800, 1000))]
    rows = []
    for d in range(200):
        own = items[d % 9][1].split()
        if d < 18:
            if d >= 9:  # reworded: a third of the common words changed, a third left out
                own = ["other" if k % 3 == 1 and x in words[:120] else x for k, x in enumerate(own) if k % 3 != 2 or x not in words[:120]]
        else:
            own = own[: len(own) // 3] if d < 27 else []  # a third of an item is no leak
        rows.append((d, " ".join([*drawn(r.randrange(20, 150)), *own, *drawn(r.randrange(20, 150))])))
    want = plain_leaks(rows, items)
    assert want == {(d, d % 9) for d in range(18)}
    got = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*items, items[8]], "item_id long, text string"), rules=rules).toPandas()
    counts = Counter((int(d), int(i)) for d, i in zip(got.doc_id, got.item_id))
    assert set(counts) == want and all(n == (2 if i == 8 else 1) for (_, i), n in counts.items())


@pytest.mark.parametrize("share", [0, 20, 30])
def test_decontamination_of_reworded_items(spark, share):
    """Items of 15 to 60 words, planted with a share of their words left out or replaced, among other texts:
    every pair whose common subsequence is long enough is found, but for a few answers, and nothing else."""
    r = random.Random(share + 17)
    words = [f"w{k}" for k in range(3000)]
    drawn = lambda n: [words[int(3000 * r.random() ** 2)] for _ in range(n)]
    items = [(k, " ".join(drawn(n))) for k, n in enumerate([15, 25, 40, 60] * 12)]
    rows = [(d, " ".join(drawn(r.randrange(40, 200)))) for d in range(300)]
    for i, t in items:
        own = [x if r.randrange(100) >= share else "other" if r.random() < 0.5 else None for x in t.split()]
        rows.append((1000 + i, " ".join([*drawn(50), *(x for x in own if x), *drawn(50)])))
    want = plain_leaks(rows, items)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for rules in (decontaminate.Rules(), decontaminate.Rules(block=16, rank=64, most_bytes=200_000)):
        got = {(x.doc_id, x.item_id) for x in decontaminate.matches(docs, bench, rules=rules).collect()}
        assert got <= want and len(got) >= (0.97 if share < 30 else 0.95) * len(want) and len(want) >= 30
    # Of the pairs turned away the search loses few; with every passage a candidate it loses none.
    pairs = lambda **rules: {(x.doc_id, x.item_id) for x in decontaminate.matches(docs, bench, rules=decontaminate.Rules(least_answer=0.0, **rules)).collect()}
    assert pairs() <= want and len(pairs()) >= 0.97 * len(want)
    assert pairs(least_cosine=-1.0, least_share=0.0) == want


def test_common_subsequence():
    r = random.Random(11)
    for _ in range(200):
        a, b = (np.array([r.randrange(5) for _ in range(r.randrange(1, 20))]) for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate._common_subsequence(a, b) == table[-1, -1]


# --- very long texts ---------------------------------------------------------------


def test_very_long_texts(spark):
    """A text of 12 MB beside short ones, in every operator on documents."""
    r = np.random.default_rng(14)
    words = np.array([f"{a}{b}{c}" for a in SYLLABLES for b in SYLLABLES for c in SYLLABLES])
    body = " ".join(words[r.integers(0, len(words), 1_750_000)])
    passage = " ".join(words[r.integers(0, len(words), 100)])
    long = f"{body} {passage} all rights reserved"
    rows = [(1, passage), (2, long), (3, long.replace(" ", "\n")), (4, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    assert len(long) > 12_000_000
    n = len(long.split())
    by = lambda df: {r.doc_id: r for r in df.collect()}
    same_text = by(exact.exact_duplicates(docs))
    assert same_text[3].keep_id == 2 and same_text[2].group_size == 2 and same_text[4].group_size == 1
    near = by(simhash.near_duplicates(docs))
    assert near[3].component_id == 2 and near[2].fingerprint == near[3].fingerprint
    gone = by(substrings.deduplicate(docs).drop("kept"))
    assert (gone[1].n_removed, gone[2].n_removed, gone[3].n_removed) == (0, 100, n)
    cut = by(suffixes.remove_repeats(docs).drop("kept"))
    assert (cut[1].n_bytes, cut[1].n_removed, cut[2].n_bytes) == (len(passage), len(passage), len(long))
    assert len(passage) <= cut[2].n_removed < 2 * len(passage) and cut[3].n_removed < 1000
    lic = by(licenses.scan(docs).drop("text"))
    assert (lic[2].n_words, lic[2].n_base, lic[2].first_word, lic[2].base_labels) == (n, 1, n - 3, "reserved")
    bench = spark.createDataFrame([(7, passage)], "item_id long, text string")
    assert {x.doc_id for x in decontaminate.matches(docs, bench).collect()} == {1, 2, 3}
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, 0)], "doc_id long, quality int")
    for task in (classify.QUALITY, classify.TOXICITY):
        model = classify.train(docs, labels, "quality", task)
        assert all(0 <= x.score <= 1 for x in classify.score(docs, model).drop("text").collect())
    coded = by(sentencepiece_fst.encode(docs, MODEL_PATH, check=True).select("doc_id", "n_tokens", "round_trip"))
    assert all(x.round_trip for x in coded.values()) and coded[2].n_tokens > n
    docs.unpersist()


# --- the pipeline ------------------------------------------------------------------


def test_pipeline_keeps_one_of_repeated_rows(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (2, "ab"), (3, None), (3, None), (None, "d"), (None, "d"), (4, "e")]
    got = pipeline.exact_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert got.columns == ["doc_id", "text"]
    same(got.collect(), [(1, "a b"), (1, "c"), (3, None), (None, "d"), (4, "e")])


def test_pipeline_against_its_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(12)
    item = prose(r, 30)
    good = [prose(r, 60) for _ in range(40)]
    junk = [" | ".join(prose(r, 60).split()) for _ in range(40)]
    texts = good + junk + [good[0].replace(" ", "\n"), f"{good[1]} {item}"]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "en", "source": "s", "n_chars": [len(t) for t in texts]})
    for name, df in (("documents", docs), ("labels", pd.DataFrame({"doc_id": range(80), "quality": [1] * 40 + [0] * 40, "toxic": 0})), ("benchmark", pd.DataFrame({"item_id": [1], "text": [item]}))):
        df.to_parquet(tmp_path / f"{name}.parquet")
    got = pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(got.doc_id) == list(range(40)) and got.round_trip.all()
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, frame, str(tmp_path)).columns == list(docs.columns)
    # Odd rows, columns with the names that operators use, and empty tables.
    odd = [(i, t, "in", k, 0.1 * k, None, "x") for k, (i, t) in enumerate([(0, good[0]), (0, good[0]), (100, good[0]), (1, None), (2, ""), (3, " "), (None, good[2]), (None, good[2]), (4, good[4]), (4, good[5])])]
    frame = spark.createDataFrame(odd, "doc_id long, text string, `Score` string, predicted int, leaks double, fp string, keep_id string").repartition(3)
    want = {
        "quality classifier": [0, 0, 100, None, None, 4, 4],
        "exact dedup": [0, 3, None, 4, 4],
        "simhash near-dedup": [0, 0, 1, None, None, 4, 4],
        "benchmark decontamination": [0, 0, 100, 1, 2, 3, None, None, 4, 4],
    }
    for name, stage in pipeline.STAGES[:-1]:
        got = stage(spark, frame, str(tmp_path))
        assert got.columns == frame.columns
        key = lambda i: (i is None, i or 0)
        rows = got.collect()
        if name != "simhash near-dedup":
            assert sorted((r.doc_id for r in rows), key=key) == sorted(want[name], key=key), name
        else:  # near ones of these short texts may be linked too
            assert {0, 4, None} >= {r.doc_id for r in rows} - {1} and not {100, 2, 3} & {r.doc_id for r in rows}
        before = {(r[0], r[1], *r[2:]) for r in frame.collect()}
        assert all(tuple(r) in before for r in rows)
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0
    last = pipeline.STAGES[-1][1](spark, frame, str(tmp_path))
    assert last.count() == len(odd) and last.filter("not round_trip").count() == 0
