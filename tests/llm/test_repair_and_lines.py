"""Conversation repair, importance resampling and line dedup against brute force."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import conversations, linededup, resample

# --- conversation repair ---------------------------------------------------------------


def plain_cheapest(rows):
    """By least cost first over all edits, one step at a time: rows are (role, text, fault)."""
    heap, seen = [(0, "", 0, ())], set()
    while heap:
        cost, audit, at, kept = heapq.heappop(heap)
        roles = "".join(r[:1] or "-" for r, _ in kept)
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in kept)
        if not re.fullmatch("(s?(ua)*u?)?", roles) or (at, roles) in seen:
            continue
        seen.add((at, roles))
        for role in ("user", "assistant"):
            heapq.heappush(heap, (cost + 5, audit + "I", at, (*kept, (role, ""))))
        if at < len(rows):
            role, text, fault = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, kept))
            if fault not in ("blank", "duplicate"):
                cut = 5 * (fault == "truncated")
                heapq.heappush(heap, (cost + cut, audit + "K", at + 1, (*kept, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 1 + cut, audit + "R", at + 1, (*kept, (new, text))))


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code:
            row = (turn, "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text)
            out += [row] * (1 + (code == 3))
    return out


def plain_repair(rows):
    """Of one conversation, after damage: everything but conv_id."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    told, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        told.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None))
        seen.add((role, text))
    cost, audit, left = plain_cheapest(told)
    turns = [t for t, _, _ in rows if t is not None]
    count = Counter(f for _, _, f in told)
    illegal = sum((a[0][:1] or "-") + (b[0][:1] or "-") not in ("su", "ua", "au") for a, b in zip(told, told[1:]))
    gaps = max(turns) - min(turns) + 1 - len({*turns}) if turns else 0
    return gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256(left.encode()).hexdigest()


def talk():
    r = random.Random(3)
    rows = []
    for conv in [*range(60), None]:
        for turn in range(r.randrange(1, 9)):
            role = r.choice(["system", "user", "assistant", "user", "assistant", "tool", "User", "", None])
            text = r.choice(["Yes.", "No!", "Well", "é? \n", "", " \t", None, f"It is {turn}.", "a b c. d"])
            rows.append((conv, turn if r.random() < 0.9 else r.choice([None, 2, 40]), role, text))
    for conv in range(100, 110):
        rows += [(conv, turn, ("user", "assistant")[turn % 2], f"It is {turn}.") for turn in range(6)]
    return rows + rows[:7] + rows[:3]


COLUMNS = "conv_id long, turn long, role string, text string"


def test_conversations(spark):
    rows = talk()
    docs = spark.createDataFrame(rows, COLUMNS).withColumn("Part", F.lit(1)).withColumn("code", F.lit("x")).repartition(5)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair_damaged(docs).collect()}
    want = {c: plain_repair(plain_damage([r for r in rows if r[0] == c])) for c in {r[0] for r in rows}}
    assert got == want
    assert any(w[5] == 0 and w[6] for w in want.values()) and any("R" in w[6] for w in want.values())
    assert conversations.repair_damaged(docs.limit(0)).count() == 0


def test_conversation_that_loses_all(spark):
    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    got = conversations.repair_damaged(spark.createDataFrame([(lost, 0, "user", "Hi.")], COLUMNS)).first()
    assert tuple(got) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_one_conversation_over_many_segments(spark):
    r = random.Random(4)
    rows = [(7, k, r.choice(["user", "assistant", "system"]), r.choice([f"It is {k}.", f"It is {k}", "", "Yes."])) for k in range(5000)] + [(k + 100, 0, "user", "Hi.") for k in range(20)]
    rows = [x for x in rows if x[0] != 7 or x[1] % 40 != 39] + [(7, 5000, "assistant", "End.")]
    got = conversations.repair(spark.createDataFrame(rows, COLUMNS).repartition(6)).filter("conv_id = 7").first()
    parts = conversations.segments(conversations.faults(spark.createDataFrame(rows, COLUMNS))).filter("conv_id = 7")
    assert parts.count() >= 5
    told, seen = [], set()
    for row in (x for x in rows if x[0] == 7):
        body = row[3].rstrip()
        told.append((row[2], row[3], "blank" if not body else "duplicate" if row[2:] in seen else "truncated" if body[-1] not in ".!?" else None))
        seen.add(row[2:])
    # One table of four states, without stacks or segments.
    best = {"": (0, ""), "u": (5, "I"), "a": (10, "II")}
    steps = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    for role, _, fault in told:
        new = {}
        for state, (cost, audit) in best.items():
            options = [(state, (cost + 2, audit + "D"))]
            if fault not in ("blank", "duplicate"):
                cut = 5 * (fault == "truncated")
                options += [(end, (cost + cut, audit + "K")) for (a, x), end in steps.items() if a == state and x == role[0]]
                options += [(end, (cost + cut + 1, audit + "R")) for (a, x), end in steps.items() if a == state and x in "ua"]
            for end, move in options:
                new[end] = min(new.get(end, (math.inf, "")), move)
        for _ in range(3):
            for (a, x), end in steps.items():
                if x in "ua" and a in new:
                    new[end] = min(new.get(end, (math.inf, "")), (new[a][0] + 5, new[a][1] + "I"))
        best = new
    want = min(best[s] for s in ("", "a") if s in best)
    assert (got.cost, got.audit) == want
    left = "\n".join(conversations.replay([t[0] for t in told], [t[1] for t in told], want[1]))
    assert got.repaired_sha256 == hashlib.sha256(left.encode()).hexdigest()
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in left.split("\n")))


def test_stacks_merge():
    parser, stacks = conversations._automaton()
    assert len(stacks) == 6  # nothing, s, u, su, pairs, pairs and u
    assert len({id(s) for s in stacks}) == 6
    for rows in ("u+a+" * 50, "s+u~a-" * 20):
        assert set(conversations.parse(rows)) <= set(range(6))
        ends = conversations.parse(rows[: len(rows) // 4 * 2])
        rest = rows[len(rows) // 4 * 2 :]
        joined = {}
        for entry, (cost, audit) in ends.items():
            for end, (more, edits) in conversations.parse(rest, entry).items():
                joined[end] = min(joined.get(end, (math.inf, "")), (cost + more, audit + edits))
        assert joined == conversations.parse(rows)


# --- importance resampling ----------------------------------------------------------------


def plain_resample(rows, target, ngrams, buckets, least, percent, seed):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return len(w), [" ".join(w[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for text in texts for f in features(text)[1]) for texts in ([x for _, x in rows], target))
    big_s, big_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in {*s, *t}}
    out = []
    for doc, text in rows:
        n, found = features(text)
        weight = math.floor(sum(gain[bucket(f)] for f in found) / len(found)) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return [r[:5] for r in out]


@pytest.mark.parametrize("ngrams,buckets,least,percent", [(1, 10_000, 20, 10), (3, 50, 5, 60)])
def test_resampling(spark, ngrams, buckets, least, percent):
    r = random.Random(9)
    words = [w for k in range(200) for w in (f"word{k}", f"É{k}tude", f"x{k}")]
    rows = [(k, " ".join(r.choices(words, k=r.randrange(0, 60)))) for k in range(150)]
    rows += [(500, None), (501, ""), (502, "-- ,.! \x00"), (503, "A-b_C\x7fd é" * 30), (None, " ".join(words[:40])), (None, None), (504, "ab " * 300_000), rows[3], rows[4]]
    target = [" ".join(words[:50]), None, "", "Word1 word2, word3"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Rank", F.lit(1)).withColumn("key", F.lit("k")).repartition(4)
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(docs, bench, ngrams=ngrams, buckets=buckets, least_words=least, percent=percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    want = plain_resample(rows, target, ngrams, buckets, least, percent, 2024)
    assert sorted(map(repr, (list(x) for x in got.collect()))) == sorted(map(repr, want))
    assert sum(x[4] is not None for x in want) > 5


def test_resampling_of_little(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = docs.limit(0)
    assert resample.resample(none, docs).count() == 0
    assert [x["rank"] for x in resample.resample(docs, none).collect()] == [None, None]
    everything = resample.resample(docs, none, least_words=0, percent=100).collect()
    assert sorted(x["rank"] for x in everything) == [1, 2]


# --- line dedup ------------------------------------------------------------------------------


def plain_lines(rows, least=10):
    def keyed(text):
        return [(line, re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))) for line in (text or "").split("\n")]

    beyond = 1 << 63
    held = {}
    for doc, text in rows:
        for _, k in keyed(text):
            held.setdefault(k, set()).add(beyond if doc is None else doc)
    out = []
    for doc, text in rows:
        own = beyond if doc is None else doc
        lines = keyed(text)
        kept = [line for line, k in lines if len(k) < least or len(held[k]) < 2 or own == min(held[k])]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def pages():
    r = random.Random(12)
    lines = [f"Line {k} says {'é' * (k % 12)} something" for k in range(60)] + ["", " ", "short", "é" * 9, "é" * 10, "ÀÉ upper case", "tab\tinside the line"]
    shown = lambda x: r.choice(["", " ", "\t", "\r"]) + r.choice([x, x.upper() if x.isascii() else x, x.lower() if x.isascii() else x]) + r.choice(["", " ", "\x0b", "\r"])
    rows = [(k, "\n".join(shown(r.choice(lines)) if r.random() < 0.6 else f"own line {k} {r.random()}" for _ in range(r.randrange(0, 12)))) for k in range(120)]
    rows += [(300, None), (301, ""), (302, "\n\n"), (None, "own line of none\n" + lines[3]), (None, "own line of none"), (5, lines[7] + "\nfive once more, this time"), rows[8], (303, "word and word " * 100_000 + "\n" + lines[1])]
    r.shuffle(rows)
    return rows


def result(df):
    return sorted((tuple(x) for x in df.select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=repr)


def test_lines(spark):
    rows = pages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hi", F.lit(1)).withColumn("Kept", F.lit("x")).repartition(5)
    got = linededup.deduplicate(docs)
    assert result(got) == plain_lines(rows)
    assert all(hashlib.sha256(x.kept.encode()).hexdigest() == x.kept_sha256 for x in got.collect())
    assert linededup.deduplicate(docs.limit(0)).count() == 0


def test_lines_inserted_and_taken_back(spark, tmp_path):
    rows = [x for x in pages() if x[0] is not None]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    early, late = [x for x in rows if x[0] % 3], [x for x in rows if x[0] % 3 == 0]
    index = linededup.insert(linededup.empty(spark, 3), make(early).repartition(4))
    before = result(linededup.apply(index, make(early)))
    assert before == plain_lines(early)
    index = linededup.insert(index, make(late))
    assert result(linededup.apply(index, make(rows))) == plain_lines(rows)
    # Every key has its fingerprint, held once or more.
    filters = {r.shard: linededup.Cuckoo.read(r.filter) for r in index.filters.collect()}
    hi = np.array([r.hi for r in index.references.select("hi").distinct().collect()], np.int64)
    assert all(filters[int(h) % 3].holds(np.array([h]).view(np.uint64))[0] for h in hi)
    assert sum(int(np.count_nonzero(t)) for f in filters.values() for t in f.tables) == len(hi)
    index.save(str(tmp_path / "index"))
    index = linededup.Index.load(spark, str(tmp_path / "index"), 3)
    # The smallest holders go: what was dropped for their sake stays again.
    gone = {x[0] for x in rows if x[0] < 40}
    less = linededup.delete(index, spark.createDataFrame([(g,) for g in gone] + [(99_999,), (None,)], "id long"))
    left = [x for x in rows if x[0] not in gone]
    assert result(linededup.apply(less, make(left))) == plain_lines(left)
    wider = linededup.insert(linededup.rebuilt(linededup.delete(index, make(late).select("doc_id")), 7), make(late))
    assert wider.shards == 7 and result(linededup.apply(wider, make(rows))) == plain_lines(rows)
    back = linededup.delete(index, make(late).select("doc_id"))
    assert result(linededup.apply(back, make(early))) == before
    again = linededup.insert(back, make(late))
    assert result(linededup.apply(again, make(rows))) == plain_lines(rows)
    remaining = back.references.select("hi").distinct().count()
    assert sum(int(np.count_nonzero(t)) for r in back.filters.collect() for t in linededup.Cuckoo.read(r.filter).tables) == remaining


def test_cuckoo():
    r = np.random.default_rng(1)
    h = np.unique(r.integers(0, 1 << 63, 30_000).astype(np.uint64))
    c = linededup.Cuckoo()
    for part in np.array_split(r.permutation(h), 7):
        c.insert(part)
    assert c.holds(h).all()
    other = r.integers(0, 1 << 63, 100_000).astype(np.uint64)
    assert c.holds(other).mean() < 0.005
    assert linededup.Cuckoo.read(c.write()).holds(h).all()
    c.delete(h[::2])
    assert c.holds(h[1::2]).all() and c.holds(h[::2]).mean() < 0.005
    c.delete(h[1::2])
    assert not any(t.any() for t in c.tables)
    full = linededup.Cuckoo()
    full.reserve(64)
    full.insert(h[:5000])  # far more than one table takes
    assert full.holds(h[:5000]).all() and len(full.tables) > 1


def test_false_positives_have_fingerprints_of_their_own():
    """A key taken for known by a collision isn't lost when the one it collided with is deleted."""
    h = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 400_000).astype(np.uint64))
    c = linededup.Cuckoo()
    c.reserve(64)
    c.insert(h[:40])
    met = h[40:][c.holds(h[40:])][:3]
    assert len(met)
    c.insert(met)
    c.delete(h[:40])
    assert c.holds(met).all()
