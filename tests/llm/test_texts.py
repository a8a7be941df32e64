"""Operators that treat each text by itself."""

import math
import random
import re
import struct
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import classify, ftrl, htmltext, licenses, sentencepiece_fst
from tessera.llm import textbatch as tb
from tessera.llm.queries import MODEL_PATH

ODD = [None, "", " \n\t", "é", "word", "a b a b a b", "All rights reserved. ALL RIGHTS RESERVED", "\U0001f642 \x00 x"]


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_words_match_a_regular_expression():
    texts = [*ODD, " lead", "tail ", "x" * 5000, "a\x0bb\x1cc"]
    for table, rule in ((tb.SPACED, r"[^\x20\x09-\x0D]+"), (tb.ALNUM, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")):
        w = tb.words(pa.array(texts), table, lower=True)
        got = [[w.buf[w.starts[i] : w.ends[i]].tobytes().decode() for i in range(a, b)] for a, b in zip(w.first, w.first[1:])]
        assert got == [re.findall(rule, lowered(t)) for t in texts]
        h = w.hashes()
        by_word = {}
        for i in range(len(h)):
            assert by_word.setdefault(w.buf[w.starts[i] : w.ends[i]].tobytes(), h[i]) == h[i]
        assert len(set(by_word.values())) == len(by_word)


def test_slices_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 10, None, "", "y" * 100, "z"])], names=["text"])
    assert pa.Table.from_batches(list(tb.slices(batch, most=12))).to_pydict() == batch.to_pydict()


# --- classifiers -------------------------------------------------------------------

RARE = classify.Task(classify.toxicity_features, tb.ALNUM, ftrl.Ftrl(l1=0.1, epochs=6), max_train_rows=1000)


def corpus(spark):
    r = random.Random(1)
    calm = ["the", "of", "and", "river", "stone", "light"]
    rows = []
    for i in range(300):
        words = [r.choice(calm) for _ in range(20)]
        if i % 3 == 0:
            words[r.randrange(20)] = r.choice(["idiot", "Moron,"])
        rows.append((i, " ".join(words), i % 3 == 0))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in rows] + [(0, 0), (None, 1), (7, None), (999, 1)], "doc_id long, toxic int")
    return docs, labels


def test_classifier_learns_and_scores_as_a_plain_dot_product(spark):
    docs, labels = corpus(spark)
    out = classify.held_out("doc_id", 3, 1)
    model = classify.train(docs, labels, "toxic", RARE, keep=~out)
    got = classify.score(docs, model).withColumn("out", out).toPandas()
    right = (got.predicted == (got.doc_id % 3 == 0))[got.out]
    assert right.mean() > 0.95
    weight = dict(zip(model.index.tolist(), model.weight))
    for text, score in zip(got.text[:20], got.score[:20]):
        f, _ = RARE.features(pa.array([text]))
        total = model.bias + sum(weight.get(i, 0.0) for i in {int(x) & ((1 << 20) - 1) for x in f})
        assert score == pytest.approx(1 / (1 + math.exp(-total)))


M64 = (1 << 64) - 1


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M64
    return x ^ x >> 31


def plain_hash(data):
    total, power = 0, 1
    for b in data:
        total, power = total + (b + 1) * power, power * tb._P & M64
    return plain_mix(total & M64)


def plain_gram(parts, salt):
    out = salt
    for h in parts:
        out = (out * tb._P + h) & M64
    return plain_mix(out)


def plain_features(task, text):
    if task is classify.TOXICITY:
        w = [x.encode() for x in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))]
        h = [plain_hash(x) for x in w]
        runs = [([h], (0,), 1), ([h], (0, 1), 2), ([h], (0, 2), 3), *(([[plain_hash(x[:k]) for x in w]], (0,), 10 + k) for k in (3, 4, 5, 6))]
    else:
        w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        h = [plain_hash(x) for x in w]
        kind = lambda b: 1 if 97 <= b < 123 or b >= 128 else 2 if 65 <= b < 91 else 3 if 48 <= b < 58 else b
        shapes = []
        for k, x in enumerate(w):
            kinds = [kind(b) for b in x]
            run = [c for i, c in enumerate(kinds) if i == 0 or c != kinds[i - 1]]
            shapes.append(0x5EED if k and w[k - 1] == x else plain_hash(run))
        runs = [([h], (0,), 1), ([h], (0, 1), 2), *(([shapes], o, s) for o, s in (((0,), 4), ((0, 1), 5), ((0, 1, 2), 6)))]
    return {plain_gram([v[i + o] for o in offsets], salt) & (1 << 20) - 1 for (v,), offsets, salt in runs for i in range(len(v) - offsets[-1])}


@pytest.mark.parametrize("task", [classify.TOXICITY, classify.QUALITY])
def test_scores_against_a_plain_dot_product(spark, task):
    r = random.Random(9)
    texts = [*ODD, *(" ".join(r.choice(["Ab", "ab", "ab1", "x%", "é", "The", "The", "idiot,"]) for _ in range(r.randrange(40))) for _ in range(60))]
    index = np.unique([f for t in texts for f in plain_features(task, t)])
    model = classify.Model(task, index, np.array([r.uniform(-1, 1) for _ in index]), 0.25)
    weight = dict(zip(index.tolist(), model.weight))
    got = classify.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).toPandas().sort_values("doc_id")
    for t, score, predicted in zip(texts, got.score, got.predicted):
        want = 1 / (1 + math.exp(-(0.25 + sum(weight[f] for f in plain_features(task, t)))))
        assert score == pytest.approx(want) and predicted == (score >= 0.7)


def test_learner_against_a_plain_loop():
    r = random.Random(10)
    rows = [np.array(sorted(r.sample(range(30), r.randrange(0, 8))), np.uint32) for _ in range(200)]
    ys = np.array([float(1 in x or 7 in x) for x in rows])
    p = ftrl.Ftrl(alpha=0.4, l1=0.3, epochs=2, positive_weight=2.0, bits=5)
    z, n = dict.fromkeys([*range(32), "bias"], 0.0), dict.fromkeys([*range(32), "bias"], 0.0)

    def weight(i):
        l1 = 0.0 if i == "bias" else p.l1
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for x, y in zip(rows, ys):
            own = [*x.tolist(), "bias"]
            w = {i: weight(i) for i in own}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (p.positive_weight if y else 1.0)
            for i in own:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha * w[i]
                n[i] += g * g
    got, bias = ftrl.fit(rows, ys, p)
    assert got == pytest.approx([weight(i) for i in range(32)]) and bias == pytest.approx(weight("bias"))
    assert 0 < np.count_nonzero(got) < 32


@pytest.mark.parametrize("task", [classify.TOXICITY, classify.QUALITY])
def test_a_long_text_in_blocks_has_the_same_features(task, monkeypatch):
    r = random.Random(11)
    texts = [" ".join(r.choice(["Ab", "ab", "ab1", "x%", "éé", "The"]) for _ in range(400)), "x" * 500 + " a " + "y" * 700, "a b " + "é" * 300, ""]
    for t in texts:
        whole = task.distinct(pa.array([t]))
        for most in (7, 64, 301):
            blocks = list(tb.blocks(pa.array([t]), task.table, 3, most))
            keys = np.unique(np.concatenate([task.features(b, skip)[0] for b, skip in blocks]) & np.uint64((1 << 20) - 1))
            assert (keys == whole).all() and (len(blocks) > 1 or len(t) < 700 or "x" in t)


def test_span_hashes_in_blocks(monkeypatch):
    r = np.random.default_rng(12)
    buf = r.integers(0, 256, 5000).astype(np.uint8)
    starts = np.append(r.integers(0, 4900, 300), [0, 7])
    ends = np.append(starts[:300] + r.integers(0, 100, 300), [5000, 4000])
    whole = tb.span_hashes(buf, starts, ends)
    monkeypatch.setattr(tb, "BLOCK_BYTES", 256)
    assert (tb.span_hashes(buf, starts, ends) == whole).all()
    assert whole[300] == plain_hash(buf.tobytes())


def test_classifier_on_odd_rows(spark):
    docs, labels = corpus(spark)
    model = classify.train(docs, labels, "toxic", RARE)
    rows = [(i, t, 5.0, "x") for i, t in enumerate(ODD)] + [(0, None, 5.0, "x"), (None, "word", 1.0, "y")]
    got = classify.score(spark.createDataFrame(rows, "doc_id long, text string, SCORE double, lang string"), model).toPandas()
    assert len(got) == len(rows) and list(got.columns) == ["doc_id", "text", "lang", "score", "predicted"]
    assert got.score.between(0, 1).all() and got.score[0] == got.score[1] == got.score[len(ODD)] == pytest.approx(1 / (1 + math.exp(-model.bias)))
    assert got.score[len(ODD) + 1] == got.score[4]
    assert classify.score(docs.limit(0), model).count() == 0
    assert classify.train(docs, labels.limit(0), "toxic", RARE).bias == 0.0


def test_sample_of_labels_is_bounded(spark):
    docs, labels = corpus(spark)
    few = classify.Task(classify.toxicity_features, tb.ALNUM, RARE.learner, max_train_rows=60)
    one, two = (classify.train(d, labels, "toxic", few) for d in (docs, docs.repartition(7)))
    assert one.bias == two.bias and (one.index == two.index).all() and 0 < len(one.index) < len(classify.train(docs, labels, "toxic", RARE).index)


def test_quality_shapes():
    f = lambda t: set(classify.quality_features(pa.array([t]))[0].tolist())
    assert len(f("For For For") & f("Shti Shti Shti")) >= 4  # their shapes, and those of repeats
    assert f("") == set()


# --- licences ----------------------------------------------------------------------


def test_base_phrases_against_brute_force(spark):
    r = random.Random(2)
    bag = "cc by all rights reserved general public license Public nc the x2 é".split()
    texts = ODD + [r.choice([" ", ", ", "\n", "-"]).join(r.choice(bag) for _ in range(r.randrange(60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("Labels", F.lit("old"))
    got = licenses.scan(df).toPandas().set_index("doc_id").sort_index()
    assert "Labels" not in got.columns
    for i, t in enumerate(texts):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(t))
        places, labels = [], set()
        for phrase, label in licenses.BASE.items():
            k = phrase.split()
            found = [j for j in range(len(w) - len(k) + 1) if w[j : j + len(k)] == k]
            places += found
            labels |= {label} if found else set()
        row = got.loc[i]
        assert (row.n_words, row.n_base, row.base_labels) == (len(w), len(places), ",".join(sorted(labels)))
        assert (row.first_word, row.last_word) == (min(places), max(places)) if places else math.isnan(row.first_word) and math.isnan(row.last_word)
        assert labels <= set(row["labels"].split(",")) and 0 <= row.score <= 1
    assert licenses.scan(df.limit(0)).count() == 0


def test_templates_need_their_key_phrases(spark):
    texts = {
        "Licensed under the Apache License, Version 2.0 (x)": "apache-2.0",
        "licensed under that Apache License version 2.0": "apache-2.0",
        "licensed under the Apache Foundation version 2.0": "",
        "Released under the MIT License.": "mit",
        "released under the MIT rules": "",
        "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
    }
    df = spark.createDataFrame([(t,) for t in texts] + [("nothing here",)] * 30, "text string")
    got = {r.text: r["labels"] for r in licenses.scan(df).collect()}
    assert {t: got[t] for t in texts} == texts


def test_templates_against_every_place():
    r = random.Random(7)
    own = licenses.templates()
    assert max(len(t.words) for t in own) > 60
    texts = []
    for t in own * 12:
        words = list(t.words)
        for _ in range(r.randrange(0, max(2, len(words) // 3))):
            words[r.randrange(len(words))] = r.choice(["x", *t.words])
        texts.append(" ".join([*r.choices(own[r.randrange(len(own))].words, k=r.randrange(5)), *words, "end"]))
    held = [t.split() for t in texts]
    df = Counter(w for words in held for w in set(words))
    index = licenses.Index(own, df, len(texts), 0.8)
    idf = {w.decode(): x for w, x in zip(index.vocabulary, np.log((len(texts) + 1) / (np.array([df[w.decode()] for w in index.vocabulary]) + 1)) + 1e-3)}
    want = set()
    for d, words in enumerate(held):
        for k, t in enumerate(own):
            total = sum(idf[x] for x in t.words)
            for s in range(len(words) - len(t.words) + 1):
                agree = [a == b for a, b in zip(words[s:], t.words)]
                if all(a for a, m in zip(agree, t.must) if m) and (all(agree) if t.base else sum(idf[x] for x, a in zip(t.words, agree) if a) >= 0.8 * total):
                    want.add((k, d, s))
    w = tb.words(pa.array(texts), tb.ALNUM, lower=True)
    got = {(k, int(w.doc[s]), s - int(w.first[w.doc[s]])) for k, s, _ in index.scan(w, 0.8)}
    assert got == want and len(want) > len(texts) / 3


# --- html --------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="single">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies.</div><div id="ad">Buy</div>
%s<aside>Side</aside><section id="comments"><p>First comment, long enough to look like some text of its own, surely.</p></section><form><p>Name</p></form><footer>&copy; us"""


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>A &amp; B</h1><p>one\n two&nbsp;three<p><b>bold<br><p>x</article>", "A & B\none two three\nbold\nx"),
        ("<main><div class='content'><h2>Head</h2><p>Some longer text with many words in it, so that it counts.</p><ul><li>a<li>b</ul><p>.</p></div></main>", "Head\nSome longer text with many words in it, so that it counts.\na\nb\n."),
        ("<div><div><p>Some longer text with many words in it, so that it counts.</p><p>More of it, with as many words again as before.</p><p>No.</p></div><div class='sidebar'>x</div></div>", "Some longer text with many words in it, so that it counts.\nMore of it, with as many words again as before.\nNo."),
        ("<article><p>text<script>x</script> end</p><div class='share'>Tweet</div><table><tr><td>1<td>2</table></article>", "text end\n1\n2"),
    ],
)
def test_main_text(body, want):
    assert htmltext.main_text(PAGE % body) == want


A, B = ("Some longer text with many words in it, so that it counts.", "Another text, as long as the first one or longer, that counts too.")


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<article><p>{A}</p></article><article><p>{B}</p></article>", f"{A}\n{B}"),
        (f"<main><article><h2>1</h2><p>{A}</p></article><article><h2>2</h2><p>{B}</p></article></main>", f"1\n{A}\n2\n{B}"),
        (f"<article><p>{A}</p><p>{A}</p><p>{A}</p></article><article><p>{B}</p><p>{B}</p><p>{B}</p></article>", f"{A}\n{A}\n{A}\n{B}\n{B}\n{B}"),
        (f"<main><article><h2>1</h2><p>{A}</p><p>{A}</p><p>{A}</p></article><article><h2>2</h2><p>{B}</p><p>{B}</p></article></main>", f"1\n{A}\n{A}\n{A}\n2\n{B}\n{B}"),
        (f"<main><p>{A}</p><article><p>{B}</p></article></main>", f"{A}\n{B}"),
        (f"<main>{A} {A}<article><p>{B}</p><p>{B}</p></article></main>", f"{A} {A}\n{B}\n{B}"),
        (f"<article><p>{A}</p><p>{B}</p></article><div><a href='/'>{A}</a></div>", f"{A}\n{B}"),
    ],
)
def test_text_beside_an_article(body, want):
    assert htmltext.main_text(PAGE % body) == want


@pytest.mark.parametrize("name", ['class="layout has-sidebar"', 'id="content-with-ads"', 'class="page no-header"', 'class="widget"'])
def test_wrappers_named_like_boilerplate(name):
    side = "<div class='sidebar'><article><a href='/'>Other page</a></article></div><div id='comments'><article><p>Comment.</p></article></div><p class='share'>Tweet</p>"
    for body in (f"<article><p>{A}</p><p>{B}</p></article>", f"<main><div><p>{A}</p><p>{B}</p></div></main>", f"<div><p>{A}</p><p>{B}</p></div>"):
        plain = "" if "<div><p" in body and "main" not in body else side
        assert htmltext.main_text(PAGE % f"<div {name}>{body}{plain}</div>") == f"{A}\n{B}"
    assert htmltext.main_text(PAGE % f"<article><p>{A}</p></article><div {name.replace('widget', 'x')}><article><p>{B}</p></article></div>") == f"{A}\n{B}"


LINKS = "<ul>" + "".join(f"<li><a href='/{k}'>Page {k}</a></li>" for k in range(30)) + "</ul>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<article><header><h1>Title</h1></header><p>{A}</p></article>", f"Title\n{A}"),
        (f"<article><div class='article-header'><h1>Title</h1></div><p>{A}</p></article>", f"Title\n{A}"),
        (f"<main>{LINKS}<p>{A}</p><p>{B}</p></main>", f"{A}\n{B}"),
        (f"<main>{LINKS}</main>", "\n".join(f"Page {k}" for k in range(30))),
        (f"<article><p>{A} <a href='/'>Here</a> and <a href='/2'>there</a>, <a href='/3'>too</a>.</p><p>Yes.</p></article>", f"{A} Here and there, too.\nYes."),
        (f"<div class='content no-sidebar'><p>{A}</p><p>{B}</p></div>", f"{A}\n{B}"),
        (f"<div class='layout has-header'><p>{A}</p><p>{B}</p></div>", f"{A}\n{B}"),
        (f"<article><section><h2>1</h2><p>{A}</p><p>{A}</p></section><section><h2>2</h2><p>Short.</p></section></article>", f"1\n{A}\n{A}\n2\nShort."),
        (f"<div><p>{A}</p><p>{B}</p></div><div><p>{A}</p><p>{B}</p></div>", f"{A}\n{B}\n{A}\n{B}"),
    ],
)
def test_links_headers_and_ties(body, want):
    assert htmltext.main_text(PAGE % body) == want

TALK = "".join(f"<p>{A} {B} {A} {B}</p>" for _ in range(2))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<body><form id="aspnetForm"><article><p>{A}</p><p>{B}</p></article></form></body>', f"{A}\n{B}"),
        (f'<body><form id="aspnetForm"><div class="menu">Home</div><div><p>{A}</p><p>{B}</p></div><input></form></body>', f"{A}\n{B}"),
        (f"<body><div><p>{A}</p><p>{B}</p></div><form><p>Your name</p></form></body>", f"{A}\n{B}"),
        (f"<body><header><main><p>{A}</p><p>{B}</p></main></header><footer><p>{A}</p></footer></body>", f"{A}\n{B}"),
        (f'<body><div role="main"><div class="text"><p>{A} {B}</p></div><div class="replies">{TALK}</div></div></body>', f"{A} {B}"),
        (f'<body><div role="main"><div class="text"><p>{A} {B}</p></div><div class="responses">{TALK}</div></div></body>', f"{A} {B}"),
        (f'<body><div role="main"><div class="text"><p>{A} {B}</p></div><div class="talk">' + "".join(f'<div><span class="user">Ann</span><time>May</time>{TALK}</div>' for _ in range(3)) + "</div></div></body>", f"{A} {B}"),
        (f'<body><main><p>{A}</p><section><div class="author">By Ann</div><p>{B}</p></section></main></body>', f"{A}\nBy Ann\n{B}"),
        (f'<body><article><p>{A}</p><p>{B}</p></article><article class="card"><p>Next: {A} <a href="/">Read more</a></p></article></body>', f"{A}\n{B}"),
        (f'<body><article class="card"><p>{A}</p></article><article class="card"><p>{B}</p></article></body>', f"{A}\n{B}"),
        (f'<body><article><div class="masthead">Paper</div><p>{A}</p><div class="adslot">Buy</div><p>{B}</p><div class="cookiebar">Yes</div></article></body>', f"{A}\n{B}"),
    ],
)
def test_forms_replies_and_teasers(page, want):
    assert htmltext.main_text(f"<html><head><title>T</title></head>{page}</html>") == want


def test_markup_that_is_never_closed():
    began = time.perf_counter()
    assert htmltext.main_text("<span>" * 20_000 + "</b>" * 20_000 + "end") == "end"
    assert htmltext.main_text("<b><div>" + "<span>" * 20_000 + "</b>" * 20_000 + "end") == "end"
    assert htmltext.main_text("<p>" + "<i>" * 20_000 + "a" + "<p>" * 2_000 + "b") == "a\nb"
    assert htmltext.main_text("<li>" * 20_000 + "x" + "</ul>" * 20_000) == "x"
    assert time.perf_counter() - began < 6


def random_tree(r):
    """A page without boilerplate by name, as nested (tag, parts)."""
    words = lambda n: " ".join("".join(r.choice("abcdef") for _ in range(r.randrange(1, 8))) for _ in range(r.randrange(1, n)))

    def inline():
        return r.choice([words(12), words(30), words(4), ("b", [words(5)]), ("a", [words(6)]), ("a", [words(3)])])

    def block(depth):
        kind = r.choice(["p", "p", "p", "ul", "div", "section", "article", "div"] if depth < 4 else ["p", "ul"])
        if kind == "p":
            return "p", [inline() for _ in range(r.randrange(1, 5))]
        if kind == "ul":
            return "ul", [("li", [("a", [words(4)]) if r.random() < 0.6 else words(9)]) for _ in range(r.randrange(1, 7))]
        return kind, [words(9) if r.random() < 0.15 else block(depth + 1) for _ in range(r.randrange(1, 5))]

    return "body", [block(0) for _ in range(r.randrange(1, 6))]


def as_html(x):
    return x if isinstance(x, str) else f"<{x[0]}>{' '.join(map(as_html, x[1]))}</{x[0]}>"


def plain_content(body):
    """The rules of the module's docstring, each number counted anew."""
    nodes, parent = [], {}

    def visit(n):
        nodes.append(n)
        for x in n[1]:
            if not isinstance(x, str):
                parent[id(x)] = n
                visit(x)

    visit(body)
    inner = lambda n: [x for x in n[1] if not isinstance(x, str)]
    chars = lambda n: sum(len(x) if isinstance(x, str) else chars(x) for x in n[1])
    tags = lambda n: sum(1 + tags(x) for x in inner(n))
    link_chars = lambda n: chars(n) if n[0] == "a" else sum(map(link_chars, inner(n)))
    link_tags = lambda n: tags(n) + 1 if n[0] == "a" else sum(map(link_tags, inner(n)))
    share = link_chars(body) / chars(body) if chars(body) else 0

    def dense_text(c, t, lc, lt):
        base = math.log(c * lc / max(c - lc, 1) + share * c + math.e)
        return c / max(t, 1) * max(math.log(c * max(t, 1) / (max(lc, 1) * max(lt, 1))), 0) / base

    density = lambda n: dense_text(chars(n), tags(n), link_chars(n), link_tags(n)) if chars(n) else 0.0
    total = lambda n: sum(map(density, inner(n))) if any(map(density, inner(n))) else density(n)
    centre = max(nodes, key=total)
    path = [centre]
    while id(path[-1]) in parent:
        path.append(parent[id(path[-1])])
    threshold = min(map(density, path))
    containers = ("article", "section", "div", "body")
    articles = [n for n in path if n[0] == "article"]
    at = path.index(articles[-1]) if articles else next(k for k, n in enumerate(path) if n[0] in containers)
    for k in range(1, len(path)):
        gains = [x for x in path[k][1] if x is not path[k - 1]]
        ok = lambda x: dense_text(len(x), 0, 0, 0) >= threshold if isinstance(x, str) else density(x) >= threshold or x[0] == "article" and chars(x) >= max(1, 2 * link_chars(x))
        if path[k][0] in containers and threshold > 0 and any(map(ok, gains)):
            at = max(at, k)
    region = path[at]
    gone = []

    def links(n):
        if n is not region and n[0] in ("p", "ul", "li", "div", "section", "article") and link_tags(n) >= 3 and 3 * link_chars(n) >= 2 * chars(n) and density(n) < threshold:
            gone.append(n)
        else:
            for x in inner(n):
                links(x)

    links(region)
    if chars(region) <= sum(map(chars, gone)):
        gone = []
    lines, here = [], []

    def write(n):
        if any(n is g for g in gone):
            return
        edge = n[0] not in ("a", "b")
        if edge:
            lines.append(" ".join(here))
            here.clear()
        for x in n[1]:
            if isinstance(x, str):
                here.append(x)
            else:
                write(x)
        if edge:
            lines.append(" ".join(here))
            here.clear()

    write(region)
    return "\n".join(x for x in lines if x)


def test_main_text_against_a_plain_version():
    r = random.Random(21)
    shorter = 0
    for _ in range(400):
        tree = random_tree(r)
        want = plain_content(tree)
        assert htmltext.main_text(f"<html>{as_html(tree)}</html>") == want
        shorter += len(want) < len(re.sub("<[^>]*>", "", as_html(tree)).strip()) * 0.8
    assert 40 < shorter < 360  # the choice matters


def test_html_on_odd_rows(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<p>"), (4, "u", "plain &lt;b"), (5, "u", "<" * 50), (5, "u", "<" * 50), (6, "u", "<div>" * 3000 + "deep"), (7, "u", "<article></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("Text", F.lit("old"))
    got = htmltext.extract(df).toPandas()
    assert list(got.columns) == ["page_id", "url", "html", "text", "n_chars"] and len(got) == len(rows)
    by = dict(zip(got.page_id, got.text))
    assert (by[1], by[2], by[3], by[4], by[6], by[7]) == ("", "", "", "plain <b", "deep", "")
    assert (got.n_chars == got.text.str.len()).all()
    assert htmltext.extract(df.limit(0)).count() == 0


# --- sentencepiece -----------------------------------------------------------------


def test_long_runs_in_linear_time():
    coder = sentencepiece_fst.Encoder(sentencepiece_fst.Vocabulary.load(MODEL_PATH))
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    r, took = random.Random(4), {}
    for name, text in (("letter", "a" * 3_000_000), ("hundredth", "a" * 30_000), ("base64", "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=1_000_000)))):
        began = time.perf_counter()
        ids, at = coder.encode(pa.array([text, "b"]))
        took[name] = time.perf_counter() - began
        if name != "letter":
            assert ids[: at[1]].tolist() == sp.encode(text)
    assert took["letter"] < 300 * max(took["hundredth"], 0.05)


def test_transducer_matches_the_library_and_round_trips(spark):
    r = random.Random(3)
    alphabet = "aabc  e\n\tthinert;\r{}()▁éß中🙂̀=_-.0123"
    texts = ODD + ["  a", "a ", "\n\n", "re.\nErtion", "▁ x", "thethethe the the" * 300] + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(800)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("IDS", F.lit(1))
    coded = sentencepiece_fst.decode(sentencepiece_fst.encode(df, MODEL_PATH), MODEL_PATH).toPandas().sort_values("doc_id")
    assert list(coded.columns) == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    for t, ids, n, back in zip(texts, coded.ids, coded.n_tokens, coded.decoded):
        assert list(ids) == sp.encode(t or "") and n == len(ids)
        assert back == (t or "").replace("▁", " ")
    checked = sentencepiece_fst.encode(df, MODEL_PATH, check=True).toPandas().set_index("doc_id")
    assert all(checked.round_trip[i] == ("▁" not in (t or "")) for i, t in enumerate(texts))
    assert sentencepiece_fst.encode(df.limit(0), MODEL_PATH).count() == 0


def message(*fields):
    """A protocol-buffers message of (number, value)."""

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    out = b""
    for key, value in fields:
        if isinstance(value, float):
            out += number(key << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += number(key << 3) + number(value)
        else:
            out += number(key << 3 | 2) + number(len(value)) + value
    return out


def unigram_model(rules=b"", squeeze=0, lead=1):
    r = random.Random(4)
    words = sorted({"".join(r.choice("▁abcdé") for _ in range(r.randrange(1, 5))) for _ in range(300)} | set("▁abcd"))
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((w, -r.uniform(1, 12), 1) for w in words)]
    rows = [(1, message((1, p.encode()), (2, float(x)), (3, k))) for p, x, k in pieces]
    return message(*rows, (2, message((3, 1), (4, len(pieces)), (35, 1))), (3, message((1, b"own"), (2, rules), (3, lead), (4, squeeze), (5, 1))))


@pytest.mark.parametrize("rules", ["", "nmt_nfkc"])
@pytest.mark.parametrize(("squeeze", "lead"), [(0, 1), (1, 1), (1, 0)])
def test_unigram_model_and_normaliser_match_the_library(tmp_path, rules, squeeze, lead):
    charsmap = b""
    if rules:
        held = sentencepiece.SentencePieceNormalizer(rule_name=rules).serialized_model_proto()
        charsmap = dict(sentencepiece_fst._wire(dict(sentencepiece_fst._wire(held))[3]))[2]
    path = tmp_path / "own.model"
    path.write_bytes(unigram_model(charsmap, squeeze, lead))
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    encoder = sentencepiece_fst.Encoder(sentencepiece_fst.Vocabulary.load(str(path)))
    r = random.Random(5)
    texts = ["", " ", "a", "ａｂ ｃ", "ﬁ  abc", "½ e\u0301", "🙂ab", *("".join(r.choice("abcdé  \tx🙂ＡｂÅ") for _ in range(r.randrange(1, 40))) for _ in range(300))]
    ids, at = encoder.encode(pa.array(texts))
    for t, s, e in zip(texts, at, at[1:]):
        assert ids[s:e].tolist() == library.encode(t), t


def test_least_weight_against_all_paths():
    fst = sentencepiece_fst.Transducer(sentencepiece_fst.Vocabulary.parse(unigram_model()))

    def every(text, at=0):
        if at == len(text):
            yield 0.0, []
            return
        for piece, end, weight in fst.arcs(text, at):
            for rest, ids in every(text, end):
                yield weight + rest, [*([fst.bytes[b] for b in text[at].encode()] if piece < 0 else [piece]), *ids]

    r = random.Random(6)
    for _ in range(50):
        text = "".join(r.choice("▁abcdéx") for _ in range(r.randrange(1, 9)))
        assert fst.path(text) == min(every(text))[1]


def test_models_that_are_refused():
    for bad in (message((2, message((3, 3)))), message((1, message((1, b"x"), (3, 4))))):
        with pytest.raises(ValueError, match="only unigram"):
            sentencepiece_fst.Vocabulary.parse(bad)


def test_decode_of_bad_bytes_and_nulls(spark):
    df = spark.createDataFrame([([3 + 0xFF, 3 + 0x41],), ([],), (None,), ([0, 1, 2],)], "ids array<int>")
    assert [r.decoded for r in sentencepiece_fst.decode(df, MODEL_PATH).collect()] == ["�A", "", "", ""]
