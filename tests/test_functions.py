"""Rules on hand-made rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import arrays, molecules, scoring, text


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'int'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [(" CC ", "CC"), ("\tC\n", "C"), ("", ""), (" C\x1f", "C"), (None, None)])
def test_strip(spark, raw, want):
    assert one(spark, text.strip(F.col("s")), s=raw) == want


def test_na(spark):
    for raw, want in (("NA", None), ("nan", None), ("", None), ("C", "C"), (None, None)):
        assert one(spark, text.na(F.col("s")), s=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("a b/c", "a_b_c"), ("__", "sample"), ("é-1", "é-1"), ("1.0", "1_0")])
def test_sanitised(spark, raw, want):
    assert one(spark, text.sanitised(F.col("s")), s=raw) == want
    assert one(spark, text.sanitised(F.lit("1.0"), "_.-")) == "1.0"


def test_candidates(spark):
    raw = " C C\nO</s> "
    assert one(spark, text.candidate_whole(F.col("s"), "</s>"), s=raw) == "C C\nO"
    assert one(spark, text.candidate_first_line(F.col("s"), "</s>"), s=raw) == "CC"
    assert one(spark, text.candidate_first_text(F.col("s")), s="\n \x1cC C\x1eO") == "CC"
    for rule in (text.candidate_whole, text.candidate_first_line, text.candidate_first_text):
        assert one(spark, rule(F.col("s")), s="  ") == ""
        assert one(spark, rule(F.col("s")), s=None) == ""


def test_wrapped(spark):
    assert one(spark, text.wrapped(F.lit("x" * 77))) == ["x" * 38, "x" * 38, "x"]
    assert one(spark, text.wrapped(F.lit(""))) == [""]
    assert one(spark, text.wrapped(F.lit("y" * 38))) == ["y" * 38]


def test_parts_and_prompt(spark):
    parts = text.content_parts(F.col("s"))
    assert [tuple(p) for p in one(spark, parts, s="a<image><image>b")] == [("text", "a"), ("image", None), ("image", None), ("text", "b")]
    assert one(spark, text.plain_prompt(parts), s="<image> hi ") == "<image> hi"
    assert one(spark, text.plain_prompt(parts), s="hi") == text.DEFAULT_PROMPT
    assert one(spark, text.plain_prompt(parts), s="") == text.DEFAULT_PROMPT


def test_turns_of_a_prompt(spark):
    turns = text.messages_of(F.col("s"))
    assert [tuple(t) for t in one(spark, turns, s='[{"role":"system","content":"x"},{"content":"a<image>"},{}]')] == [("system", "x"), ("user", "a<image>"), ("user", "")]
    assert one(spark, text.prompt_of(turns), s='[{"role":"system","content":"x "},{"content":"a<image>"}]') == "x a<image>"
    given = F.array(F.struct(F.lit(None).cast("string").alias("role"), F.col("s").alias("content")))
    assert one(spark, text.prompt_of(text.messages_in(given)), s="<image> b") == "<image> b"
    with pytest.raises(Exception, match="list of turns"):
        one(spark, turns, s="not json")


@pytest.mark.parametrize(("raw", "want"), [('{"ground_truth": "CC"}', "CC"), ('{"x": 1}', ""), ("CC", "CC"), ("[1]", "[1]"), ("12", "12")])
def test_ground_truth(spark, raw, want):
    assert one(spark, text.ground_truth(F.col("s")), s=raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("C" * 19, 0.0), ("C" * 20, 1.0), ("CCO" * 14, 1.0), ("Cl" * 13 + "Br", 26 / 28), ("N" + "C" * 10 + "abdefghijk", 10 / 21), ("ABC" * 8 + "CAB" * 8, 0.5), ("", 0.0), (None, 0.0), ("x" * 30000, 1.0)],
)
def test_penalty(spark, raw, want):
    assert one(spark, scoring.repetition_penalty(F.col("s")), s=raw) == pytest.approx(want)


def plain_penalty(s):
    n = len(s)
    if n < 20:
        return 0.0
    for p in range(1, 5):
        k = 0
        while s[k * p : k * p + p] == s[:p]:
            k += 1
        if n >= 12 * p and k >= 12:
            return min(1.0, k * p / n)
    runs, k = 1, 1
    for a, b in zip(s, s[1:]):
        k = k + 1 if a == b else 1
        runs = max(runs, k)
    return runs / n if runs / n > 0.3 else 0.5 if n > 30 and len(set(s)) <= 3 else 0.0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("CO\n😀", min_size=15, max_size=60), min_size=40, max_size=40))
def test_penalty_against_plain_loop(spark, values):
    got = spark.createDataFrame([(v,) for v in values], "s string").select("s", scoring.repetition_penalty(F.col("s")).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([plain_penalty(r.s) for r in got])


def test_rewards(spark):
    zero = {k: F.lit(0.0) for k in ("validity", "tanimoto", "canonical", "graph", "chiral")} | {"repetition": F.lit(1.0)}
    assert one(spark, scoring.reward(zero, scoring.RL_WEIGHTS, clamp=True)) == 0.0
    assert one(spark, scoring.reward(zero, scoring.CURATION_WEIGHTS, clamp=False)) == pytest.approx(-2 / 12)
    assert one(spark, scoring.reward(zero, scoring.Weights(0, 0, 0, 0, 0, 1), clamp=False)) == 0.0


def test_canonical_contracts(spark):
    described = F.struct(F.lit("bad").alias("text"), F.lit(None).cast("string").alias("canonical"))
    assert one(spark, molecules.canonical_for_evaluation(described)) == "bad"
    assert one(spark, molecules.canonical_for_reward(described)) == text.EMPTY
    assert one(spark, molecules.for_evaluation(F.lit("C/[R1]"))) == "C[1*]"
    assert one(spark, molecules.group_labels(F.lit("[R12]CC(=O)[NH2]"))) == "[12*]CC(=O)[NH2]"


def test_image_tokens(spark):
    assert one(spark, scoring.image_tokens(F.lit(1), F.lit(1))) == 257
    assert one(spark, scoring.image_tokens(F.lit(2), F.lit(3))) == 257 + 24 * 36


@pytest.mark.parametrize(("n", "want"), [(50, 49), (1, 0), (100_000, 2000), (3000, 100)])
def test_validation_size(spark, n, want):
    assert one(spark, scoring.validation_size(F.lit(n), 0.02, 100)) == want


def test_truncated(spark):
    ids = F.array(*[F.lit(i) for i in range(1, 8)])
    assert one(spark, arrays.truncated(ids, 5, "middle")) == [1, 2, 5, 6, 7]
    assert one(spark, arrays.truncated(ids, 5, "left")) == [3, 4, 5, 6, 7]
    assert one(spark, arrays.truncated(ids, 5, "right")) == [1, 2, 3, 4, 5]
    assert one(spark, arrays.truncated(ids, 7, "error")) == list(range(1, 8))
    with pytest.raises(Exception, match="longer than 5"):
        one(spark, arrays.truncated(ids, 5, "error"))


def test_sequence_and_labels(spark):
    ids = lambda *x: F.array(*[F.lit(i) for i in x])
    none = F.array().cast("array<int>")
    turns = F.array(F.struct(F.lit(arrays.USER).alias("role"), F.array(none, ids(5, 6)).alias("segments")), F.struct(F.lit(arrays.ASSISTANT).alias("role"), F.array(ids(7, 1)).alias("segments")))
    s = one(spark, arrays.sequence(turns, 0, 9, F.lit(2)))
    assert (s.ids, s.image_mask, s.prompt_count) == ([0, 9, 9, 5, 6, 7, 1], [False, True, True, False, False, False, False], 5)
    got = one(spark, arrays.labels(arrays.padded(ids(*s.ids), F.lit(9), 1), F.array(*[F.lit(m) for m in s.image_mask]), F.lit(s.prompt_count), 1))
    assert got == [-100] * 5 + [7, -100, -100, -100]
