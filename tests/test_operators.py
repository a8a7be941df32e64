"""Operators on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import molecules, text
from tessera.operators import columns, curate, metrics, ordering, records
from tessera.sources import readers


def test_first_present_is_case_sensitive(spark):
    df = spark.createDataFrame([("C",)], "smiles string")
    assert columns.first_present(df, columns.MOLECULE["training"]) == "smiles"
    with pytest.raises(ValueError, match="none of"):
        columns.first_present(df, ["SMILES"])


def test_row_id(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, " b "), (None, " "), (1.5, None)], "id double, image_id string")
    ids = lambda **k: [r.x for r in df.select(columns.row_id(df, ["id", "image_id"], F.lit(7), **k).alias("x")).collect()]
    assert ids() == ["1", "b", "7", "1.5"]
    assert ids(integers=False) == ["1.0", "b", "7", "1.5"]


def test_table_id_keeps_nulls(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b")], "image_id double, id string")
    assert [r.x for r in df.select(columns.table_id(df, ["image_id", "id"], F.lit(3)).alias("x")).collect()] == ["1", None]
    assert [r.x for r in df.select(columns.table_id(df, columns.IDENTIFIERS["evaluation"]).alias("x")).collect()] == ["1", None]
    with pytest.raises(ValueError, match="none of"):
        columns.table_id(df, ["Unnamed: 0"])
    assert columns.renamed(df, {"id": "key"}).columns == ["image_id", "key"]
    with pytest.raises(ValueError, match="none of"):
        columns.renamed(df, {"gone": "key"})


def test_resolved_files_prefers_the_path_itself(spark):
    asked = spark.createDataFrame([("a/x.gif",), ("a/y.png",), ("z",)], "file string")
    files = spark.createDataFrame([("a/x.gif",), ("a/x.png",), ("a/y.webp",), ("a/y.jpg",)], "path string")
    got = {r.file: r.resolved for r in columns.resolved_files(asked, "file", files, columns.ENDINGS["rl"]).collect()}
    assert got == {"a/x.gif": "a/x.gif", "a/y.png": "a/y.jpg", "z": None}
    both = spark.createDataFrame([("a.tif",), ("a.bmp",), ("b.JPG",), ("b.jpeg",)], "path string")
    asked = spark.createDataFrame([("a.gif",), ("b.gif",)], "file string")
    for kind, want in (("rl", {"a.gif": "a.tif", "b.gif": "b.jpeg"}), ("training", {"a.gif": "a.tif", "b.gif": "b.JPG"})):
        assert {r.file: r.resolved for r in columns.resolved_files(asked, "file", both, columns.ENDINGS[kind], skip_own=kind == "training").collect()} == want


def test_training_passes_over_the_ending_asked_for(spark):
    files = spark.createDataFrame([("a.PNG",), ("a.bmp",), ("b.JPG",), ("c.d/x.png",), (".png",), ("d/..e.tif",), ("f.png",)], "path string")
    asked = {"a.png": "a.bmp", "a.PnG": "a.bmp", "b.jpg": None, "b.JPG": "b.JPG", "c.d/x": "c.d/x.png", "d/..e.gif": "d/..e.tif", "f.gif": "f.png", ".gif": None, "g": None}
    got = columns.resolved_files(spark.createDataFrame([(a,) for a in asked], "file string"), "file", files, columns.ENDINGS["training"], skip_own=True)
    assert {r.file: r.resolved for r in got.collect()} == asked


def test_not_blank(spark):
    df = spark.createDataFrame([(" CC ",), ("\tC\n",), ("",), (" ",), (None,)], "s string")
    assert sorted(r.s for r in columns.not_blank(df, "s").collect()) == ["C", "CC"]


def test_ordinal_counts_all_rows(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("k"))
    got = ordering.ordinal(df, "k").collect()
    assert sorted((r.k, r.ordinal) for r in got) == [(i, i) for i in range(1000)]


def test_offsets_of_many_groups(spark):
    df = spark.range(500).select((F.col("id") % 37).alias("g")).union(spark.createDataFrame([(None,)], "g long"))
    got = {r.g: (r.n, r["first"]) for r in ordering.offsets(df, "g").collect()}
    want, at = {None: (1, 0)}, 1
    for g in range(37):
        n = len(range(g, 500, 37))
        want[g] = (n, at)
        at += n
    assert got == want


def test_shards_are_contiguous(spark):
    at = F.col("id")
    got = [r.s for r in spark.range(5).select(ordering.shard(at, F.lit(5), 4).alias("s")).orderBy("id").collect()]
    assert got == [0, 0, 1, 1, 2]


def test_sample_sizes(spark):
    df = spark.range(10)
    assert ordering.sample(df, 4, 1, "id").count() == 4
    assert ordering.sample(df, 40, 1, "id").count() == 10
    assert ordering.sample(df, 0, 1, "id", none_means_all=True).count() == 10
    assert {r.id for r in ordering.sample(df, 4, 1, "id").collect()} == {r.id for r in ordering.sample(df.repartition(3), 4, 1, "id").collect()}
    with pytest.raises(ValueError, match="positive"):
        ordering.sample(df, 0, 1, "id")


@pytest.mark.parametrize(("n", "want"), [(50, 49), (1, 0), (200, 100), (0, 0)])
def test_split_covers(spark, n, want):
    got = ordering.split(spark.range(n), 0.02, 100, 42, "id").collect()
    assert len(got) == n
    assert sum(r.part == "val" for r in got) == want


@pytest.mark.parametrize("block", [4, 8, 11, 1 << 16])
def test_next_valid_is_circular(spark, block):
    n, ahead, bad = 30, 4, {2, 3, 9, 20, 21, 22, 23, 24, 25, 29}
    df = spark.range(n).select(F.col("id"), F.when(~F.col("id").isin(list(bad)), F.col("id")).alias("v"))
    got = {r.id: r.replacement for r in ordering.next_valid(df, "id", F.col("v"), n, ahead, -1, block).collect()}
    want = {i: next(((i + k) % n for k in range(ahead + 1) if (i + k) % n not in bad), -1) for i in range(n)}
    assert got == want


def test_best_of_n_ties_and_order(spark):
    rows = [("a", 0, 0.5, "x"), ("a", 1, 0.9, "y"), ("a", 2, 0.9, "z"), ("b", 0, -0.2, ""), ("b", 1, -0.3, "q")]
    df = spark.createDataFrame(rows, "k string, i int, reward double, pred string")
    for order in (df, df.orderBy(F.desc("i")), df.repartition(3)):
        got = {r.k: (r.pred, r.reward) for r in curate.best(order, ["k"], F.col("i"), ["pred"]).collect()}
        assert got == {"a": ("y", 0.9), "b": ("", -0.2)}
    best = curate.best(df, ["k"], F.col("i"), ["pred"])
    assert [r.k for r in curate.accepted(best, -1.0).collect()] == ["a"]
    assert tuple(curate.funnel(best, -1.0).first()) == (2, 1, 0, 1, 0.9)
    low = spark.createDataFrame([("a", 0, -3.0, "x"), ("a", 1, -1.0, "y"), ("b", 0, None, "z")], "k string, i int, reward double, pred string")
    assert {tuple(r) for r in curate.best(low, ["k"], F.col("i"), ["pred", "i"]).collect()} == {("a", -1.0, "", None), ("b", -1.0, "", None)}
    assert curate.best(low, ["k"], F.col("i"), ["pred"], floor=None).filter("k = 'a'").first().pred == "y"


def test_compute_score(spark):
    rows = [("C C\n", '{"ground_truth": "CC"}'), ("", '{"ground_truth": "CC"}'), ("CC", "CC"), ("\nN", "CC"), ("CC", '{"x": 1}')]
    df = spark.createDataFrame(rows, "s string, t string")
    score = curate.compute_score(None, F.col("s"), F.col("t"), backend=molecules.Graph())
    assert [round(r.x, 9) for r in df.select(score.alias("x")).collect()] == [round(7.5 / 8.5, 9), 0.0, round(7.5 / 8.5, 9), round(0.5 / 8.5, 9), round(0.5 / 8.5, 9)]


def test_paired_rows_stand_at_one_place(spark):
    a = spark.createDataFrame([(0, "a"), (1, "b")], "ordinal int, x string")
    b = spark.createDataFrame([(1, "d"), (0, "c")], "ordinal int, y string")
    assert sorted(map(tuple, metrics.paired(a, b).collect())) == [(0, "a", "c"), (1, "b", "d")]
    for wrong in (b.limit(1), b.union(b.limit(1)), b.withColumn("ordinal", F.col("ordinal") + 1)):
        with pytest.raises(Exception, match="don't pair"):
            metrics.paired(a, wrong).collect()


def test_surviving_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), (None, 3)], "batch string, v int")
    assert sorted(map(repr, (tuple(r) for r in metrics.surviving(df, "batch", F.col("v") > 0).collect()))) == ["('a', 1)", "('b', 2)", "(None, 3)"]
    with pytest.raises(Exception, match="no valid row in batch b"):
        metrics.surviving(df, "batch", F.col("v") != 2).collect()
    assert metrics.surviving(df.limit(0), "batch", F.col("v") > 0).count() == 0


def test_rows_for_training_with_rewards(spark):
    default = text.DEFAULT_PROMPT
    rows = [
        (0, '[{"role": "user", "content": "<image>\\n a bb"}]', "x.png", "s", '{"ground_truth": "CC"}'),
        (1, '[{"content": "no mark"}]', "gone", None, "CN"),
        (2, '[{"role": "system", "content": "be brief "}, {"role": "user", "content": "<image> a b c d e f g h"}]', "x.png", "s", "{}"),
    ]
    df = spark.createDataFrame(rows, "index int, prompt string, image_path string, data_source string, reward_model string")
    files = spark.createDataFrame([("x.png", bytearray(b"img"))], "path string, content binary")
    encode = lambda c: F.transform(F.split(c, " "), lambda x: F.length(x))
    got = {r["index"]: r for r in records.rl_dataset(df, files, encode, 10, "left").collect()}
    assert got[0].raw_prompt == "<image>\n a bb" and got[0].raw_prompt_ids == [8, 1, 2] and got[0].input_ids == [0] * 7 + [8, 1, 2]
    assert got[0].attention_mask == [0] * 7 + [1] * 3 and got[0].position_ids == [0] * 7 + [0, 1, 2]
    assert (got[1].raw_prompt, got[1].data_source, got[1].ground_truth, bytes(got[1].content)) == (default, "unnamed", "CN", readers.blank_image())
    assert got[2].raw_prompt == "be brief <image> a b c d e f g h" and got[2].raw_prompt_ids == [5, 7, 1, 1, 1, 1, 1, 1, 1, 1][-10:]
    assert bytes(got[2].content) == b"img" and got[2].ground_truth == ""
    lost = {r["index"]: r for r in records.rl_dataset(df, files, encode, 20, image_id=8).collect()}
    assert lost[0].raw_prompt == "<image>\n a bb" and lost[2].raw_prompt == default
    with pytest.raises(Exception, match="longer than 4"):
        records.rl_dataset(df, files, encode, 4).collect()
    with pytest.raises(Exception, match="list of turns"):
        records.rl_dataset(df.withColumn("prompt", F.lit("{")), files, encode, 20).collect()


def test_random_replacement_without_valid_rows(spark):
    df = spark.range(6).select("id", F.col("id").alias("ordinal"))
    none = F.lit(None).cast("long")
    assert {r.replacement for r in ordering.random_replacement(df, "id", none, 1, strict=False).collect()} == {None}
    with pytest.raises(Exception, match="no valid row in 20 draws"):
        ordering.random_replacement(df, "id", none, 1).collect()


def test_rows_of_a_training_set(spark):
    df = spark.range(50)
    shuffled = [r.id for r in ordering.training_rows(df, None, 3, "dynamic", "id").collect()]
    assert sorted(shuffled) == list(range(50)) and shuffled != list(range(50))
    assert [r.id for r in ordering.training_rows(df, None, 3, "realistic", "id").collect()] == list(range(50))
    assert ordering.training_rows(df, 7, 3, "realistic", "id").count() == ordering.some_of(df, 7, 3, "id").count() == 7
    assert ordering.some_of(df, -1, 3, "id").count() == 50


def test_metrics_sentinel_and_empty_rule(spark):
    df = spark.createDataFrame([("x", "CC", "CC"), ("x", "", ""), ("y", "C@", "C"), ("y", None, None)], "g string, gold string, pred string")
    g, p = F.col("gold"), F.col("pred")
    got = {r.g: r for r in metrics.benchmark_metrics(df, ["g"], g, p, F.translate(g, "@", ""), F.translate(p, "@", "")).collect()}
    assert (got["x"].canon_smiles, got["x"].chiral, got["x"].num_samples) == (0.5, -1.0, 2)
    assert (got["y"].canon_smiles, got["y"].graph, got["y"].chiral) == (0.0, 0.5, 0.0)
    lenient = df.groupBy("g").agg(metrics.training_accuracy(g, p, F.col("g") == "x").alias("a"))
    assert {r.g: r.a for r in lenient.collect()} == {"x": 1.0, "y": None}


def test_latest_checkpoint(spark):
    df = spark.createDataFrame([("o/checkpoint-9",), ("o/checkpoint-10",), ("o/checkpoint-x",), ("o/checkpoint-1-2",)], "path string")
    assert metrics.latest_checkpoint(df, []).first().path == "o/checkpoint-10"
    assert metrics.latest_checkpoint(df.limit(0), []).first().path is None
    df = spark.createDataFrame([("o/global_step_9/actor",), ("o/global_step_10/actor",), ("o/global_step_11/critic",), ("o/global_step_12",)], "path string")
    assert tuple(metrics.latest_actor(df, []).first()) == ("o/global_step_10", 10)


def test_parameters(spark):
    rows = [("model.sam_model.w", 4, True), ("model.layers.0.norm.weight", 2, True), ("lm_head.bias", 1, True), ("extra", 8, False)]
    df = spark.createDataFrame(rows, "name string, numel long, requires_grad boolean")
    got = {(r.bucket, r.no_decay): (r.n_params, r.numel) for r in metrics.parameter_groups(df).collect()}
    assert got == {("vision", False): (1, 4), ("language", True): (2, 3)}
    assert {r.pattern: r.hits for r in metrics.pattern_hits(df, ["norm", "none"]).collect()} == {"norm": 1, "none": 0}
    assert metrics.trainable_share(metrics.frozen(df, ["model.layers.0."], ["sam"])).first().trainable == 1


def test_overrides_and_cadence(spark):
    base = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    over = spark.createDataFrame([("b", "3"), ("c", "4")], "key string, value string")
    assert {r.key: r.value for r in metrics.merged_overrides(base, over).collect()} == {"a": "1", "b": "3", "c": "4"}
    listed = [d.withColumn("at", F.monotonically_increasing_id()) for d in (base, over)]
    assert [r.key for r in metrics.merged_overrides(*listed, order="at").orderBy("place").collect()] == ["a", "b", "c"]
    steps = spark.range(0, 101, 25).filter(metrics.evaluates_at(F.col("id"), 25, 100))
    assert [r.id for r in steps.collect()] == [25, 50, 75]
    assert spark.range(0, 101, 50).filter(metrics.evaluates_at(F.col("id"), 50, 0)).count() == 2
