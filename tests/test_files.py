"""Sources, sinks, settings and the log stream."""

import json
import struct
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.functions import images, jpeg
from tessera.plans import config
from tessera.sources import readers, writers
from tessera.streaming import logs


def test_csv_rules(spark, tmp_path):
    (tmp_path / "a.csv").write_text(',SMILES,note\n0,CC,"x, ""y"""\n1,NA,n/a\n2, C ,\n')
    df = readers.csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["Unnamed: 0", "SMILES", "note"]
    assert [tuple(r) for r in df.collect()] == [("0", "CC", 'x, "y"'), ("1", None, None), ("2", " C ", None)]
    (tmp_path / "empty.csv").write_text("")
    assert readers.csv(spark, str(tmp_path / "empty.csv")).columns == []


def test_merged(spark):
    a = spark.createDataFrame([("C", 1)], "smiles string, x int")
    b = spark.createDataFrame([(" C ",), ("",), (None,)], "smiles string")
    got = readers.merged({"a": a, "b": b, "c": b}, keep=[], molecule=["smiles"])
    assert sorted(map(tuple, got.collect())) == [("C", "a"), ("C", "b"), ("C", "c")]
    with pytest.raises(ValueError, match="no tables"):
        readers.merged({})


def test_discovered(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("Train_x.CSV", "sub/dev.csv", "sub/note.txt"):
        (tmp_path / name).write_text("a\n")
    assert [r.path.rsplit("/", 1)[1] for r in readers.discovered(spark, str(tmp_path)).collect()] == ["Train_x.CSV", "dev.csv"]
    assert readers.discovered(spark, str(tmp_path), ["train_X"]).count() == 1


def test_placeholder(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"img")
    files = readers.contents(spark, str(tmp_path), "*.png")
    here = files.first().path
    df = spark.createDataFrame([(here,), ("gone",)], "p string")
    assert {r.p: bytes(r.content) for r in readers.with_contents(df, "p", files, b"blank").collect()} == {here: b"img", "gone": b"blank"}


def test_sinks_replace_themselves(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "train")], "x int, part string")
    for _ in range(2):
        writers.split_parquet(df, str(tmp_path / "rl"))
        writers.csv_chunk(df, str(tmp_path / "pred"), 0)
    assert spark.read.parquet(str(tmp_path / "rl/train.parquet")).count() == 2
    assert spark.read.parquet(str(tmp_path / "rl/val.parquet")).count() == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "pred")).count() == 2
    assert writers.records(df.limit(1)).startswith("[\n")


def test_rendered(spark):
    tasks = spark.createDataFrame([("a", "CC"), ("b", ""), ("c", "C")], "image_path string, smiles string")
    done = spark.createDataFrame([("a",)], "path string")
    got = {r.image_path: r.status for r in writers.rendered(tasks, done, lambda batch: batch["smiles"] != "").collect()}
    assert got == {"a": "skipped_exists", "b": "failed", "c": "ok"}


def test_rl_rows(spark):
    df = spark.createDataFrame([("<image> hé", "i.png", "s", "CC")], "p string, i string, s string, t string")
    row = writers.rl_rows(df, "p", "i", "s", "t").first()
    assert row.prompt == '[{"role":"user","content":"<image> hé"}]'
    assert row.reward_model == '{"style":"rule","ground_truth":"CC"}'


@pytest.mark.parametrize("channels", [1, 3])
@pytest.mark.parametrize(("width", "height"), [(1, 1), (8, 8), (17, 13), (40, 33)])
def test_jpeg_of_whole_colours(channels, width, height):
    """With steps of one only rounding is lost, with and without restarts."""
    pixels = np.random.default_rng(width).integers(0, 256, (height, width, channels)).astype(np.uint8)
    for every in (0, 1, 3):
        w, h, back = jpeg.decoded_jpeg(jpeg.jpeg(pixels.tobytes(), width, height, channels, every=every))
        got = np.frombuffer(back, np.uint8).reshape(h, w, 3).astype(int)
        assert (w, h) == (width, height) and abs(got - pixels.astype(int)).max() <= 3


def test_jpeg_transform_and_colours():
    """Against sums written out: one coefficient a block, colours of half the resolution, steps."""
    cosine = lambda x, u: np.cos((2 * x + 1) * u * np.pi / 16)
    waves = np.array([[128 + 90 * cosine(x, 3) * cosine(y, 5) for x in range(8)] for y in range(8)]).round()
    _, _, back = jpeg.decoded_jpeg(jpeg.jpeg(waves.astype(np.uint8).tobytes(), 8, 8, step=40))
    assert abs(np.frombuffer(back, np.uint8)[::3].reshape(8, 8) - waves).max() <= 6
    y, x = np.mgrid[:33, :40]
    smooth = np.stack([4 * x + 2 * y, 2 * x + 5 * y, 250 - 3 * x - 3 * y], axis=2)
    _, _, back = jpeg.decoded_jpeg(jpeg.jpeg(smooth.astype(np.uint8).tobytes(), 40, 33, 3, halved=True, every=2))
    assert abs(np.frombuffer(back, np.uint8).reshape(33, 40, 3) - smooth).max() <= 6


def test_jpeg_refused():
    good = jpeg.jpeg(bytes(range(64)) * 9, 24, 24)
    for bad in (b"x", good[: good.index(b"\xff\xda")], good[:-30], good.replace(b"\xff\xc0", b"\xff\xc9"), b"\xff\xd8\xff\xd9"):
        with pytest.raises(ValueError, match="JPEG"):
            jpeg.decoded_jpeg(bad)
    with pytest.raises(ValueError, match="65535"):
        jpeg.jpeg(b"", 70000, 1)


def test_images_of_two_kinds(spark):
    rows = [("p", bytearray(images.png(bytes(range(60)), 4, 5, 3))), ("j", bytearray(jpeg.jpeg(b"\x40" * 6, 3, 2)))]
    got = {r.k: (r.width, r.height, bytes(r.pixels)) for r in images.decoded(spark.createDataFrame(rows, "k string, image binary"), "image").collect()}
    assert got == {"p": (4, 5, bytes(range(60))), "j": (3, 2, b"\x40" * 18)}


def test_blank_image_and_stored_images(spark):
    data = readers.blank_image(10, 3)
    assert data[:8] == b"\x89PNG\r\n\x1a\n" and int.from_bytes(data[16:20]) == 10 and int.from_bytes(data[20:24]) == 3
    at = data.index(b"IDAT") + 4
    assert zlib.decompress(data[at:-16]) == b"\0\xff\xff" * 3
    stored = lambda v: spark.createDataFrame([(v,)], "image struct<bytes: binary>").select(readers.stored_image(F.col("image.bytes")).alias("i")).first().i
    assert bytes(stored((bytearray(b"x"),))) == b"x"
    for none in ((None,), None):
        with pytest.raises(Exception, match="holds no image"):
            stored(none)


def test_png_filters_and_depths():
    r = np.random.default_rng(3)

    def stored(lines, width, height, bits, colour, filters, step, extra=b""):
        """A PNG whose lines are filtered by the kinds given."""
        body, before = b"", np.zeros(lines.shape[1], int)
        for y, line in enumerate(lines.astype(int)):
            left = np.concatenate([np.zeros(step, int), line[:-step]])
            corner = np.concatenate([np.zeros(step, int), before[:-step]])
            p = left + before - corner
            d = np.stack([abs(p - left), abs(p - before), abs(p - corner)])
            paeth = np.choose(d.argmin(axis=0), [left, before, corner])
            guess = [0, left, before, (left + before) // 2, paeth][filters[y]]
            body += bytes([filters[y]]) + ((line - guess) % 256).astype(np.uint8).tobytes()
            before = line
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"crc!"
        data = zlib.compress(body)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, 0)) + extra + chunk(b"IDAT", data[:9]) + chunk(b"IDAT", data[9:]) + chunk(b"IEND", b"")

    for colour, channels in ((0, 1), (2, 3), (4, 2), (6, 4)):
        pixels = r.integers(0, 256, (5, 7, channels)).astype(np.uint8)
        want = np.repeat(pixels[..., :1], 3, axis=2) if channels < 3 else pixels[..., :3]
        assert images.decoded_png(stored(pixels.reshape(5, -1), 7, 5, 8, colour, [0, 1, 2, 3, 4], channels)) == (7, 5, want.tobytes())
    deep = r.integers(0, 65536, (5, 7, 3))
    assert images.decoded_png(stored(np.stack([deep >> 8, deep & 255], axis=3).reshape(5, -1), 7, 5, 16, 2, [0, 1, 2, 3, 4], 6)) == (7, 5, (deep >> 8).astype(np.uint8).tobytes())
    palette = r.integers(0, 256, (4, 3)).astype(np.uint8)
    extra = struct.pack(">I", 12) + b"PLTE" + palette.tobytes() + b"crc!"
    of = r.integers(0, 4, (2, 5))
    packed = np.packbits(np.pad(np.stack([of >> 1, of & 1], axis=2).reshape(2, -1), ((0, 0), (0, 6))).astype(np.uint8), axis=1)
    assert images.decoded_png(stored(packed, 5, 2, 2, 3, [0, 0], 1, extra)) == (5, 2, palette[of].tobytes())
    assert images.decoded_png(readers.blank_image(10, 3)) == (10, 3, b"\xff" * 90)
    colours = bytes(range(60))
    assert images.decoded_png(images.png(colours, 4, 5, 3)) == (4, 5, colours)
    for bad in (b"x", readers.blank_image(1, 1).replace(b"\x01\x00\x00\x00\x00", b"\x10\x00\x00\x00\x00", 1)):
        with pytest.raises(ValueError, match="PNG"):
            images.decoded_png(bad)


@pytest.mark.parametrize(("width", "height"), [(1, 1), (3, 2), (5, 9), (8, 8), (17, 13)])
@pytest.mark.parametrize(("bits", "colour"), [(8, 0), (8, 2), (16, 6), (1, 0), (4, 0)])
def test_interlaced_png(width, height, bits, colour):
    """Seven passes, each stored like an image of its own; every pixel comes back to its place."""
    r = np.random.default_rng(width)
    channels = {0: 1, 2: 3, 6: 4}[colour]
    pixels = r.integers(0, 1 << bits, (height, width, channels))
    body = b""
    for x0, y0, dx, dy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)):
        own = pixels[y0::dy, x0::dx]
        if own.size:
            flat = own.reshape(own.shape[0], -1)
            digits = (flat[..., None] >> np.arange(bits)[::-1] & 1).reshape(own.shape[0], -1).astype(np.uint8)
            body += b"".join(b"\0" + line.tobytes() for line in np.packbits(digits, axis=1))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"crc!"
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, 1)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
    shown = pixels * 255 // ((1 << bits) - 1) if bits < 8 else pixels >> (bits - 8)
    want = np.repeat(shown, 3, axis=2) if channels == 1 else shown[..., :3]
    assert images.decoded_png(data) == (width, height, want.astype(np.uint8).tobytes())


def test_union_skips_empty_tables(spark):
    a, b = spark.range(0), spark.range(2)
    assert readers.not_empty([a, a]) is None
    assert readers.not_empty([a, b, b]).count() == 4


def test_json_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "x int, s string")
    writers.json_rows(df, str(tmp_path / "rows"))
    lines = [json.loads(x) for p in (tmp_path / "rows").glob("part-*") for x in p.read_text().splitlines()]
    assert sorted(lines, key=lambda r: r["x"]) == [{"x": 1, "s": "é"}, {"x": 2, "s": None}]
    writers.json_file(spark, str(tmp_path / "one.json"), {"a": "é"})
    assert (tmp_path / "one.json").read_text() == '{\n  "a": "é"\n}'
    writers.json_file(spark, str(tmp_path / "one.json"), writers.records(df))
    assert json.loads((tmp_path / "one.json").read_text())[0] == {"x": 1, "s": "é"}
    with pytest.raises(ValueError, match="over 1 rows"):
        writers.records(df, most=1)


def test_chunks_and_single_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 0), (2, 1)], "x int, chunk int")
    writers.csv_chunks(df, str(tmp_path / "c"), "chunk")
    writers.csv_chunks(df.filter("chunk = 1").withColumn("x", F.lit(9)), str(tmp_path / "c"), "chunk")
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "c")).selectExpr("int(x)", "chunk").collect()) == [(1, 0), (9, 1)]
    writers.csv(df.coalesce(1), str(tmp_path / "parts"))
    writers.only_file(spark, str(tmp_path / "parts"), str(tmp_path / "one.csv"))
    assert (tmp_path / "one.csv").read_text() == "x,chunk\n1,0\n2,1\n" and not (tmp_path / "parts").exists()


def test_renderer_is_made_on_the_executors(spark):
    tasks = spark.createDataFrame([("a", "CC"), ("b", "")], "image_path string, smiles string").coalesce(1)
    done = tasks.select(F.col("image_path").alias("path")).limit(0)

    def prepare():
        made = ["renderer"]
        return lambda batch: [bool(made and s) for s in batch["smiles"]]

    assert {r.image_path: r.status for r in writers.rendered(tasks, done, prepare=prepare).collect()} == {"a": "ok", "b": "failed"}


def test_shared_folder(spark, monkeypatch):
    assert session.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")

    class Cluster:
        class sparkContext:
            master = "spark://x"

            @staticmethod
            def getConf():
                return {}

    with pytest.raises(ValueError, match="executors share"):
        session.shared_folder(Cluster)


def test_training_settings():
    drawn = {"train_csv": "a.csv", "style": "s", "mol_augment": True, "include_condensed": False}
    got = config.training({"train_sets": [drawn], "learning_rate": 1e-4, "freeze_layers": [3, 1, 3]}, "/base")
    assert got.train_sets[0].train_csv == "/base/a.csv" and got.trainer == {"learning_rate": 1e-4}
    assert got.frozen_prefixes()[:3] == ["model.layers.1.", "layers.1.", "model.model.layers.1."] and len(got.frozen_prefixes()) == 6
    bad = [
        {"train_sets": []},
        {"train_sets": [{"train_csv": "a.csv"}]},
        {"train_sets": [drawn | {"data_mode": "?"}]},
        {"train_sets": [drawn | {"data_mode": "realistic"}]},
        {"train_sets": [drawn | {"data_mode": "pre_rendered"}]},
        {"train_sets": [drawn | {"sample_num": 0}]},
        {"train_sets": [{k: v for k, v in drawn.items() if k != "train_csv"}]},
        {"train_sets": [drawn], "enable_val_sets": True},
        {"train_sets": [drawn], "eval_every_steps": 0},
        {"train_sets": [drawn], "save_steps": -1},
    ]
    for values in bad:
        with pytest.raises(ValueError):
            config.training(values, "/")
    assert config.preparation({"datasets": [drawn]}, "/").val_ratio == 0.02
    for values in ({"datasets": []}, {"datasets": [drawn], "val_ratio": 1.0}, {"datasets": [drawn], "other": 1}):
        with pytest.raises(ValueError):
            config.preparation(values, "/")
    with pytest.raises(ValueError, match="shards"):
        config.curation({"shards": 0})
    assert config.applied(["run", "a.b=1", "c=2"], {"c": "3", "d.e": "4"}) == ["run", "a.b=1", "c=3", "d.e=4"]


def test_settings():
    got = config.evaluation({"benchmarks": [{"name": "a", "csv_path": "x.csv"}, {"name": "b", "csv_path": "/y.csv", "enabled": False}]}, "/base")
    assert [b.csv_path for b in got.benchmarks] == ["/base/x.csv", "/y.csv"]
    assert [b.name for b in config.selected(got.benchmarks, ["a", "unknown"])] == ["a"]
    with pytest.raises(ValueError, match="no benchmark"):
        config.selected(got.benchmarks, ["b"])
    for bad in ({"gpu_ids": [0, 0]}, {"token": "x"}, {"benchmarks": [{"name": "a", "csv_path": "x", "mode": "pre_rendered"}]}, {"benchmarks": [{"name": "a", "csv_path": "x", "mode": "?"}]}):
        with pytest.raises(ValueError):
            config.evaluation(bad, "/")
    assert [config.save_every(n) for n in (None, 30, 3000)] == [100, 10, 500]
    assert config.overrides({"hydra_cli_overrides": {"a.b": 1, "c.d": True}, "a.b": None, "e": 2}) == {"a.b": "null", "c.d": "true"}


def test_settings_files(spark, tmp_path, monkeypatch):
    values = {"name": "é: x", "none": None, "list": [1, 2.5, True], "nested": {"a": [{"b": "no"}]}}
    path = str(tmp_path / "conf/a.yaml")
    writers.settings_file(spark, path, values)
    assert readers.settings(spark, path) == values
    (tmp_path / "b.yaml").write_text("# a comment\nbenchmarks:\n  - name: a\n    csv_path: ../x.csv  # relative\ngpu_ids: [1, 2]\n")
    got = config.loaded(spark, str(tmp_path / "b.yaml"), config.evaluation)
    assert got.benchmarks[0].csv_path == str(tmp_path.parent / "x.csv") and got.gpu_ids == [1, 2] and got.seed == 3407
    for name, text in (("c.yaml", "- a\n"), ("d.yaml", "a: [1\n"), ("e.json", "{")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            readers.settings(spark, str(tmp_path / name))
    (tmp_path / "f.yaml").write_text("")
    assert readers.settings(spark, str(tmp_path / "f.yaml")) == {}
    with pytest.raises(ValueError, match="bytes"):
        readers.settings(spark, path, most=10)
    monkeypatch.setitem(sys.modules, "yaml", None)
    writers.settings_file(spark, path, values)
    assert readers.settings(spark, path) == values == json.loads(Path(path).read_text())


def test_resolved_paths():
    base = "hdfs://name:8020/conf/x"
    assert config.resolved("../a.csv", base) == "hdfs://name:8020/conf/a.csv"
    assert [config.resolved(p, base) for p in ("/a", "s3a://b/c", "file:/d")] == ["/a", "s3a://b/c", "file:/d"]
    assert config.resolved("a.csv", "") == "a.csv" and config.resolved("a.csv", "/base/./") == "/base/a.csv"


def test_log_stream(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log/a.txt").write_text("x\nstep:3 - critic/rewards/mean:0.5 - y\nstep:9 critic/rewards/mean:-1e-2\nTraining Progress: 5%|#| 2/40\nstep:abc\n")
    out = logs.progress(logs.tail(spark, str(tmp_path / "log")))
    q = out.writeStream.outputMode("complete").format("memory").queryName("progress_of_log").trigger(availableNow=True).start()
    q.awaitTermination()
    assert tuple(spark.table("progress_of_log").first()) == (9, -0.01, 40)


def test_advances(spark):
    df = spark.createDataFrame([("r", 1, 5), ("r", 2, 3), ("r", 3, 8)], "run string, o int, step int")
    assert [r.advance for r in logs.advances(df, "run", "o").orderBy("o").collect()] == [5, 0, 3]


def test_entry_imports_without_what_the_operators_need(tmp_path):
    code = "import sys; sys.modules['xxhash'] = None; import warnings; warnings.simplefilter('ignore'); import __spark_entry__ as e; q = e.queries(); assert 'reward_rl' in q and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)


def test_entry_imports_without_training_data_operators():
    import __spark_entry__ as e

    assert {"curate_best_of_n", "reward_rl"} <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_made_once_and_report(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([("ok",), ("failed",), ("skipped_exists",)], "status string")

    for _ in range(2):
        df = writers.made_once(spark, str(tmp_path / "index"), make)
    assert made == [1]
    assert tuple(writers.export_report(df, "a.csv", "a_x").first()) == ("a.csv", "a_x", 3, 2, 1)
    got = writers.next_phase({"sft": {"epochs": 2}, "instruction": "read", "x": 2}, "/c.csv", 3, "/model", "/out/")
    assert got["train_sets"] == [{"train_csv": "/c.csv", "data_mode": "realistic", "realistic_image_root": "/", "instruction": "read", "sample_num": None}]
    assert (got["epochs"], got["output_dir"], got["run_name"], got["pretrained_weight_path"]) == (2, "/out/checkpoints", "curation-iter3", "/model")
    assert config.training(got, "/").trainer["epochs"] == 2


def test_results_of_all_needs_every_result(spark):
    from tessera.operators import metrics

    names = spark.createDataFrame([("a",), ("b",)], "name string")
    got = spark.createDataFrame([("a", 1), ("b", 2)], "name string, x int")
    assert metrics.results_of_all(names, got).count() == 2
    with pytest.raises(Exception, match="no result for b"):
        metrics.results_of_all(names, got.limit(1)).collect()
    files = spark.createDataFrame([("s/1/config.json",), ("s/2/config.json",), ("s/3/other",)], "path string")
    assert metrics.newest_snapshot(files).first().folder == "s/2"


def test_augmentation_is_repeatable(spark):
    df = spark.createDataFrame([(k, bytearray(range(100)), 10, 10) for k in range(6)], "k int, pixels binary, width int, height int")
    style = images.Style(blur=1.0, noise=1.0, rotate=1.0)
    one, two = ({r.k: bytes(r.pixels) for r in images.augmented(d, "k", style, 3).collect()} for d in (df, df.repartition(3)))
    assert one == two and len(set(one.values())) == 6
    named = df.select(F.format_string("mol_%08d/image.png", "k").alias("k"), "pixels", "width", "height")
    assert len({bytes(r.pixels) for r in images.augmented(named, "k", style, 3).collect()}) == 6
    assert [r.x for r in df.limit(1).select(images.chosen_label(F.lit("drawn"), F.lit("asked"), True).alias("x"), images.chosen_label(F.lit("drawn"), F.lit("asked"), False).alias("y")).collect()] == ["drawn"]
    assert {bytes(r.pixels) for r in images.augmented(df, "k", images.Style(blur=0, noise=0, rotate=0), 3).collect()} == {bytes(range(100))}
    with pytest.raises(ValueError, match="none of"):
        images.Style("other")
