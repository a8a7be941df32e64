"""Selection by counts, counters of one pass, state across triggers, files written by tasks."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import columns, ordering
from tessera.sources import readers, writers
from tessera.streaming import logs

KEYS = {
    "string": ["", "a", "ab", "abc", "b\x00", "é", "\U0001f600", "zz", None, "a" * 9, "abd"],
    "long": [0, -5, 7, 2**62, -(2**62), None, 1, 2, 3],
    "double": [0.5, -1.0, math.inf, -math.inf, math.nan, None, 3.25, 1e300],
    "int": [4, 4, 4],
    "date": [datetime.date(2020, 1, k) for k in range(1, 9)] + [None],
    "binary": [b"", b"\xff", b"\x00\x01", None],
}


@pytest.mark.parametrize("kind", KEYS)
@pytest.mark.parametrize("small", [1 << 16, 2])
def test_first_rows(spark, kind, small, monkeypatch):
    monkeypatch.setattr(ordering, "_SMALL_BIN", small)
    r = random.Random(3)
    rows = [(r.choice(KEYS[kind]), k) for k in range(60)]
    df = spark.createDataFrame(rows, f"key {kind}, id int").repartition(5)
    order = [(x.key, x.id) for x in df.coalesce(1).sortWithinPartitions("key", "id").collect()]
    shown = lambda rows: sorted(map(repr, rows))
    for n in (0, 1, 7, 30, 59, 60, 99):
        assert shown((x.key, x.id) for x in ordering.first_rows(df, n, "key", "id").collect()) == shown(order[:n]), n
    assert ordering.first_rows(df.limit(0), 5, "key", "id").count() == 0


def test_no_task_gets_all_rows_of_a_sample(spark):
    df = spark.range(20_000).withColumn("x", F.col("id") % 97)
    got = ordering.sample(df, 9_000, 5, "id")
    want = df.orderBy(F.md5(F.concat(F.lit("5:"), F.col("id").cast("string"))), "id").limit(9_000)
    assert [r.id for r in got.collect()] == [r.id for r in want.collect()]
    plan = got._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" not in plan and "GlobalLimit" not in plan
    assert [r.id for r in readers.slice_of(df, 50, "x", "id").collect()] == [r.id for r in df.orderBy("x", "id").limit(50).collect()]


def test_counters_come_with_the_pass_that_filters(spark):
    asked = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), (None, "y")], "file string, source string")
    files = spark.createDataFrame([("a",), ("a",), ("c",)], "path string")
    rows, seen = columns.existing_counted(asked, "file", files, {s: F.col("source") == s for s in "xy"})
    assert rows.columns == asked.columns
    assert sorted(map(tuple, rows.collect())) == [("a", "x"), ("c", "y")]
    assert seen.get == {"found": 2, "skipped": 2, "x_found": 1, "x_skipped": 1, "y_found": 1, "y_skipped": 1}
    kept, seen = columns.counted(asked, F.col("file") > "a")
    assert kept.count() == 2 and seen.get == {"found": 2, "skipped": 2}


def test_counting_reads_a_table_once(spark, tmp_path):
    spark.range(100).selectExpr("concat(id, '.png') file").write.parquet(str(tmp_path / "t"))
    rows, seen = columns.existing_counted(spark.read.parquet(str(tmp_path / "t")), "file", spark.createDataFrame([("3.png",)], "path string"))
    assert rows._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    assert rows.count() == 1 and seen.get == {"found": 1, "skipped": 99}


def test_steps_across_triggers_and_restarts(spark, tmp_path):
    r = random.Random(8)
    rows = [(r.choice("abc"), k, r.choice([None, k // 2, k, -3, r.randrange(300)])) for k in range(240)] + [("d", 240, None), ("d", 241, -2), ("d", 242, -1), ("d", 243, 4)]
    lines = spark.createDataFrame(rows, "run string, at long, step long")
    for k in range(4):
        lines.filter((F.col("at") >= k * 61) & (F.col("at") < (k + 1) * 61)).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = logs.advancing(spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in")), "run", "at")
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = logs.advances(lines, "run", "at")
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_replayed_batch_adds_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    for number in (0, 1, 0, 1):
        writers.csv_batch(df, str(tmp_path / "t"), number)
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).count() == 4


def test_files_are_whole_and_written_once(spark, tmp_path):
    tasks = spark.createDataFrame([(k, f"{tmp_path}/deep/er/{k}.bin") for k in range(40)], "k int, image_path string").repartition(4)
    none = tasks.select(F.col("image_path").alias("path")).limit(0)

    def draw(batch):
        return [None if k % 7 == 0 else bytes([k]) * 5000 for k in batch["k"]]

    first = {r.k: r.status for r in writers.rendered(tasks, none, writers.saving(draw)).collect()}
    assert first == {k: "failed" if k % 7 == 0 else "ok" for k in range(40)}
    again = {r.k: r.status for r in writers.rendered(tasks, none, writers.saving(draw)).collect()}
    assert again == first  # a second attempt puts the same files there
    files = {p.name: p.read_bytes() for p in (tmp_path / "deep/er").iterdir() if not p.name.endswith(".crc")}
    assert files == {f"{k}.bin": bytes([k]) * 5000 for k in range(40) if k % 7}
    there = readers.manifest(spark, f"{tmp_path}/deep").select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    assert {r.k: r.status for r in writers.rendered(tasks, there, writers.saving(draw)).collect()} == {k: "failed" if k % 7 == 0 else "skipped_exists" for k in range(40)}
    assert writers.put_file(f"file://{tmp_path}/x.bin", b"a") and (tmp_path / "x.bin").read_bytes() == b"a"


def test_runs_of_a_stream_share_calls(spark, tmp_path, monkeypatch):
    """However many runs there are, a trigger makes a bounded number of calls and states."""
    monkeypatch.setattr(logs, "_GROUPS", 2)
    r = random.Random(4)
    rows = [(r.choice([None, *range(50)]), k, r.choice([None, k, -k, r.randrange(500)])) for k in range(600)]
    lines = spark.createDataFrame(rows, "run long, at long, step long")
    for k in range(3):
        lines.filter(F.floor(F.col("at") / 200) == k).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        stream = logs.advancing(spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in")), "run", "at")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, logs.advances(lines, "run", "at").collect()))
