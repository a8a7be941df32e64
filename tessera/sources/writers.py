"""Sinks that can be run again without harm."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterable

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import DEFAULT_PROMPT


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def csv_chunk(df: DataFrame, path: str, chunk: int) -> None:
    """One chunk of a table; written again it replaces itself."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/chunk={chunk}")


def csv_chunks(df: DataFrame, path: str, chunk: str) -> None:
    """All chunks of a table at once; those that are there are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(chunk).option("header", True).option("escape", '"').csv(path)


def append_batches(stream: DataFrame, path: str, state: str, once: bool = True):
    """Starts a stream that adds each of its batches to a CSV table. A batch is a folder named by its
    number, written as a whole, so one that is replayed after a failure replaces itself."""
    started = stream.writeStream.foreachBatch(lambda batch, number: csv_batch(batch, path, number)).option("checkpointLocation", state)
    return (started.trigger(availableNow=True) if once else started).start()


def csv_batch(batch: DataFrame, path: str, number: int) -> None:
    batch.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/batch={number}")


def only_file(spark: SparkSession, folder: str, path: str) -> None:
    """Moves the first part of a written table to a file of its own name, which other
    programs expect, and drops the folder; for tables of one part."""
    at, to = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (folder, path))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [x.getPath() for x in fs.listStatus(at) if x.getPath().getName().startswith("part-")]
    if len(parts) != 1:
        raise ValueError(f"{folder} has {len(parts)} parts; coalesce small tables to one")
    fs.rename(parts[0], to)
    fs.delete(at, True)


def split_parquet(df: DataFrame, path: str, part: str = "part") -> None:
    """``train`` and ``val`` as tables of their own, both even if one has no rows."""
    for name in ("train", "val"):
        df.filter(F.col(part) == name).drop(part).write.mode("overwrite").parquet(f"{path}/{name}.parquet")


def json_rows(df: DataFrame, path: str) -> None:
    """A table of any size as JSON lines, one object each; nulls are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def records(df: DataFrame, most: int = 10_000) -> str:
    """A table of a few metric rows as JSON text; ``json_rows`` writes larger ones."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows; write them with json_rows")
    return json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, indent=2)


def settings_file(spark: SparkSession, path: str, content: dict) -> None:
    """Settings as one YAML file in their own order, by the path's own file system; as JSON, which
    readers of YAML take too, where the ``yaml`` library is missing."""
    try:
        import yaml
    except ImportError:
        return json_file(spark, path, content)
    return json_file(spark, path, yaml.safe_dump(content, allow_unicode=True, sort_keys=False))


def json_file(spark: SparkSession, path: str, content) -> None:
    """A few metrics as one JSON file, indented, by the path's own file system; text as it is."""
    body = content if isinstance(content, str) else json.dumps(content, ensure_ascii=False, indent=2)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(body.encode()))
    out.close()


def rl_rows(df: DataFrame, prompt: str, image: str, source: str, truth: str) -> DataFrame:
    """The four string columns that the trainer reads."""
    return df.select(
        F.to_json(F.array(F.struct(F.lit("user").alias("role"), F.col(prompt).alias("content")))).alias("prompt"),
        F.col(image).alias("image_path"),
        F.col(source).alias("data_source"),
        F.to_json(F.struct(F.lit("rule").alias("style"), F.col(truth).alias("ground_truth"))).alias("reward_model"),
    )


def rendered(tasks: DataFrame, done: DataFrame, render=None, path: str = "image_path", prepare=None) -> DataFrame:
    """``tasks`` with a status: skipped_exists where the file is in the manifest ``done``;
    else ``render(batch)`` tells for each row of a pandas batch whether it is ok or failed, on the executors.
    ``prepare() -> render`` makes it there, once for each task, if it is costly to make. ``saving``
    makes a renderer that writes files. Store the result if it is used more than once."""
    have = done.select(F.col("path").alias(path)).distinct()
    skipped = tasks.join(have, path, "left_semi").withColumn("status", F.lit("skipped_exists"))
    todo = tasks.join(have, path, "left_anti")

    def run(batches):
        draw = prepare() if prepare else render  # once for each task
        for pdf in batches:
            yield pdf.assign(status=["ok" if made else "failed" for made in draw(pdf)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in todo.schema.fields) + ", status string"
    return skipped.select(*todo.columns, "status").unionByName(todo.mapInPandas(run, schema))


def saving(draw: Callable[[pd.DataFrame], Iterable[bytes | None]], path: str = "image_path"):
    """A renderer for ``rendered``: writes what ``draw`` makes of a batch's rows, an image's bytes or nothing, each to
    its row's path on the file system that tasks share."""
    return lambda batch: [data is not None and put_file(name, data) for name, data in zip(batch[path], draw(batch))]


def put_file(path: str, data: bytes) -> bool:
    """Writes a file under another name in its folder, then renames it, so it is there whole or not at all. A second
    attempt of the same task, after a failure or at the same time, puts the same file there again."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pyarrow.fs.LocalFileSystem(), path)
    folder, name = posixpath.split(at)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(part) as out:
        out.write(data)
    try:
        fs.move(part, at)
    except OSError:  # some file systems don't rename onto a file
        fs.delete_file(part)
        return fs.get_file_info(at).type == pyarrow.fs.FileType.File
    return True


def made_once(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made and written only if its completion mark is missing.
    The mark is looked up with the path's own file system."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def export_report(index: DataFrame, csv_path: str, output_dir: str) -> DataFrame:
    """One row: how many images of an index (status) were saved and how many failed."""
    return index.agg(
        F.count("*").alias("total_rows"),
        F.count_if(F.col("status").isin("ok", "skipped_exists")).alias("saved_images"),
        F.count_if(F.col("status") == "failed").alias("failed_images"),
    ).select(F.lit(csv_path).alias("csv_path"), F.lit(output_dir).alias("output_dir"), "*")


def next_phase(base: dict, curated_csv: str, iteration: int, model_path: str, output_dir: str) -> dict:
    """Settings of the training that follows a curation: its table is the only set, with
    absolute paths, and is sampled whole; there are no validation sets. What ``base`` says of
    the training itself, under ``sft``, is kept."""
    rows = {"train_csv": curated_csv, "data_mode": "realistic", "realistic_image_root": "/", "instruction": base.get("instruction", DEFAULT_PROMPT), "sample_num": None}
    kept = {k: v for k, v in base.get("sft", {}).items()}
    return {
        **kept,
        "pretrained_weight_path": model_path,
        "train_sets": [rows],
        "enable_val_sets": False,
        "val_sets": [],
        "seed": base.get("seed", 3407),
        "freeze_layers": base.get("freeze_layers", []),
        "freeze_modules": base.get("freeze_modules", []),
        "output_dir": f"{output_dir.rstrip('/')}/checkpoints",
        "run_name": f"{base.get('run_name', 'curation')}-iter{iteration}",
    }
