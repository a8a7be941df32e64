"""Tables from files, with schemas given and not inferred."""

from __future__ import annotations

import json
import struct
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import text
from tessera.operators import columns, ordering


def as_list(value) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.option("header", False).csv(path).limit(1).collect()
    names = [v or "" for v in first[0]] if first else []
    return [n or f"Unnamed: {k}" for k, n in enumerate(names)]


def csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file or folder as strings; the strings that stand for a missing value are
    null, a column without name is ``Unnamed: i``, an empty file has no columns."""
    names = _header(spark, path)
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.select(*[text.na(F.col(f"`{n}`")).alias(n) for n in names])


def settings(spark: SparkSession, path: str, most: int = 1 << 20) -> dict:
    """A file of settings, by the path's own file system: YAML, or JSON by its ending and where the
    ``yaml`` library is missing. An empty file has none; over ``most`` bytes, another thing than
    names with values, and a file that can't be read as either are a ``ValueError``."""
    files = spark.read.format("binaryFile").load(path)
    if any(r.length > most for r in files.select("length").collect()):
        raise ValueError(f"{path} has over {most} bytes")
    held = files.select("content").first()  # nothing where the file is empty
    body = bytes(held.content).decode() if held else ""
    try:
        import yaml
    except ImportError:
        yaml = None
    if yaml and not path.lower().endswith(".json"):
        try:
            values = yaml.safe_load(body)
        except yaml.YAMLError as wrong:
            raise ValueError(f"{path} isn't YAML: {wrong}") from wrong
    else:
        values = json.loads(body) if body.strip() else None
    if not isinstance(values, dict | None):
        raise ValueError(f"{path} doesn't hold names with values")
    return values or {}


def discovered(spark: SparkSession, root: str, keywords: list[str] | None = None) -> DataFrame:
    """CSV files under ``root`` (any case of the ending) whose path holds a keyword."""
    files = manifest(spark, root).filter(F.lower("path").endswith(".csv"))
    if keywords:
        files = files.filter(text.contains_any(F.lower("path"), [k.lower() for k in keywords]))
    return files.orderBy("path")


def manifest(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, length, modificationTime) of the files under ``root``; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length", "modificationTime")


def contents(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "content")


def with_contents(df: DataFrame, path: str, files: DataFrame, placeholder: bytes | None = None) -> DataFrame:
    """``df`` with each file's bytes, the placeholder (a white image) where the file is
    missing."""
    held = files.select(F.col("path").alias(path), "content")
    return df.join(held, path, "left").withColumn("content", F.coalesce("content", F.lit(blank_image() if placeholder is None else placeholder)))


def blank_image(width: int = 768, height: int = 768) -> bytes:
    """A white image, as a PNG of one bit a pixel, for rows whose file is missing."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    line = b"\0" + b"\xff" * -(-width // 8)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 1, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(line * height, 9)) + chunk(b"IEND", b"")


def stored_image(c: Column) -> Column:
    """The bytes of an image column, which holds them plainly or as a struct's ``bytes``;
    a row without any is an error. ``functions.images.decoded`` reads PNGs and JPEGs."""
    return F.coalesce(c, F.raise_error(F.lit("a row holds no image")).cast("binary"))


def not_empty(frames: list[DataFrame]) -> DataFrame | None:
    """The tables with rows below each other; null if none has any."""
    out = None
    for df in frames:
        if not df.isEmpty():
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def merged(frames: dict[str, DataFrame], keep: list[str] | None = None, molecule: list[str] | None = None) -> DataFrame:
    """All tables below each other with ``source_csv``; columns that a table lacks are
    null, and if ``molecule`` is given, rows without one go. Repeated rows stay."""
    if not frames:
        raise ValueError("no tables to merge")
    out = None
    for name, df in frames.items():
        own = df.withColumn("source_csv", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    found = columns.first_present(out, molecule) if molecule else None
    if found:
        out = columns.not_blank(out, found)
    return columns.pruned(out, [*keep, "source_csv", *([found] if found else [])]) if keep is not None else out


def by_ending(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Parquet and JSON files below each other."""
    out = None
    for path in as_list(paths):
        ending = path.rstrip("/").rsplit(".", 1)[-1].lower()
        if ending not in ("parquet", "json", "jsonl"):
            raise ValueError(f"{path}: neither parquet nor json")
        df = spark.read.parquet(path) if ending == "parquet" else spark.read.option("multiLine", ending == "json").json(path)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no files")
    return out


def slice_of(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first ``n`` rows in the order of ``keys``."""
    return ordering.first_rows(df, n, *keys).orderBy(*keys)
