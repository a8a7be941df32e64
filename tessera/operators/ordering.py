"""Row ordinals and what follows from them: chunks, shards, samples, splits.

An ordinal over a whole table would bring it to one task if it were a window without
partitions.  ``ordinal`` sorts the table by ranges instead, counts each range and adds
the counts before it, of which there are as many as partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import session


def ordinal(df: DataFrame, *keys, name: str = "ordinal") -> DataFrame:
    """``df`` with its place (from 0) in the order of ``keys``, which should be unique."""
    return placed(df.repartitionByRange(*keys).sortWithinPartitions(*keys), name)


def placed(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """``df`` with its place (from 0) in the order that its rows already have."""
    low = (1 << 33) - 1
    placed = session.materialised(df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit(low))))
    counts = placed.groupBy("_part").agg(F.count("*").alias("n"))
    # One row for each partition.
    before = counts.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before")


def chunk(at: Column, size: int) -> Column:
    return F.floor(at / size)


def shard(at: Column, total: Column, shards: int) -> Column:
    """Contiguous shards of ceil(total / shards) rows; the last may be short or missing."""
    return F.floor(at / F.ceil(total / shards))


def round_robin(at: Column, k: int) -> Column:
    return at % k


def offsets(df: DataFrame, group: str) -> DataFrame:
    """(group, n, first): rows of each group and of all groups before it. Groups are sorted by
    ranges and summed in each, so there may be any number."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    placed = session.materialised(counts.repartitionByRange(group).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy("_part").agg(F.sum("n").alias("s"))
    # One row for each partition.
    before = sums.select("_part", (F.sum("s").over(Window.orderBy("_part")) - F.col("s")).alias("_before"))
    within = F.sum("n").over(Window.partitionBy("_part").orderBy(group)) - F.col("n")
    return placed.join(F.broadcast(before), "_part").select(group, "n", (within + F.col("_before")).alias("first"))


#: A histogram of keys has about 2**16 bins; a bin of this many rows isn't divided further.
_SMALL_BIN, _LEVELS = 1 << 16, 4


def _bins(df: DataFrame, key: str, level: int) -> Column:
    """A number that grows with the key: by two bytes of a text (those of the level), else by
    65,536 equal steps between the least and the largest value. A null, which sorts first, is -1."""
    kind = df.schema[key].dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        data = F.encode(key, "utf-8") if isinstance(kind, T.StringType) else F.col(key)
        byte = lambda at: F.coalesce(F.conv(F.nullif(F.hex(F.substring(data, at, F.lit(1))), F.lit("")), 16, 10).cast("int"), F.lit(-1)) + 1
        return F.when(F.col(key).isNull(), -1).otherwise(byte(2 * level + 1) * 257 + byte(2 * level + 2))
    number = F.unix_micros(F.col(key).cast("timestamp")) if isinstance(kind, (T.DateType, T.TimestampType)) else F.col(key)
    number = number.cast("double")
    plain = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    low, high = df.agg(F.min(plain), F.max(plain)).first()
    if low is None or low == high:
        step = F.when(number > F.lit(low), 2).when(number < F.lit(low), 0).otherwise(1) if low is not None else F.when(number > 0, 2).otherwise(0)
    else:
        # Infinities and NaN, which sorts last, lie outside.
        step = F.when(F.isnan(number) | (number > high), 65537).when(number < low, 0).otherwise(F.floor((number - low) / (high - low) * 65535) + 1)
    return F.when(F.col(key).isNull(), -1).otherwise(step.cast("int"))


def first_rows(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The first ``n`` rows by ``keys``, in no order. No task gets n rows: counts by bins of the first
    key tell which bin the n-th row is in; rows of lower bins are taken as they are, and only
    that bin, divided further while it is large, is sorted by ranges. The driver gets the bins' counts."""
    if n <= 0:
        return df.limit(0)
    here, taken = df, []
    for level in range(_LEVELS):
        bins = _bins(here, keys[0], level)
        counts = {r.b: r.n for r in here.select(bins.alias("b")).groupBy("b").agg(F.count("*").alias("n")).collect()}
        at = None
        for b in sorted(counts):
            if counts[b] > n:
                at = b
                break
            n -= counts[b]
        if at is None:
            return reduce(DataFrame.unionAll, [*taken, here])
        taken.append(here.filter(bins < at))
        here = here.filter(bins == at)
        if not n or counts[at] <= _SMALL_BIN:
            break
    if n:
        taken.append(ordinal(here, *keys, name="_place").filter(F.col("_place") < n).select(*[F.col(f"`{c}`") for c in df.columns]))
    return reduce(DataFrame.unionAll, taken)


def seeded(seed: int, *keys: Column) -> Column:
    """A key that shuffles rows the same way in every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def training_rows(df: DataFrame, n: int | None, seed: int, mode: str, *keys: str) -> DataFrame:
    """A training set's rows: ``n`` sampled ones, or all; all are shuffled only if images are
    made anew (mode ``dynamic``) and no number is given."""
    if n is None:
        return df.orderBy(seeded(seed, *[F.col(k) for k in keys]), *keys) if mode == "dynamic" else df
    return sample(df, n, seed, *keys)


def some_of(df: DataFrame, most: int, seed: int, *keys: str) -> DataFrame:
    """``most`` rows if there are more and it is positive, else all."""
    return sample(df, most, seed, *keys) if most > 0 else df


def sample(df: DataFrame, n: int | None, seed: int, *keys: str, none_means_all: bool = False) -> DataFrame:
    """Exactly ``n`` rows, or all if there are no more, in a seeded order of ``keys``."""
    if n is None or n == 0 and none_means_all:
        return df
    if n <= 0:
        raise ValueError("a sample needs a positive number of rows")
    keyed = df.withColumn("_seeded", seeded(seed, *[F.col(k) for k in keys]))
    return first_rows(keyed, n, "_seeded", *keys).orderBy("_seeded", *keys).drop("_seeded")


def split(df: DataFrame, ratio: float, at_least: int, seed: int, *keys: str, enabled: bool = True) -> DataFrame:
    """``df`` with ``part``: the last rows of a seeded order are ``val``, as many as
    min(max(at_least, floor(rows * ratio)), rows - 1); the others ``train``."""
    total = df.count()
    held = max(0, min(max(at_least, int(total * ratio)), total - 1)) if enabled and total > 1 else 0
    placed = ordinal(df.withColumn("_key", seeded(seed, *[F.col(k) for k in keys])), "_key", *keys)
    return placed.withColumn("part", F.when(F.col("ordinal") >= total - held, "val").otherwise("train")).drop("_key", "ordinal")


def next_valid(df: DataFrame, at: str, value: Column, total: int, ahead: int, fallback, block: int = 1 << 16) -> DataFrame:
    """``df`` with ``replacement``: the first value that isn't null among this row and the
    next ``ahead`` ones, past the end from the start, else ``fallback``.  Rows are dealt
    into blocks that also hold the rows ahead, so no task orders the whole table."""
    rows = df.withColumn("_value", value).withColumn("_block", F.floor(F.col(at) / block)).withColumn("_own", F.lit(True)).withColumn("_at", F.col(at).cast("bigint"))
    last = (total - 1) // block
    halo = rows.filter((F.col(at) % block < ahead) | (F.col(at) < ahead))
    into_before = halo.filter((F.col("_block") > 0) & (F.col(at) % block < ahead)).withColumn("_block", F.col("_block") - 1)
    wrapped = halo.filter(F.col(at) < ahead).withColumn("_at", F.col(at) + total).withColumn("_block", F.lit(last).cast("bigint"))
    # A last block shorter than the look-ahead is followed by the wrap within one block earlier.
    short = wrapped.withColumn("_block", F.lit(last - 1).cast("bigint")) if last > 0 and total % block < ahead and total % block else None
    every = rows
    for more in (into_before, wrapped, short):
        if more is not None:
            every = every.unionByName(more.withColumn("_own", F.lit(False)))
    w = Window.partitionBy("_block").orderBy("_at").rangeBetween(0, min(ahead, total - 1))
    return every.withColumn("replacement", F.coalesce(F.first("_value", ignorenulls=True).over(w), F.lit(fallback))).filter("_own").drop("_value", "_block", "_own", "_at")


def random_replacement(df: DataFrame, key: str, value: Column, seed: int, tries: int = 20, total: int | None = None, strict: bool = True) -> DataFrame:
    """``df`` (with ``ordinal`` from 0) with ``replacement``: the row's value, or where it
    is null that of the first valid row among ``tries`` drawn at random (the same in every
    run). A row that draws none is an error, or null if not ``strict``. Rows without a value
    are joined with the rows that they draw."""
    n = df.count() if total is None else total
    rows = df.withColumn("_v", value)
    draw = F.transform(F.sequence(F.lit(0), F.lit(tries - 1)), lambda k: (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), k.cast("string"))), 1, 8), 16, 10).cast("bigint") % n))
    asked = rows.filter("_v is null").select(F.col(key).alias("_key"), F.posexplode(draw).alias("_k", "ordinal"))
    found = asked.join(rows.filter("_v is not null").select("ordinal", "_v"), "ordinal").groupBy("_key").agg(F.min_by("_v", "_k").alias("_drawn"))
    none = F.raise_error(F.concat(F.lit(f"no valid row in {tries} draws for "), F.col(key).cast("string"))).cast(rows.schema["_v"].dataType)
    replacement = F.coalesce("_v", "_drawn", *[none] * strict)
    return rows.join(found, rows[key] == found["_key"], "left").withColumn("replacement", replacement).drop("_v", "_key", "_drawn")
