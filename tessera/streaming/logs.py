"""A trainer's log as a stream of steps and rewards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Where a log line holds the step, the mean reward and the progress.
STEP, REWARD, PROGRESS = r"\bstep:([0-9]+)", r"critic/rewards/mean:(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)", r"Training Progress:.*\|\s*([0-9]+)/([0-9]+)"


def parsed(lines: DataFrame, line: Column | None = None) -> DataFrame:
    """(step, reward, done, total) of the lines that hold any; batch or stream."""
    line = F.col("value") if line is None else line
    out = lines.select(
        F.regexp_extract(line, STEP, 1).try_cast("bigint").alias("step"),
        F.regexp_extract(line, REWARD, 1).try_cast("double").alias("reward"),
        F.regexp_extract(line, PROGRESS, 1).try_cast("bigint").alias("done"),
        F.regexp_extract(line, PROGRESS, 2).try_cast("bigint").alias("total"),
    )
    return out.filter("step is not null or done is not null")


def progress(parsed_lines: DataFrame) -> DataFrame:
    """Streaming or batch: the largest step seen, and the reward there."""
    return parsed_lines.agg(F.max("step").alias("step"), F.max_by("reward", "step").alias("reward"), F.max("total").alias("total"))


def tail(spark: SparkSession, folder: str) -> DataFrame:
    return parsed(spark.readStream.text(folder))


def advances(parsed_lines: DataFrame, run: str, order: str, step: str = "step") -> DataFrame:
    """Batch: per run, how far each line moves the largest step seen so far."""
    before = F.max(step).over(Window.partitionBy(run).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return parsed_lines.withColumn("advance", F.greatest(F.col(step) - F.coalesce(before, F.lit(0)), F.lit(0)))


#: Into how many groups runs are dealt by their hash, which a started stream can't change; less than any step.
_GROUPS, _NONE = 1024, np.iinfo(np.int64).min + 1


def _moved(runs: pd.Series, steps: pd.Series, known: dict) -> np.ndarray:
    """How far each of the lines, in order, moves its run's largest step; ``known`` is brought up to date."""
    code, names = pd.factorize(runs, use_na_sentinel=False)
    names = [None if pd.isna(n) else n for n in names]
    there = steps.notna().to_numpy()
    s = np.full(len(steps), _NONE, np.int64)
    s[there] = steps[there].to_numpy().astype(np.int64)
    most = pd.Series(s).groupby(code).cummax()
    begun = np.array([known.get(n, _NONE) for n in names], np.int64)[code]
    before = np.maximum(most.groupby(code).shift(1, fill_value=_NONE).to_numpy(), begun)
    last = np.full(len(names), _NONE, np.int64)
    np.maximum.at(last, code, np.maximum(most.to_numpy(), begun))
    known.update((n, int(x)) for n, x in zip(names, last) if x != _NONE)
    return np.where(there, np.maximum(s - np.where(before == _NONE, 0, before), 0), 0)


def advancing(parsed_lines: DataFrame, run: str, order: str, step: str = "step") -> DataFrame:
    """Stream: ``advances``, line by line, with each run's largest step as its state across triggers
    and restarts. Lines of a run come in the order of their triggers, within one in that of ``order``.
    Runs are dealt to _GROUPS groups, whose lines are worked on together, as a call for each run costs more than its
    lines: a group's state is the largest step of each of its runs, and a task holds the lines that one trigger brings
    of one group, which the source's limits of files or bytes for each trigger bound. A run is told by its value as a
    string. A line without step moves nothing."""
    schema = T.StructType([*parsed_lines.schema.fields, T.StructField("advance", T.LongType())])
    given = parsed_lines.columns

    def move(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lines = pd.concat(list(batches), ignore_index=True).sort_values(order, ignore_index=True)
        known = dict(zip(*state.get)) if state.exists else {}
        moved = _moved(lines["_run"], lines[step], known)
        state.update((list(known), list(known.values())))
        yield lines[given].assign(advance=moved)

    dealt = parsed_lines.withColumn("_run", F.col(run).cast("string")).withColumn("_group", F.pmod(F.xxhash64(run), F.lit(_GROUPS)))
    return dealt.groupBy("_group").applyInPandasWithState(move, schema, "runs array<string>, most array<long>", "append", GroupStateTimeout.NoTimeout)
