"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera import session
from tessera.llm import textbatch as tb

#: Rows that Spark hands to a Python worker at once; whole texts are long, and the
#: default of 10,000 rows fills the worker and the executor's buffers. The operators lower
#: the session's setting, as Spark reads it when a lazy result is run.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, to be read in small batches from now on."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that what
    follows neither recomputes it nor loses it with an executor."""
    return session.materialised(df)


def append(docs: DataFrame, fields: list[T.StructField], compute: Callable[[pa.RecordBatch], list], text: str = "text") -> DataFrame:
    """``docs`` with columns computed from slices of bounded size; a column of the
    same name (in any case) that was there before is replaced."""
    small_batches(docs.sparkSession)
    new = {f.name.lower() for f in fields}
    docs = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c.lower() not in new])
    schema = T.StructType(docs.schema.fields + fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, *compute(part)], names=names)

    return docs.mapInArrow(run, schema)
