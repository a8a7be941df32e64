"""Rows as a trainer of rewards reads them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import arrays, text
from tessera.sources import readers

def left_padded(ids: Column, width: int, pad: int) -> Column:
    return F.concat(F.array_repeat(F.lit(pad), F.greatest(F.lit(width) - F.size(ids), F.lit(0)).cast("int")), ids)


def rl_dataset(rows: DataFrame, files: DataFrame, encode: Callable[[Column], Column], max_prompt_length: int = 4096, truncation: str = "error", pad: int = 0, image_id: int | None = None, at: str = "index", source: str = "unnamed") -> DataFrame:
    """``rows`` (prompt, image_path, data_source, reward_model and the place ``at``) with what
    a rollout needs: raw_prompt, raw_prompt_ids, input_ids padded on the left to
    ``max_prompt_length``, attention_mask, position_ids, ground_truth and the image's content,
    which is a white image where the file is missing; rows without a data source get
    ``source``. ``encode`` gives a text's ids; ids
    without ``image_id`` are replaced by those of the default prompt."""
    held = rows.withColumn("raw_prompt", text.prompt_of(text.messages_of(F.col("prompt"))))
    held = held.withColumn("_ids", encode(F.col("raw_prompt")))
    if image_id is not None:
        lost = ~F.array_contains("_ids", image_id)
        held = held.withColumn("raw_prompt", F.when(lost, text.DEFAULT_PROMPT).otherwise(F.col("raw_prompt"))).withColumn("_ids", F.when(lost, encode(F.lit(text.DEFAULT_PROMPT))).otherwise(F.col("_ids")))
    ids = arrays.truncated(F.col("_ids"), max_prompt_length, truncation)
    missing = F.greatest(F.lit(max_prompt_length) - F.size("raw_prompt_ids"), F.lit(0))
    held = held.withColumn("raw_prompt_ids", ids).withColumn("input_ids", left_padded(F.col("raw_prompt_ids"), max_prompt_length, pad))
    held = held.withColumn("attention_mask", F.transform("input_ids", lambda _, i: (i >= missing).cast("int")))
    held = held.withColumn("position_ids", F.transform("input_ids", lambda _, i: F.greatest(i - missing, F.lit(0))))
    held = held.withColumn("data_source", F.coalesce("data_source", F.lit(source))).withColumn("ground_truth", text.ground_truth(F.col("reward_model")))
    return readers.with_contents(held, "image_path", files).select(at, "raw_prompt", "raw_prompt_ids", "input_ids", "attention_mask", "position_ids", "data_source", "ground_truth", "content")
