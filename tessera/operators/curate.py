"""Best-of-N curation and its funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scoring, text
from tessera.functions.molecules import Backend


def scored(completions: DataFrame, gold: str, output: str, backend: Backend, weights: scoring.Weights, clamp: bool, unannotated: float = 0.0, stop: str = "", rule=None) -> DataFrame:
    """``completions`` with the candidate ``pred``, the parts of its reward and ``reward``."""
    candidate = (rule or (lambda c: text.candidate_first_line(c, stop)))(F.col(output))
    described = completions.withColumn("pred", candidate).withColumn("_gold", backend.described(F.col(gold))).withColumn("_pred", backend.described(F.col("pred")))
    parts = scoring.components(F.col("_gold"), F.col("_pred"), unannotated)
    out = described.select(*[F.col(f"`{c}`") for c in completions.columns], "pred", *[v.alias(k) for k, v in parts.items()])
    return out.withColumn("reward", scoring.reward({k: F.col(k) for k in parts}, weights, clamp))


def compute_score(data_source: Column | None, solution: Column, ground_truth: Column, extra_info: Column | None = None, *, backend: Backend, weights: scoring.Weights = scoring.RL_WEIGHTS, unannotated: float = 0.0) -> Column:
    """The reward of a trainer's row, at least 0. ``ground_truth`` is a record with that
    field or the text itself; the source and further information aren't looked at."""
    pair = F.struct(backend.described(text.ground_truth(ground_truth)).alias("gold"), backend.described(text.candidate_first_text(solution)).alias("pred"))
    score = lambda p: scoring.reward(scoring.components(p["gold"], p["pred"], unannotated), weights, clamp=True)
    return text.bound(pair, score)


#: Fixed value: a candidate must be better than this to be chosen.
FLOOR = -1.0


def best(candidates: DataFrame, keys: list[str], order: Column, carried: list[str], reward: str = "reward", pred: str = "pred", floor: float | None = FLOOR) -> DataFrame:
    """The candidate of each key with the largest reward, the first of equals. If none is
    above ``floor``, the key has the floor as reward, an empty ``pred`` and otherwise nulls.
    Partial results are merged before the shuffle, so a key may have any number."""
    above = F.lit(True) if floor is None else F.coalesce(F.col(reward) > floor, F.lit(False))
    chosen = F.min_by(F.when(above, F.struct(reward, *carried)), F.when(above, F.struct((-F.col(reward)).alias("r"), order.alias("o"))))
    found = candidates.groupBy(*keys).agg(chosen.alias("b")).select(*keys, "b.*")
    return found if floor is None else found.fillna({reward: floor, **({pred: ""} if pred in carried else {})})


def accepted(best_rows: DataFrame, least: float, pred: str = "pred", reward: str = "reward") -> DataFrame:
    """Rows that reach the unrounded threshold and have a text; then rounded to 6 digits."""
    return best_rows.filter((F.col(reward) >= least) & (F.col(pred) != "")).withColumn(reward, F.round(reward, 6))


def funnel(best_rows: DataFrame, least: float, pred: str = "pred", reward: str = "reward") -> DataFrame:
    """One row: total, kept, below_threshold, empty, and the mean reward of kept rows."""
    passes, some = F.col(reward) >= least, F.col(pred) != ""
    return best_rows.agg(
        F.count("*").alias("total"),
        F.count_if(passes & some).alias("kept"),
        F.count_if(~passes).alias("below_threshold"),
        F.count_if(passes & ~some).alias("empty"),
        F.avg(F.when(passes & some, F.col(reward))).alias("mean_reward"),
    )
