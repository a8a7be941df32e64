"""Benchmark metrics, counters, parameter groups and checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text

#: Where no gold is annotated there is no chiral accuracy.
NO_CHIRAL = -1.0


def realigned(inputs: DataFrame, outputs: DataFrame, key: str, pred: str) -> DataFrame:
    """Every input with its output, an empty text where there is none."""
    return inputs.join(outputs.select(key, pred), key, "left").withColumn(pred, F.coalesce(F.col(pred), F.lit("")))


def paired(left: DataFrame, right: DataFrame, at: str = "ordinal") -> DataFrame:
    """Rows of two tables at the same place, which a column of both says; the right one's
    columns follow. A place that only one table has, or has twice, is an error."""
    a = left.withColumn("_l", F.lit(1))
    b = right.withColumn("_r", F.lit(1))
    n = F.count("*").over(Window.partitionBy(at))
    both = a.join(b, at, "full").withColumn("_n", n)
    wrong = F.raise_error(F.concat(F.lit("rows don't pair at "), F.coalesce(F.col(at).cast("string"), F.lit("null"))))
    right_way = F.col("_l").isNotNull() & F.col("_r").isNotNull() & (F.col("_n") == 1)
    return both.filter(F.when(right_way, True).otherwise(wrong.cast("boolean"))).drop("_l", "_r", "_n")


def surviving(rows: DataFrame, batch: str, valid: Column) -> DataFrame:
    """Rows that are valid; a batch without any is an error. Counts are merged before they
    are shuffled, so a batch may have any size."""
    left = rows.filter(F.coalesce(valid, F.lit(False)))
    counts = rows.groupBy(F.col(batch).alias("_b")).agg(F.count_if(valid).alias("_n"))
    empty = F.raise_error(F.concat(F.lit("no valid row in batch "), F.coalesce(F.col("_b").cast("string"), F.lit("null"))))
    batches = counts.filter(F.when(F.col("_n") > 0, True).otherwise(empty.cast("boolean"))).select("_b")
    # A right join: a batch whose rows are all gone must still be looked at.
    kept = left.withColumn("_own", F.lit(True)).join(batches, left[batch].eqNullSafe(batches["_b"]), "right")
    return kept.filter("_own").drop("_own", "_b")


def benchmark_metrics(pairs: DataFrame, groups: list[str], gold: Column, pred: Column, gold_graph: Column, pred_graph: Column, similarity: Column | None = None) -> DataFrame:
    """Per group: canonical and graph accuracy, accuracy among annotated golds (-1 if
    there are none), the number of samples, and the mean similarity if given. An empty
    gold never equals an empty prediction."""
    real = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit(text.EMPTY))
    match = F.coalesce(real(gold) == pred, F.lit(False)).cast("double")
    graph = F.coalesce(real(gold_graph) == pred_graph, F.lit(False)).cast("double")
    annotated = F.contains(F.coalesce(gold, F.lit("")), F.lit("@"))
    aggs = [
        F.avg(match).alias("canon_smiles"),
        F.avg(graph).alias("graph"),
        F.coalesce(F.avg(F.when(annotated, match)), F.lit(NO_CHIRAL)).alias("chiral"),
        F.avg(match).alias("accuracy"),
        F.count("*").alias("num_samples"),
    ]
    if similarity is not None:
        aggs.append(F.avg(similarity).alias("tanimoto"))
    return (pairs.groupBy(*groups) if groups else pairs.groupBy()).agg(*aggs)


def training_accuracy(gold: Column, pred: Column, labelled: Column) -> Column:
    """Share of labelled rows that match, two empty texts included; null without any."""
    return F.avg(F.when(labelled, (F.coalesce(F.nullif(gold, F.lit("")), F.lit(text.EMPTY)) == F.coalesce(F.nullif(pred, F.lit("")), F.lit(text.EMPTY))).cast("double")))


def counts_by(df: DataFrame, group: str, **rules: Column) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("total"), *[F.count_if(rule).alias(name) for name, rule in rules.items()])


#: How parameter names begin that belong to the vision and language parts,
#: and what marks parameters without weight decay.
VISION = [
    "model.sam_model.", "sam_model.", "model.projector.", "projector.", "model.qwen2_model.", "qwen2_model.",
    "model.model.sam_model.", "model.model.projector.", "model.model.qwen2_model.",
]
LANGUAGE = [
    "model.layers.", "layers.", "model.model.layers.", "model.embed_tokens", "embed_tokens", "model.model.embed_tokens",
    "model.norm.", "norm.", "model.model.norm.", "model.lm_head", "lm_head", "model.model.lm_head",
]
NO_DECAY = ["bias", "layernorm.weight", "layer_norm.weight", "norm.weight", "rmsnorm.weight", "rms_norm.weight"]


def bucket(name: Column, vision: list[str] = VISION, language: list[str] = LANGUAGE) -> Column:
    return F.when(text.starts_with_any(name, vision), "vision").when(text.starts_with_any(name, language), "language").otherwise("other")


def parameter_groups(params: DataFrame, vision: list[str] = VISION, language: list[str] = LANGUAGE, no_decay: list[str] = NO_DECAY) -> DataFrame:
    """Trainable parameters (name, numel, requires_grad) by bucket and decay."""
    rows = params.filter("requires_grad").select(bucket(F.col("name"), vision, language).alias("bucket"), text.contains_any(F.lower("name"), no_decay).alias("no_decay"), "numel")
    return rows.groupBy("bucket", "no_decay").agg(F.count("*").alias("n_params"), F.sum("numel").alias("numel"))


def frozen(params: DataFrame, prefixes: list[str], patterns: list[str]) -> DataFrame:
    """``params`` with requires_grad off where a prefix or pattern hits."""
    hit = text.starts_with_any(F.col("name"), prefixes) | text.contains_any(F.col("name"), patterns)
    return params.withColumn("requires_grad", F.col("requires_grad") & ~hit)


def pattern_hits(params: DataFrame, patterns: list[str]) -> DataFrame:
    """How many names each pattern hits, those without hits included."""
    return params.agg(*[F.count_if(F.contains("name", F.lit(p))).alias(f"h{k}") for k, p in enumerate(patterns)]).select(F.explode(F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"h{k}").alias("hits")) for k, p in enumerate(patterns)])).alias("x")).select("x.*")


def trainable_share(params: DataFrame) -> DataFrame:
    return params.agg(F.sum(F.when(F.col("requires_grad"), F.col("numel")).otherwise(0)).alias("trainable"), F.sum("numel").alias("total")).withColumn("share", F.try_divide(F.col("trainable").cast("double"), F.col("total").cast("double")))


def checkpoint_step(path: Column) -> Column:
    """The step in a name such as ``checkpoint-900``; null for other names."""
    return F.regexp_extract(path, r"(?:^|/)checkpoint-([0-9]{1,18})$", 1).try_cast("bigint")


def trained_step(path: Column) -> Column:
    """The step in the name of an actor's folder, such as ``global_step_40/actor``; null for
    others, so a step without an actor doesn't count."""
    return F.regexp_extract(path, r"(?:^|/)global_step_(?:[^/]*_)?([0-9]{1,18})/actor$", 1).try_cast("bigint")


def latest_actor(folders: DataFrame, groups: list[str], path: str = "path") -> DataFrame:
    """The folder of the largest step that has an actor."""
    found = latest_checkpoint(folders, groups, path, trained_step)
    return found.withColumn(path, F.regexp_replace(path, "/actor$", ""))


def latest_checkpoint(paths: DataFrame, groups: list[str], path: str = "path", step=checkpoint_step) -> DataFrame:
    steps = paths.withColumn("step", step(F.col(path))).filter("step is not null")
    return (steps.groupBy(*groups) if groups else steps.groupBy()).agg(F.max(F.struct("step", path)).alias("m")).select(*groups, F.col(f"m.{path}").alias(path), F.col("m.step").alias("step"))


#: Endings of the timing metrics of an evaluation.
TIMINGS = ["_runtime", "_samples_per_second", "_steps_per_second", "_model_preparation_time"]


def is_timing(name: Column) -> Column:
    out = F.lit(False)
    for ending in TIMINGS:
        out = out | name.endswith(ending)
    return name.startswith("eval_") & out


def evaluates_at(step: Column, every: int, last: int) -> Column:
    """Whether an evaluation runs at this step: not the first, not the last."""
    return (step > 0) & (F.lit(last <= 0) | (step < last)) & (step % every == 0)


def merged_overrides(base: DataFrame, overrides: DataFrame, key: str = "key", value: str = "value", order: str | None = None) -> DataFrame:
    """Key and value rows: the override's where it has the key, the base's otherwise. With
    ``order``, a column of both, rows of the base keep their place and those that are added
    follow in the order of the overrides: ``place`` (added, order) sorts them."""
    also = [order] if order else []
    b = base.select(key, F.col(value).alias("_b"), *[F.col(c).alias("_at_b") for c in also])
    o = overrides.select(key, F.col(value).alias("_o"), *[F.col(c).alias("_at_o") for c in also])
    place = [F.struct(F.col("_at_b").isNull().alias("added"), F.coalesce("_at_b", "_at_o").alias("at")).alias("place") for _ in also]
    return b.join(o, key, "full").select(key, F.coalesce("_o", "_b").alias(value), *place)


def success_rate(valid: Column) -> Column:
    """Share of strings that a backend accepts; null for no strings."""
    return F.avg(valid.cast("double"))


def results_of_all(benchmarks: DataFrame, results: DataFrame, name: str = "name") -> DataFrame:
    """Every benchmark with its result; a benchmark without one is an error."""
    joined = benchmarks.join(results.withColumn("_found", F.lit(True)), name, "left")
    missing = F.raise_error(F.concat(F.lit("no result for "), F.col(name).cast("string")))
    return joined.filter(F.when(F.col("_found"), True).otherwise(missing.cast("boolean"))).drop("_found")


def newest_snapshot(files: DataFrame, config: str = "config.json", path: str = "path") -> DataFrame:
    """The folder, last in order, that holds the configuration file."""
    folder = F.regexp_extract(F.col(path), f"^(.*)/{config.replace('.', '[.]')}$", 1)
    return files.select(F.nullif(folder, F.lit("")).alias("folder")).agg(F.max("folder").alias("folder"))
