"""Rewards by name in SQL: functions of a session, for queries written as text.

``register(spark)`` makes ``describe_molecule``, ``tanimoto``, ``repetition_penalty``, ``first_text``,
``ground_truth``, ``reward`` and ``compute_score`` temporary functions. All but the first are SQL; they
give what the column expressions of ``scoring``, ``text`` and ``curate`` give.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.functions import molecules, scoring, text

_LONGEST = r"array_max(transform(regexp_extract_all(s, '(?s)((.)\\2*+)', 1), x -> length(x)))"


def _penalty() -> str:
    units = " ".join(rf"WHEN length(s) >= {12 * k} AND length(regexp_extract(s, '(?s)^(.{{{k}}})\\1*+', 0)) >= {12 * k} THEN least(1D, length(regexp_extract(s, '(?s)^(.{{{k}}})\\1*+', 0)) / length(s))" for k in range(1, 5))
    return f"CASE WHEN coalesce(length(s), 0) < 20 THEN 0D {units} WHEN {_LONGEST} / length(s) > 0.3D THEN least(1D, {_LONGEST} / length(s)) WHEN length(s) > 30 AND size(array_distinct(split(s, ''))) <= 3 THEN 0.5D ELSE 0D END"


def _reward(w: scoring.Weights, clamp: bool, unannotated: float) -> str:
    total = w.validity + w.tanimoto + w.canonical + w.graph + w.chiral
    if total <= 0:
        return "0D"
    same = "coalesce(gold.valid AND pred.valid AND gold.canonical = pred.canonical, false)"
    match = f"IF({same}, 1D, 0D)"
    parts = [
        (w.validity, "IF(coalesce(pred.valid, false), 1D, 0D)"),
        (w.tanimoto, "tanimoto(gold.fingerprint, pred.fingerprint)"),
        (w.canonical, match),
        (w.graph, "IF(gold.achiral_valid AND pred.achiral_valid, tanimoto(gold.achiral_fingerprint, pred.achiral_fingerprint), 0D)"),
        (w.chiral, f"IF(contains(coalesce(gold.canonical, ''), '@'), {match}, {float(unannotated)}D)"),
    ]
    weighted = " + ".join(f"{float(x)}D * {part}" for x, part in parts)
    value = f"({weighted} - {float(w.repetition)}D * repetition_penalty(pred.text)) / {float(total)}D"
    return f"greatest(0D, {value})" if clamp else value


def register(spark: SparkSession, weights: scoring.Weights = scoring.RL_WEIGHTS, clamp: bool = True, unannotated: float = 0.0) -> None:
    spark.udf.register("describe_molecule", molecules.Graph().function())
    blank, ends = (x.replace("\\", "\\\\").replace("'", "\\'") for x in (text._BLANK, text._LINE_ENDS))
    strip = lambda x: f"regexp_replace({x}, '(?U)^{blank}+|{blank}+$', '')"
    struct = molecules.SCHEMA.replace(" ", ": ").replace(",: ", ", ")
    bodies = {
        "tanimoto(a ARRAY<INT>, b ARRAY<INT>) RETURNS DOUBLE": "IF(a IS NULL OR b IS NULL, 0D, coalesce(try_divide(double(size(array_intersect(a, b))), double(size(array_union(a, b)))), 1D))",
        "repetition_penalty(s STRING) RETURNS DOUBLE": _penalty(),
        "first_text(s STRING) RETURNS STRING": f"coalesce(translate(get(filter(transform(split({strip('s')}, '{ends}'), x -> {strip('x')}), x -> x <> ''), 0), ' ', ''), '')",
        "ground_truth(s STRING) RETURNS STRING": "IF(coalesce(startswith(schema_of_variant(try_parse_json(s)), 'OBJECT'), false), coalesce(get_json_object(s, '$.ground_truth'), ''), s)",
        f"reward(gold {struct}, pred {struct}) RETURNS DOUBLE": _reward(weights, clamp, unannotated),
        "compute_score(data_source STRING, solution_str STRING, truth STRING, extra_info STRING DEFAULT NULL) RETURNS DOUBLE": "reward(describe_molecule(ground_truth(truth)), describe_molecule(first_text(solution_str)))",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
