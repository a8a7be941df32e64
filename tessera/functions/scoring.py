"""Rewards, penalties and similarities as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text


def repetition_penalty(c: Column) -> Column:
    """0 for a clean string to 1 for a repetitive one. The first rule that applies:
    under 20 characters, 0; a leading unit of 1 to 4 characters that stands 12 times or
    more in a row, its share of the string; one character's longest run over 0.3 of the
    string, that share; over 30 characters of at most 3 kinds, 0.5; else 0."""
    n = F.length(c)
    share = lambda covered: F.least(F.lit(1.0), covered.cast("double") / n)
    rules = F.when(F.coalesce(n, F.lit(0)) < 20, 0.0)
    for unit in range(1, 5):
        covered = F.length(F.regexp_extract(c, f"(?s)^(.{{{unit}}})\\1*+", 0))
        rules = rules.when((n >= 12 * unit) & (covered >= 12 * unit), share(covered))
    longest = F.array_max(F.transform(F.regexp_extract_all(c, F.lit(r"(?s)((.)\2*+)"), 1), F.length))
    kinds = F.size(F.array_distinct(F.split(c, "")))
    return rules.when(share(longest) > 0.3, share(longest)).when((n > 30) & (kinds <= 3), 0.5).otherwise(0.0)


def character_grams(c: Column, n: int = 3) -> Column:
    """The distinct runs of n characters; the whole string if it is shorter."""

    def grams(s: Column) -> Column:
        last = F.greatest(F.length(s) - n, F.lit(0))
        return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(s, i + 1, F.lit(n))))

    return text.bound(c, grams)  # else ``c`` would be computed again for every run


def tanimoto(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; 0 if a set is null, 1 if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(F.coalesce(F.try_divide(both.cast("double"), either.cast("double")), F.lit(1.0)))


@dataclass(frozen=True)
class Weights:
    validity: float = 0.5
    tanimoto: float = 2.0
    canonical: float = 3.0
    graph: float = 2.0
    chiral: float = 1.0
    repetition: float = 2.0


#: The default weights of the two rewards.
RL_WEIGHTS = Weights()
CURATION_WEIGHTS = Weights(0.0, 1.0, 8.0, 2.0, 1.0, 2.0)


def components(gold: Column, pred: Column, unannotated: float = 0.0) -> dict[str, Column]:
    """The six parts of a reward, of two structs with the fields valid, canonical,
    achiral_valid, fingerprint, achiral_fingerprint and text (see ``molecules``)."""
    match = F.coalesce(gold["valid"] & pred["valid"] & (gold["canonical"] == pred["canonical"]), F.lit(False))
    return {
        "validity": F.coalesce(pred["valid"], F.lit(False)).cast("double"),
        "tanimoto": tanimoto(gold["fingerprint"], pred["fingerprint"]),
        "canonical": match.cast("double"),
        "graph": F.when(gold["achiral_valid"] & pred["achiral_valid"], tanimoto(gold["achiral_fingerprint"], pred["achiral_fingerprint"])).otherwise(0.0),
        "chiral": F.when(F.contains(F.coalesce(gold["canonical"], F.lit("")), F.lit("@")), match.cast("double")).otherwise(F.lit(float(unannotated))),
        "repetition": repetition_penalty(pred["text"]),
    }


def reward(parts: dict[str, Column], w: Weights, clamp: bool) -> Column:
    """Weighted mean of the parts less the weighted penalty, whose weight isn't in the
    denominator. ``clamp``: not below 0. Without positive weights, 0."""
    positive = {k: getattr(w, k) for k in ("validity", "tanimoto", "canonical", "graph", "chiral")}
    total = sum(positive.values())
    if total <= 0:
        return F.lit(0.0)
    value = (reduce(lambda a, b: a + b, [F.lit(v) * parts[k] for k, v in positive.items()]) - F.lit(w.repetition) * parts["repetition"]) / F.lit(total)
    return F.greatest(F.lit(0.0), value) if clamp else value


#: Image sizes and the down-sampling of image tokens.
BASE_SIZE, CROP_SIZE, PATCH, DOWN = 1024, 768, 16, 4


def image_tokens(width: Column, height: Column, crop: bool = True) -> Column:
    """Tokens of an image cut into ``width`` by ``height`` crops."""
    base, side = -(-(BASE_SIZE // PATCH) // DOWN), -(-(CROP_SIZE // PATCH) // DOWN)
    whole = F.lit(base * base + 1)
    return whole + F.when((width > 1) | (height > 1), F.lit(side * side) * width * height).otherwise(0) if crop else whole


def validation_size(n: Column, ratio: float, at_least: int) -> Column:
    return F.greatest(F.least(F.greatest(F.lit(at_least), F.floor(n * ratio)), n - 1), F.lit(0)).cast("bigint")
