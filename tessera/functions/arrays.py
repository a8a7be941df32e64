"""Messages, token sequences and label masks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the label that a loss ignores.
IGNORED = -100
#: The roles of a training record.
USER, ASSISTANT = "<|User|>", "<|Assistant|>"


def messages(prompt: Column, image: Column, answer: Column) -> Column:
    """A record of two turns: the prompt with its image, and the answer."""
    no_image = F.lit(None).cast("array<string>")
    return F.array(
        F.struct(F.lit(USER).alias("role"), prompt.alias("content"), F.array(image).alias("images")),
        F.struct(F.lit(ASSISTANT).alias("role"), answer.alias("content"), no_image.alias("images")),
    )


def truncated(ids: Column, most: int, how: str) -> Column:
    """At most ``most`` ids: the ``right`` end cut, the ``left`` end cut, the ``middle``
    cut, or an ``error``."""
    n = F.size(ids)
    if how == "right":
        return F.slice(ids, 1, most)
    if how == "left":
        return F.when(n > most, F.slice(ids, -most, most)).otherwise(ids)
    if how == "middle":
        head = most // 2
        return F.when(n > most, F.concat(F.slice(ids, 1, head), F.slice(ids, head - most, most - head))).otherwise(ids)
    if how == "error":
        return F.when(n > most, F.raise_error(F.concat(F.lit("prompt of "), n.cast("string"), F.lit(f" tokens is longer than {most}")))).otherwise(ids)
    raise ValueError(f"truncation {how!r}")


def sequence(turns: Column, bos: int, image_id: int, image_tokens: Column) -> Column:
    """Struct of ids, image_mask and prompt_count for turns of (role, segments): each turn
    is an array of id arrays, with an image between every two of them."""
    run = F.transform(F.array_repeat(F.lit(image_id), image_tokens.cast("int")), lambda x: x)

    def joined(turn: Column, fill, between: Column) -> Column:
        return F.flatten(F.transform(turn["segments"], lambda s, i: F.when(i > 0, F.concat(between, fill(s))).otherwise(fill(s))))

    ids = F.concat(F.array(F.lit(bos)), F.flatten(F.transform(turns, lambda t: joined(t, lambda s: s, run))))
    mask = F.concat(F.array(F.lit(False)), F.flatten(F.transform(turns, lambda t: joined(t, lambda s: F.transform(s, lambda _: F.lit(False)), F.transform(run, lambda _: F.lit(True))))))
    size = lambda t: F.aggregate(t["segments"], F.lit(0), lambda a, s: a + F.size(s)) + (F.size(t["segments"]) - 1) * image_tokens.cast("int")
    answer = F.array_position(F.transform(turns, lambda t: t["role"]), ASSISTANT)
    before = F.when(answer > 0, F.slice(turns, F.lit(1), (answer - 1).cast("int"))).otherwise(turns)
    return F.struct(ids.alias("ids"), mask.alias("image_mask"), F.aggregate(F.transform(before, size), F.lit(1), lambda a, x: a + x).alias("prompt_count"))


def padded(ids: Column, width: Column, fill) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(fill), F.greatest(width - F.size(ids), F.lit(0)).cast("int")))


def labels(ids: Column, image_mask: Column, prompt_count: Column, pad: int) -> Column:
    """The ids, ignored where they are padding, image or prompt."""
    return F.transform(ids, lambda x, i: F.when((x == pad) | F.coalesce(F.get(image_mask, i), F.lit(False)) | (i < prompt_count), IGNORED).otherwise(x))


def attention(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: (x != pad).cast("int"))
