"""String rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is removed at both ends (all Unicode white space and the four
#: information separators).
_BLANK = r"[\s\x1c-\x1f]"
#: Strings that stand for a missing value in a CSV file.
NA_VALUES = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
#: What ends a line, as a class (a carriage return with a line feed is one end).
_LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
IMAGE = "<image>"
#: Fixed value: the prompt used where none is given.
DEFAULT_PROMPT = "<image>\n Give me the SMILES of the molecule. "
EMPTY = "<empty>"


def bound(c: Column, f) -> Column:
    """``f`` of a column that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{_BLANK}+|{_BLANK}+$", "")


def na(c: Column) -> Column:
    """Null for the strings that stand for a missing value."""
    return F.when(~c.isin(NA_VALUES), c)


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def without_geometry(c: Column) -> Column:
    """Without the marks of cis and trans bonds."""
    return F.translate(c, "/\\", "")


def _without_stop(c: Column, stop: str) -> Column:
    s = strip(c)
    return strip(F.when(s.endswith(stop), F.substring(s, 1, F.length(s) - len(stop))).otherwise(s)) if stop else s


def candidate_whole(c: Column, stop: str = "") -> Column:
    """Evaluation's rule: the text without stop token, all lines kept."""
    return F.coalesce(_without_stop(c, stop), F.lit(""))


def candidate_first_line(c: Column, stop: str = "") -> Column:
    """Curation's rule: the first line without stop token and spaces."""
    return F.translate(strip(F.substring_index(candidate_whole(c, stop), "\n", 1)), " ", "")


def candidate_first_text(c: Column) -> Column:
    """The reward's rule: the first line that isn't blank, without spaces."""
    lines = F.transform(F.split(strip(c), _LINE_ENDS), strip)
    return F.coalesce(F.translate(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), " ", ""), F.lit(""))


def wrapped(c: Column, width: int = 38) -> Column:
    """Array of the text's lines of ``width`` characters; one empty line if it is empty."""
    n = F.greatest(F.length(c), F.lit(1))
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda i: F.substring(c, i * width + 1, F.lit(width)))


def before_space(c: Column) -> Column:
    return F.substring_index(c, " ", 1)


def sanitised(c: Column, keep: str = "_-") -> Column:
    """A file name: other characters than letters, digits and ``keep`` become ``_``."""
    kept = "".join(f"\\{k}" for k in keep)
    return F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(c, f"[^\\p{{L}}\\p{{N}}{kept}]", "_"), "^_+|_+$", ""), F.lit("")), F.lit("sample"))


def integral(c: Column) -> Column:
    """A number as text, without a fraction of zero."""
    return F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def content_parts(c: Column) -> Column:
    """Array of (type, text): the text split at image marks, which stay; empties go."""
    pieces = F.filter(F.split(c, f"(?<={IMAGE})|(?={IMAGE})"), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(F.when(x == IMAGE, "image").otherwise("text").alias("type"), F.when(x != IMAGE, x).alias("text")))


def plain_prompt(parts: Column) -> Column:
    """Text of a content list; the default prompt if blank or without an image."""
    text = strip(F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "image", IMAGE).otherwise(F.coalesce(p["text"], F.lit("")))), ""))
    return F.when(F.contains(text, F.lit(IMAGE)), text).otherwise(F.lit(DEFAULT_PROMPT))


def messages_of(prompt: Column) -> Column:
    """The turns (role, content) of a prompt: a JSON text, or an array of such structs. A
    turn without role is the user's, one without content empty; a text that isn't a JSON
    array is an error."""
    kind = "array<struct<role string, content string>>"
    turns = F.coalesce(F.try_variant_get(F.try_parse_json(prompt), "$", kind), F.raise_error(F.lit("a prompt isn't a list of turns")).cast(kind))
    return _filled(turns)


def messages_in(turns: Column) -> Column:
    """The same of an array of structs."""
    return _filled(turns)


def _filled(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["content"], F.lit("")).alias("content")))


def prompt_of(turns: Column) -> Column:
    """The plain prompt of all turns, each split at image marks."""
    return plain_prompt(F.flatten(F.transform(turns, lambda t: content_parts(t["content"]))))


def ground_truth(c: Column) -> Column:
    """The answer in a reward record: a JSON object's ``ground_truth``, else the text."""
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(c)).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, F.coalesce(F.get_json_object(c, "$.ground_truth"), F.lit(""))).otherwise(c)


def starts_with_any(c: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def contains_any(c: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def export_folder(csv_path: Column, style: str) -> Column:
    """The folder for a table's images: beside it, its stem and the style."""
    return F.concat(F.regexp_extract(csv_path, r"^(.*/)?[^/]*$", 1), F.regexp_extract(csv_path, r"([^/]*?)(?:\.[^./]*)?$", 1), F.lit(f"_{style}"))
