"""Column roles, identifiers and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tessera.functions import text

#: Accepted names of the molecule column and of identifiers, in order.
MOLECULE = {"training": ["SMILES", "smiles", "canonical_smiles"], "rl": ["SMILES", "smiles", "canonical_smiles", "Smiles", "smi", "SMI", "molecule", "structure"]}
IDENTIFIERS = {
    "training": ["Unnamed: 0", "id", "idx", "index", "image_id", "pubchem_cid"],
    "rl": ["image_id", "id", "index", "file_name", "image_file", "sample_id", "mol_id", "compound_id"],
    "curation": ["image_id", "Unnamed: 0", "id", "idx"],
    "evaluation": ["image_id", "Unnamed: 0"],
}
#: Endings tried, in order, where a file is missing; training tries each in
#: upper case too, right after it, but neither form of the ending that was asked for.
ENDINGS = {
    "training": [".png", ".PNG", ".jpg", ".JPG", ".jpeg", ".JPEG", ".tif", ".TIF", ".tiff", ".TIFF", ".bmp", ".BMP", ".webp", ".WEBP"],
    "rl": [".png", ".jpg", ".jpeg", ".tif", ".bmp", ".webp"],
}


def first_present(df: DataFrame, names: list[str]) -> str:
    """The first of ``names`` that is a column, in this very case."""
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"none of {names} among {df.columns}")


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """``df`` with columns renamed; a name that it lacks is an error."""
    if lacking := sorted(set(names) - set(df.columns)):
        raise ValueError(f"none of {lacking} among {df.columns}")
    return df.withColumnsRenamed(names)


def pruned(df: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` that exist, in the table's order."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in keep])


def _as_text(df: DataFrame, name: str, integers: bool) -> Column:
    c = F.col(f"`{name}`")
    return text.integral(c) if integers and dict(df.dtypes)[name] in ("double", "float") else c.cast("string")


def row_id(df: DataFrame, names: list[str], ordinal: Column, integers: bool = True) -> Column:
    """For each row the first identifier that isn't blank, else its ordinal."""
    found = [text.blank_to_null(_as_text(df, n, integers)) for n in names if n in df.columns]
    return F.coalesce(*found, ordinal.cast("string"))


def table_id(df: DataFrame, names: list[str], ordinal: Column | None = None) -> Column:
    """The first identifier column that the table has (nulls stay), else the ordinal; an
    error if there is none."""
    for name in names:
        if name in df.columns:
            return _as_text(df, name, True)
    if ordinal is None:
        raise ValueError(f"none of {names} among {df.columns}")
    return ordinal.cast("string")


def full_path(path: Column, root: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def resolved_files(df: DataFrame, path: str, manifest: DataFrame, endings: list[str], out: str = "resolved", skip_own: bool = False) -> DataFrame:
    """``df`` with the file a path stands for: itself, else its stem with the first of
    ``endings`` that the manifest (column ``path``) has, else null; ``skip_own``: of
    endings other than the path's own, in whatever case. One shuffle of the
    candidate paths; the manifest is never gathered."""
    # A name that begins with its only dots has no ending.
    stem = F.regexp_extract(F.col(path), r"(?s)^((?:.*/)?\.*(?:[^./][^/]*?)?)(?:\.[^./]*)?$", 1) if skip_own else F.regexp_replace(F.col(path), r"\.[^./]*$", "")
    own = F.lower(F.substring(F.col(path), F.length(stem) + 1, F.length(F.col(path))))
    others = F.array(*map(F.lit, endings))
    others = F.filter(others, lambda e: F.lower(e) != own) if skip_own else others
    tries = F.concat(F.array(F.col(path)), F.transform(others, lambda e: F.concat(stem, e)))
    wanted = df.select(path).distinct().select(path, F.posexplode(tries).alias("rank", "path"))
    found = wanted.join(manifest.select("path").distinct(), "path").groupBy(F.col(path).alias("_path")).agg(F.min_by("path", "rank").alias(out))
    return df.join(found, df[path] == found["_path"], "left").drop("_path")


def existing(df: DataFrame, path: str, manifest: DataFrame) -> DataFrame:
    """Rows whose file exists."""
    return df.join(manifest.select(F.col("path").alias(path)), path, "left_semi")


def counted(df: DataFrame, keep: Column, counters: dict[str, Column] | None = None, name: str = "rows") -> tuple[DataFrame, Observation]:
    """The rows to keep, and how many were found and skipped (and what ``counters`` add, flags
    that are counted), known once an action has run over the rows: in that same pass."""
    seen = Observation(name)
    sums = [F.count_if(keep).alias("found"), F.count_if(~keep | keep.isNull()).alias("skipped")]
    return df.observe(seen, *sums, *[F.count_if(c).alias(k) for k, c in (counters or {}).items()]).filter(keep), seen


def existing_counted(df: DataFrame, path: str, manifest: DataFrame, by: dict[str, Column] | None = None, name: str = "files") -> tuple[DataFrame, Observation]:
    """``existing``, and found and skipped rows, for each of the flags in ``by`` too."""
    flagged = df.join(manifest.select(F.col("path").alias(path)).distinct().withColumn("_there", F.lit(True)), path, "left")
    there = F.col("_there").isNotNull()
    counters = {f"{k}_{kind}": c & flag for k, c in (by or {}).items() for kind, flag in (("found", there), ("skipped", ~there))}
    rows, seen = counted(flagged, there, counters, name)
    return rows.select(*[F.col(f"`{c}`") for c in df.columns]), seen


def missing(df: DataFrame, path: str, manifest: DataFrame) -> DataFrame:
    """Rows whose file has still to be made."""
    return df.join(manifest.select(F.col("path").alias(path)), path, "left_anti")


def not_blank(df: DataFrame, column: str) -> DataFrame:
    """Rows with a value in ``column``, stripped."""
    return df.filter(F.col(column).isNotNull()).withColumn(column, text.strip(F.col(column))).filter(F.col(column) != "")
