"""Molecule strings: canonical forms and fingerprints as columns.

``Graph`` reads strings with ``chemistry`` on Arrow batches, one call for all that a reward needs
of a string, another for its canonical form alone; a worker keeps what it said of recent strings, as golds
and completions repeat.
Another chemistry can take its place by the same protocol.
"""

from __future__ import annotations

from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import chemistry, text

SCHEMA = "struct<text string, valid boolean, canonical string, fingerprint array<int>, achiral_valid boolean, achiral string, achiral_fingerprint array<int>>"


class Backend(Protocol):
    def described(self, c: Column) -> Column:
        """Struct of text, valid, canonical, fingerprint, achiral_valid, achiral and
        achiral_fingerprint; canonical forms are null for invalid strings."""
        ...

    def canonical(self, c: Column) -> Column:
        """Struct of text, valid and canonical alone."""
        ...


def _lists(found: list) -> pa.Array:
    """Fingerprints as lists of integers, without an object for each number."""
    sizes = np.array([0 if x is None else len(x) for x in found], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    values = np.concatenate([np.empty(0, np.int16), *[x for x in found if x is not None]]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array([x is None for x in found], pa.bool_()))


def _columns(strings: pa.Array, describe, types: dict) -> pa.StructArray:
    """A struct of each string and what ``describe`` says of it."""
    texts = [s or "" for s in strings.to_pylist()]
    rows = [describe(s) for s in texts]
    held = [pa.array(texts, pa.string())]
    for k, kind in enumerate(list(types.values())[1:]):
        found = [r[k] for r in rows]
        held.append(_lists(found) if kind is None else pa.array(found, kind))
    return pa.StructArray.from_arrays(held, names=list(types))


_TYPES = {"text": pa.string(), "valid": pa.bool_(), "canonical": pa.string(), "fingerprint": None, "achiral_valid": pa.bool_(), "achiral": pa.string(), "achiral_fingerprint": None}


class Graph:
    """Canonical forms by partition refinement, fingerprints by bond paths. A null counts as empty, an empty
    string is invalid."""

    def function(self):
        @F.arrow_udf(SCHEMA)
        def describe(strings: pa.Array) -> pa.Array:
            return _columns(strings, chemistry.described, _TYPES)

        return describe

    def described(self, c: Column) -> Column:
        return self.function()(c)

    def canonical(self, c: Column) -> Column:
        @F.arrow_udf("struct<text string, valid boolean, canonical string>")
        def form(strings: pa.Array) -> pa.Array:
            return _columns(strings, chemistry.canonical, {k: _TYPES[k] for k in ("text", "valid", "canonical")})

        return form(c)


def for_evaluation(c: Column) -> Column:
    """What evaluation canonicalises: without marks of cis and trans bonds, and with
    numbered wild cards for groups."""
    return group_labels(text.without_geometry(F.coalesce(c, F.lit(""))))


def canonical_for_evaluation(described: Column) -> Column:
    """Of a string described after ``for_evaluation``. An invalid string stands for itself,
    so two equal invalid strings match."""
    return F.coalesce(described["canonical"], described["text"])


def canonical_for_reward(described: Column) -> Column:
    """An invalid string stands for nothing, so it matches nothing."""
    return F.coalesce(described["canonical"], F.lit(text.EMPTY))


#: Fixed value: how a line notation's string is cut into atoms, bonds and marks.
ATOMS = r"(\[[^\]]+\]|Br?|Cl?|N|O|S|P|F|I|b|c|n|o|s|p|\(|\)|\.|=|#|-|\+|\\|/|:|~|@|\?|>|\*|\$|%[0-9]{2}|[0-9])"


def group_labels(c: Column) -> Column:
    """Bracketed labels such as ``[R12]`` as numbered wild cards ``[12*]``, and other brackets
    that hold no atom as ``*``."""
    atoms = F.regexp_extract_all(c, F.lit(ATOMS), 1)
    named = lambda a: F.when(a.rlike(r"^\[R[0-9]+\]$"), F.regexp_replace(a, r"^\[R([0-9]+)\]$", "[$1*]")).when(a.startswith("[") & ~a.rlike(f"^{chemistry.BRACKET}$"), "*").otherwise(a)
    return F.array_join(F.transform(atoms, named), "")
