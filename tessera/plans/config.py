"""Settings of a run: frozen records, checked on the driver. There are no fields for
secrets."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import SparkSession

from tessera.sources import readers

MODES = ("dynamic", "pre_rendered", "realistic")


@dataclass(frozen=True)
class Benchmark:
    name: str
    csv_path: str
    mode: str = "realistic"
    image_dir: str | None = None
    sample_num: int | None = None
    enabled: bool = True


@dataclass(frozen=True)
class Evaluation:
    benchmarks: list[Benchmark] = field(default_factory=list)
    output_dir: str = "results"
    batch_size: int = 512
    seed: int = 3407
    gpu_ids: list[int] = field(default_factory=list)


@dataclass(frozen=True)
class Curation:
    num_generations: int = 8
    min_reward: float = 0.5
    chunk_size: int = 500
    shards: int = 1
    stop: str = ""


@dataclass(frozen=True)
class DataSet:
    """A training or validation table. ``dynamic`` images are drawn anew, ``pre_rendered``
    ones lie in a folder by id, ``realistic`` ones where a column of paths says."""

    train_csv: str
    data_mode: str = "dynamic"
    pre_rendered_image_dir: str | None = None
    realistic_image_root: str | None = None
    style: str | None = None
    mol_augment: bool | None = None
    include_condensed: bool | None = None
    instruction: str | None = None
    sample_num: int | None = None
    name: str | None = None

    def checked(self, where: str) -> DataSet:
        if self.data_mode not in MODES:
            raise ValueError(f"{where}.data_mode {self.data_mode!r} is none of {MODES}")
        needed = {"dynamic": ["style", "mol_augment", "include_condensed"], "pre_rendered": ["pre_rendered_image_dir"], "realistic": ["realistic_image_root"]}
        for key in needed[self.data_mode]:
            if getattr(self, key) in (None, ""):
                raise ValueError(f"{where}.{key} is needed in mode {self.data_mode}")
        if self.sample_num is not None and self.sample_num <= 0:
            raise ValueError(f"{where}.sample_num must be positive")
        return self


@dataclass(frozen=True)
class Training:
    """What a training says of its data; ``trainer`` holds all other settings as they are."""

    train_sets: list[DataSet]
    val_sets: list[DataSet] = field(default_factory=list)
    enable_val_sets: bool = False
    eval_every_steps: int | None = None
    eval_on_start: bool = False
    eval_on_end: bool = False
    save_steps: int | None = None
    max_steps: int = 0
    seed: int = 3407
    freeze_layers: list[int] = field(default_factory=list)
    freeze_modules: list[str] = field(default_factory=list)
    output_dir: str = "outputs"
    trainer: dict = field(default_factory=dict)

    def frozen_prefixes(self) -> list[str]:
        """Parameter prefixes of the frozen layers, sorted and once each."""
        return [f"{p}layers.{k}." for k in sorted(set(self.freeze_layers)) for p in ("model.", "", "model.model.")]


@dataclass(frozen=True)
class Preparation:
    """Tables for training with rewards: what is sampled and held out."""

    datasets: list[DataSet]
    val_ratio: float = 0.02
    min_val_samples: int = 100
    enable_val: bool = True
    seed: int = 42
    output_dir: str = "data"


def resolved(path: str, base: str) -> str:
    """A path relative to the settings file's folder, which may be of another file system."""
    if os.path.isabs(path) or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return path
    system, mark, folder = base.rpartition("://")
    return system + mark + posixpath.normpath(posixpath.join(folder, path))


def loaded(spark: SparkSession, path: str, kind: Callable[[dict, str], object]):
    """What ``kind`` (``evaluation``, ``training`` or ``preparation``) makes of a settings file, its paths
    relative to the file's folder."""
    return kind(readers.settings(spark, path), posixpath.dirname(path))


def filled(kind, values: dict):
    """A record of ``kind``: unknown keys are errors, missing ones get their defaults."""
    known = {f.name for f in fields(kind)}
    if extra := sorted(set(values) - known):
        raise ValueError(f"unknown settings: {extra}")
    return kind(**values)


def evaluation(values: dict, base: str) -> Evaluation:
    rows = [filled(Benchmark, v) for v in values.get("benchmarks", [])]
    out = filled(Evaluation, values | {"benchmarks": [replace(b, csv_path=resolved(b.csv_path, base)) for b in rows]})
    for b in out.benchmarks:
        if b.mode not in MODES:
            raise ValueError(f"{b.name}: mode {b.mode!r} is none of {MODES}")
        if b.mode == "pre_rendered" and not b.image_dir:
            raise ValueError(f"{b.name}: pre-rendered images need image_dir")
    if len(set(out.gpu_ids)) != len(out.gpu_ids):
        raise ValueError("repeated gpu_ids")
    return out


def _datasets(rows: list[dict], base: str, where: str) -> list[DataSet]:
    out = []
    for k, row in enumerate(rows):
        paths = {key: resolved(row[key], base) for key in ("train_csv", "pre_rendered_image_dir", "realistic_image_root") if row.get(key)}
        if not row.get("train_csv"):
            raise ValueError(f"{where}[{k}].train_csv is needed")
        out.append(filled(DataSet, row | paths).checked(f"{where}[{k}]"))
    return out


def training(values: dict, base: str) -> Training:
    own = {f.name for f in fields(Training)} - {"trainer"}
    sets = {k: _datasets(values.get(k) or [], base, k) for k in ("train_sets", "val_sets")}
    out = Training(**{k: v for k, v in values.items() if k in own} | sets, trainer={k: v for k, v in values.items() if k not in own})
    if not out.train_sets:
        raise ValueError("train_sets holds no table")
    if out.enable_val_sets and not out.val_sets:
        raise ValueError("enable_val_sets without val_sets")
    for key in ("eval_every_steps", "save_steps"):
        if (n := getattr(out, key)) is not None and n <= 0:
            raise ValueError(f"{key} must be positive")
    return out


def preparation(values: dict, base: str) -> Preparation:
    out = filled(Preparation, values | {"datasets": _datasets(values.get("datasets") or [], base, "datasets")})
    if not out.datasets:
        raise ValueError("datasets holds no table")
    if not 0 <= out.val_ratio < 1:
        raise ValueError("val_ratio lies from 0 to below 1")
    return out


def curation(values: dict) -> Curation:
    out = filled(Curation, values)
    for key in ("num_generations", "chunk_size", "shards"):
        if getattr(out, key) <= 0:
            raise ValueError(f"{key} must be positive")
    return out


def selected(benchmarks: list[Benchmark], names: list[str] | None) -> list[Benchmark]:
    """Enabled ones among ``names`` (all if none are given); unknown names are ignored."""
    out = [b for b in benchmarks if b.enabled and (not names or b.name in names)]
    if not out:
        raise ValueError("no benchmark selected")
    return out


def save_every(max_steps: int | None) -> int:
    return max(10, max_steps // 6) if max_steps else 100


def literal(value) -> str:
    """A value as a command line takes it."""
    import json

    if isinstance(value, bool):
        return "true" if value else "false"
    if value is None:
        return "null"
    return str(value) if isinstance(value, (int, float, str)) else json.dumps(value)


def applied(arguments: list[str], changes: dict[str, str]) -> list[str]:
    """Command line arguments with changed keys in their place and new ones at the end."""
    at = {a.split("=", 1)[0]: k for k, a in enumerate(arguments) if "=" in a}
    out = list(arguments)
    for key, value in changes.items():
        if key in at:
            out[at[key]] = f"{key}={value}"
        else:
            out.append(f"{key}={value}")
    return out


def overrides(settings: dict, group: str = "hydra_cli_overrides") -> dict[str, str]:
    """Dotted keys, the grouped ones first, so top-level ones win."""
    grouped = settings.get(group)
    rows = [*(grouped.items() if isinstance(grouped, dict) else ()), *settings.items()]
    return {k: literal(v) for k, v in rows if isinstance(k, str) and "." in k}
