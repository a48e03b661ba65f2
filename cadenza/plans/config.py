"""Configuration: public and private YAML files to one typed value; output paths."""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass, field
from pathlib import Path

from ..operators.metrics import METRICS
from ..operators.registry import REGISTRY
from ..sources.files import FileFormat
from .spec import TASKS, Task

log = logging.getLogger(__name__)
PUBLIC = ("filepaths", "forecast", "metrics", "system", "task")
KINDS = ("filled", "processed", "sku_stats", "cv", "eval", "plot")


def load_yaml(path: str | Path) -> dict:
    """The mapping in a file; a missing or invalid one is reported and counts as empty."""
    import yaml

    try:
        found = yaml.safe_load(Path(path).read_text())
    except (OSError, yaml.YAMLError) as e:
        log.warning("%s: %s", path, e)
        return {}
    if not isinstance(found, dict):
        log.warning("%s holds no mapping", path)
        return {}
    return found


@dataclass(frozen=True)
class Config:
    tasks: tuple[Task, ...] = ()
    models: tuple[str, ...] = ("ETS", "CROSTON", "TSB")
    metrics: tuple[str, ...] = METRICS
    seed: int = 42
    gpus: int = 0
    format: FileFormat = FileFormat.FEATHER
    root: str = "data"
    data: str = ""  # folder of the datasets, one merged Parquet table each
    tracker: dict = field(default_factory=dict)

    @classmethod
    def build(cls, public: dict, private: dict | None = None) -> Config:
        names = public.get("tasks") or []
        unknown = [t for t in names if t not in TASKS]
        if unknown:
            raise ValueError(f"unknown tasks: {', '.join(unknown)}")
        models = tuple(m.upper() for m in public.get("models") or cls.models)
        metrics = tuple(m.upper() for m in public.get("metrics") or METRICS)
        for kind, given, known in (("models", models, REGISTRY), ("metrics", metrics, METRICS)):
            if bad := [x for x in given if x not in known]:
                raise ValueError(f"unknown {kind}: {', '.join(bad)}")
        return cls(
            tuple(TASKS[t] for t in names), models, metrics, int(public.get("seed", 42)), int(public.get("gpus", 0)), FileFormat.of(public.get("format", "feather")), str(public.get("root", "data")), str(public.get("data", "")), dict(private or {})
        )

    @classmethod
    def load(cls, folder: str | Path) -> Config:
        public: dict = {}
        for name in PUBLIC:
            public |= load_yaml(Path(folder) / "public" / f"{name}.yaml")
        return cls.build(public, load_yaml(Path(folder) / "private" / "private.yaml"))


def output_path(root: str, kind: str, task: Task) -> str:
    """One folder per kind, one partition per task: tasks of one dataset don't overwrite each other."""
    if kind not in KINDS:
        raise ValueError(f"unknown output {kind!r}")
    return f"{root}/{kind}/task={task.name}"


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Run forecasting benchmark tasks on Spark.")
    parser.add_argument("--config-dir", default="config")
    parser.add_argument("--task", action="append", default=[], help="run this configured task only; may be repeated")
    parser.add_argument("--tracker", help="a JSON-lines file of the driver that records runs")
    return parser.parse_args(argv)
