"""Running tasks: panel, features, backtest, evaluation, summary; resumable by what is already written."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.levels import QUANTILES
from ..operators.backtest import check, cutoffs, drop_dead
from ..operators.features import Scaler, prepare, series_stats
from ..operators.metrics import METRICS, evaluate, summary
from ..operators.panel import complete, fill, select_panel
from ..operators.registry import cross_validate
from ..sources.catalog import task_panel
from ..sources.files import write
from .config import Config, output_path
from .spec import PanelSpec, Task
from .windows import Windows


class Tracker(Protocol):
    """Receives what a run produces; a network tracker can be plugged in here."""

    def start(self, task: Task, config: dict) -> None: ...
    def metrics(self, rows: list[dict]) -> None: ...
    def finish(self, ok: bool) -> None: ...


@dataclass
class JsonTracker:
    """Runs as JSON lines in a local file of the driver."""

    path: Path
    run: dict = field(default_factory=dict)

    def start(self, task: Task, config: dict) -> None:
        self.run = {"task": task.name, "tags": list(dict.fromkeys([task.dataset, task.hierarchy.label, task.frequency.name, *config.get("models", [])])), "config": config}

    def metrics(self, rows: list[dict]) -> None:
        self.run["metrics"] = rows

    def finish(self, ok: bool) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("a") as f:
            f.write(json.dumps(self.run | {"ok": ok}) + "\n")


@dataclass(frozen=True)
class TaskPlan:
    """A task bound to its panel: everything lazy."""

    task: Task
    panel: DataFrame
    spec: PanelSpec
    windows: Windows

    #: Two columns of the panel as it came, whose first and last dates are the filled one's; null: the filled panel's.
    dates: DataFrame | None = None

    @classmethod
    def bind(cls, task: Task, panel: DataFrame, spec: PanelSpec) -> TaskPlan:
        filled = fill(complete(select_panel(panel, spec), spec, task.frequency), spec)
        return cls(task, filled, spec, Windows(task.horizon, task.train_share, task.step), panel.select(spec.id, spec.time))

    @property
    def first_cutoff(self) -> DataFrame:
        """One row; it needs two dates only, which the roll-up has before gaps are filled."""
        return cutoffs(self.panel if self.dates is None else self.dates, self.spec, self.task.frequency, self.windows).agg(F.min("cutoff").alias("cutoff"))

    def stats(self) -> DataFrame:
        return series_stats(self.panel, self.spec, self.first_cutoff)

    def prepared(self, scaler: Scaler) -> tuple[DataFrame, PanelSpec, DataFrame]:
        return prepare(self.panel, self.spec, self.task.frequency, scaler, self.first_cutoff)

    def forecasts(self, models: list[str], panel: DataFrame | None = None, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
        return cross_validate(panel if panel is not None else self.panel, self.spec, self.windows, self.task.frequency.season, models, quantiles)

    def evaluated(self, forecasts: DataFrame, metrics: tuple[str, ...] = METRICS, panel: DataFrame | None = None) -> DataFrame:
        return evaluate(forecasts, panel if panel is not None else self.panel, self.spec, self.windows, self.task.frequency.season, metrics)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a complete output stands at ``path``, in any store Spark reaches."""
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def run_task(spark: SparkSession, task: Task, config: Config, scaler: Scaler | None = None, tracker: Tracker | None = None, panel: tuple[DataFrame, PanelSpec] | None = None) -> str:
    """``done`` or ``skipped``. Each stage's result is written once and read by what follows; metrics are on the scaled target."""
    paths = {k: output_path(config.root, k, task) for k in ("filled", "processed", "sku_stats", "cv", "eval")}
    if exists(spark, paths["cv"]) and exists(spark, paths["eval"]):
        return "skipped"
    if tracker:
        tracker.start(task, {"models": list(config.models), "metrics": list(config.metrics), "seed": config.seed})
    ok = False
    try:
        plan = TaskPlan.bind(task, *(panel or task_panel(spark, task)))
        # the filled panel is written once: statistics, scaler and encoders are fits on it
        write(plan.panel, paths["filled"], "parquet")
        plan = TaskPlan(task, spark.read.parquet(paths["filled"]), plan.spec, plan.windows)
        write(plan.stats(), paths["sku_stats"], "parquet")
        ready, spec, _ = plan.prepared(scaler or Scaler())
        write(ready, paths["processed"], "parquet")
        ready = spark.read.parquet(paths["processed"])
        plan = TaskPlan(task, ready, spec, plan.windows)
        write(plan.forecasts(list(config.models)), paths["cv"], "parquet")
        cv = spark.read.parquet(paths["cv"])
        check(cv, ready, plan.windows)
        write(plan.evaluated(drop_dead(cv), config.metrics), paths["eval"], "parquet")
        if tracker:
            tracker.metrics([r.asDict() for r in summary(spark.read.parquet(paths["eval"])).collect()])
        ok = True
    finally:
        if tracker:
            tracker.finish(ok)
    return "done"


def run_all(spark: SparkSession, config: Config, only: tuple[str, ...] = (), tracker: Tracker | None = None) -> dict[str, str]:
    """State of each task: done, skipped, or failed with its reason; one failure doesn't stop the others."""
    states = {}
    for task in config.tasks:
        if only and task.name not in only:
            continue
        try:
            states[task.name] = run_task(spark, task, config, tracker=tracker)
        except Exception as e:  # noqa: BLE001
            states[task.name] = f"failed: {e}"
    return states
