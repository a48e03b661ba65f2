"""Datasets by name: a fact table, dimensions joined to it, and the roles of columns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import roll_up
from ..plans.spec import DATASETS, Frequency, Hierarchy, PanelSpec, Task


@dataclass(frozen=True)
class Dataset:
    """``load`` gives merged rows with the columns of ``keys``, the time, the target and the features."""

    name: str
    load: Callable[[SparkSession], DataFrame]
    product: str = "productID"
    store: str = "storeID"
    time: str = "date"
    target: str = "target"
    past: tuple[str, ...] = ()
    future: tuple[str, ...] = ()
    static: tuple[str, ...] = ()

    def keys(self, hierarchy: Hierarchy) -> Column:
        """The series' id at a level."""
        if hierarchy is Hierarchy.PRODUCT:
            return F.col(self.product).cast("string")
        if hierarchy is Hierarchy.STORE:
            return F.col(self.store).cast("string")
        return F.concat_ws("_", F.col(self.product).cast("string"), F.col(self.store).cast("string"))

    def panel(self, spark: SparkSession, hierarchy: Hierarchy, frequency: Frequency) -> tuple[DataFrame, PanelSpec]:
        """Rolled-up panel (id, ds, y, features): target sums, numeric features means, static ones first values."""
        rows = self.load(spark)
        kinds = dict(rows.dtypes)
        level = {Hierarchy.PRODUCT: (self.store,), Hierarchy.STORE: (self.product,)}.get(hierarchy, ())
        features = [c for c in dict.fromkeys((*self.past, *self.future, *self.static)) if c not in level]
        pick = lambda c: F.min(c) if c in self.static or kinds[c] == "string" else F.avg(c)
        aggregates = {"y": F.sum(self.target).cast("double")} | {c: pick(c) for c in features}
        spec = PanelSpec(past=tuple(c for c in self.past if c in features), future=tuple(c for c in self.future if c in features), static=tuple(c for c in self.static if c in features))
        return roll_up(rows, [self.keys(hierarchy).alias("id")], F.col(self.time), frequency, aggregates), spec


_FOUND: dict[str, Dataset] = {}


def register(dataset: Dataset) -> None:
    _FOUND[dataset.name] = dataset


def register_folder(name: str, path: str, **roles) -> None:
    """A dataset kept as one merged Parquet table at ``path``."""
    register(Dataset(name, lambda spark: spark.read.parquet(path), **roles))


def register_folders(root: str, roles: dict[str, dict] | None = None) -> None:
    """All known datasets by convention: ``root``/<name> is one merged Parquet table with productID, storeID, date and target.

    ``roles``: by dataset, other column names and the features (``past``, ``future``, ``static``). What is registered already stays.
    """
    for name in DATASETS:
        if name not in _FOUND:
            register_folder(name, f"{root}/{name}", **{k: tuple(v) if isinstance(v, list) else v for k, v in (roles or {}).get(name, {}).items()})


def dataset(name: str) -> Dataset:
    if name in _FOUND:
        return _FOUND[name]
    if name in DATASETS:
        raise LookupError(f"{name} is known but its files aren't registered: see register_folder")
    raise ValueError(f"unknown dataset {name!r}")


def merged(fact: DataFrame, *dimensions: tuple[DataFrame, str, str]) -> DataFrame:
    """The fact rows with each dimension's columns, by left join; Spark broadcasts dimensions where their size allows."""
    out = fact
    for dimension, left, right in dimensions:
        out = out.join(dimension, out[left] == dimension[right], "left")
    return out


def task_panel(spark: SparkSession, task: Task) -> tuple[DataFrame, PanelSpec]:
    return dataset(task.dataset).panel(spark, task.hierarchy, task.frequency)
