"""Panel roles, frequencies, hierarchies and tasks: immutable values beside a lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum


class Frequency(Enum):
    """Calendar steps: (alias, season length, days or months of a step)."""

    DAILY = ("D", 7, "day", 1)
    WEEKLY = ("W-MON", 52, "day", 7)
    MONTHLY = ("MS", 12, "month", 1)

    def __init__(self, alias: str, season: int, unit: str, step: int):
        self.alias, self.season, self.unit, self.step = alias, season, unit, step

    @property
    def period_alias(self) -> str:
        """The alias for libraries that name months as periods, not by their first or last day."""
        return "M" if self.unit == "month" else self.alias

    @classmethod
    def of(cls, name: str) -> Frequency:
        try:
            return cls[name.upper()]
        except KeyError:
            raise ValueError(f"unknown frequency {name!r}") from None


class Hierarchy(Enum):
    """Level of a panel and the column that names its series."""

    PRODUCT = ("product", "productID")
    STORE = ("store", "storeID")
    PRODUCT_STORE = ("product/store", "timeSeriesID")

    def __init__(self, label: str, id_column: str):
        self.label, self.id_column = label, id_column

    @classmethod
    def of(cls, name: str) -> Hierarchy:
        for h in cls:
            if name in (h.label, h.label.replace("/", "_")):
                return h
        raise ValueError(f"unknown hierarchy {name!r}")


def _unique(*groups: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(c for g in groups for c in g))


ROLES = ("past", "future", "static", "categorical")


@dataclass(frozen=True)
class PanelSpec:
    """Which column of a panel plays which role; every edit returns a new spec."""

    id: str = "id"
    time: str = "ds"
    target: str = "y"
    past: tuple[str, ...] = ()
    future: tuple[str, ...] = ()
    static: tuple[str, ...] = ()
    all_categorical: tuple[str, ...] = ()

    @property
    def exogenous(self) -> tuple[str, ...]:
        return _unique(self.past, self.future, self.static)

    @property
    def categorical(self) -> tuple[str, ...]:
        return tuple(c for c in self.all_categorical if c in self.exogenous)

    @property
    def base(self) -> tuple[str, str, str]:
        return self.id, self.time, self.target

    @property
    def columns(self) -> tuple[str, ...]:
        return _unique(self.base, self.exogenous)

    @staticmethod
    def _role(role: str) -> str:
        if role not in ROLES:
            raise ValueError(f"unknown role {role!r}")
        return "all_categorical" if role == "categorical" else role

    def add(self, role: str, *names: str) -> PanelSpec:
        key = self._role(role)
        return replace(self, **{key: _unique(getattr(self, key), names)})

    def remove(self, *names: str, role: str | None = None) -> PanelSpec:
        keys = [self._role(role)] if role else [self._role(r) for r in ROLES]
        return replace(self, **{k: tuple(c for c in getattr(self, k) if c not in names) for k in keys})

    def rename(self, mapping: dict[str, str]) -> PanelSpec:
        return replace(self, **{k: _unique(tuple(mapping.get(c, c) for c in getattr(self, k))) for k in map(self._role, ROLES)})


@dataclass(frozen=True)
class Task:
    """A benchmark task: dataset, hierarchy, frequency and horizon."""

    dataset: str
    hierarchy: Hierarchy
    frequency: Frequency
    horizon: int
    train_share: float = 0.8
    step: int = 1
    name: str = field(default="", compare=False)

    @classmethod
    def parse(cls, name: str) -> Task:
        parts = name.split("_")
        if len(parts) < 4:
            raise ValueError(f"task {name!r} needs dataset, hierarchy, frequency and horizon")
        try:
            horizon = int(parts[-1])
        except ValueError:
            raise ValueError(f"task {name!r} has no horizon") from None
        return cls(parts[0], Hierarchy.of("_".join(parts[1:-2])), Frequency.of(parts[-2]), horizon, name=name)


#: Fixed: levels with frequency and horizon that each dataset is run at.
_RUNS = {
    "m5": "product_weekly_4 product_monthly_3 store_daily_7",
    "favorita": "product_weekly_4 product_monthly_3 store_daily_7 store_weekly_4",
    "rohlik": "product_store_weekly_4 product_daily_7 product_weekly_4",
    "rossmann": "product_store_weekly_4 store_weekly_4",
    "bakery": "product_store_daily_7 product_store_weekly_4 product_daily_7 store_daily_7 store_weekly_4",
    "yaz": "product_daily_7",
    "pharmacy": "product_weekly_4",
    "pharmacy2": "product_store_daily_7 product_store_weekly_4",
    "freshretail50k": "product_daily_7 store_daily_7",
    "hotel": "product_store_daily_7 product_store_weekly_4 product_daily_7 store_daily_7 store_weekly_4",
    "onlineretail": "product_weekly_4",
    "onlineretail2": "product_weekly_4",
    "australianretail": "product_store_monthly_3 product_monthly_3 store_monthly_3",
    "kaggledemand": "product_store_weekly_4 store_weekly_4",
    "productdemand": "product_store_weekly_4 product_store_monthly_3 product_weekly_4 product_monthly_3",
    "vn1": "product_weekly_4",
    "kagglewalmart": "store_weekly_4",
    "hierarchicalsales": "product_daily_7 product_weekly_4 product_monthly_3",
    "carparts": "product_monthly_3",
    "fossil": "product_monthly_3",
}
DATASETS = tuple(_RUNS)
TASKS = {f"{d}_{r}": Task.parse(f"{d}_{r}") for d, runs in _RUNS.items() for r in runs.split()}
