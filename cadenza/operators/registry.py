"""Model registry: what runs here, and adapters for models whose libraries are not installed."""

from __future__ import annotations

import importlib.util
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.levels import QUANTILES
from ..plans.spec import PanelSpec
from ..plans.windows import Windows
from .models import historic_average, seasonal_naive
from .recursive import RECURSIVE, recursive


class Backend(Protocol):
    """What an adapter plugs in: long forecasts of a completed panel."""

    def cross_validate(self, panel: DataFrame, spec: PanelSpec, windows: Windows, season: int, quantiles: tuple[float, ...]) -> DataFrame: ...


@dataclass(frozen=True)
class ModelEntry:
    name: str
    framework: str  # stats, neural or foundation
    needs: str | None = None


NEURAL = "TRANSFORMER MLP LSTM TIMESNET FEDFORMER TIDE NHITS NBEATS DEEPAR BITCN GRU TCN TFT PATCHTST XLSTM".split()
FOUNDATION = {"CHRONOS": "chronos", "MOIRAI": "uni2ts", "TIREX": "tirex", "TIMESFM": "timesfm"}
REGISTRY = {n: ModelEntry(n, "stats") for n in ("SEASONAL_NAIVE", "HISTORIC_AVERAGE", *RECURSIVE)}
REGISTRY |= {n: ModelEntry(n, "neural", "neuralforecast") for n in NEURAL} | {n: ModelEntry(n, "foundation", lib) for n, lib in FOUNDATION.items()}
_BACKENDS: dict[str, Backend] = {}


def register_backend(name: str, backend: Backend) -> None:
    if name not in REGISTRY:
        raise ValueError(f"unknown model {name!r}")
    _BACKENDS[name] = backend


def resolve(names: list[str]) -> list[ModelEntry]:
    missing = [n for n in names if n not in REGISTRY]
    if missing:
        raise ValueError(f"unknown models: {', '.join(missing)}")
    return [REGISTRY[n] for n in dict.fromkeys(names)]


def cross_validate(panel: DataFrame, spec: PanelSpec, windows: Windows, season: int, names: list[str], quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Forecasts of all models over all windows, in one long table; the models' plans are united, not run in turn."""
    out = None
    for entry in resolve(names):
        if entry.name in _BACKENDS:
            own = _BACKENDS[entry.name].cross_validate(panel, spec, windows, season, quantiles)
        elif entry.needs:
            state = "has no backend registered" if importlib.util.find_spec(entry.needs) else f"needs the library {entry.needs}, which isn't installed"
            raise NotImplementedError(f"{entry.name} {state}; see register_backend")
        elif entry.name == "SEASONAL_NAIVE":
            own = seasonal_naive(panel, spec, windows, season, quantiles)
        elif entry.name == "HISTORIC_AVERAGE":
            own = historic_average(panel, spec, windows, quantiles)
        else:
            own = recursive(panel, spec, windows, season, entry.name, quantiles)
        out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no models")
    return out


def best_trial(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Per key, the parameters of the least loss; losses that are null, NaN, infinite or under 1e-9 are refused. Ties: the least parameters."""
    loss = F.col("loss")
    sound = trials.where(loss.isNotNull() & ~F.isnan(loss) & (loss >= 1e-9) & (loss < float("inf")))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("loss", "params"))
    return sound.withColumn("_n", first).where("_n = 1").select(*keys, "params", "loss")
