"""Rolling-origin window arithmetic, on numbers and on columns. Positions count periods from one."""

from __future__ import annotations

import inspect
import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def train_periods(periods: int, share: float = 0.8) -> int:
    return round(share * periods)  # half to even


def window_count(periods: int, share: float = 0.8, step: int = 1) -> int:
    return periods - train_periods(periods, share) - step + 1


def backtest_offset(horizon: int, windows: int, step: int = 1) -> int:
    """Periods between the first cutoff and the end."""
    return horizon + step * (windows - 1)


def feasible_windows(windows: int, shortest: int, validation: int, input_size: int, horizon: int, step: int = 1) -> int:
    """Windows that the shortest series can feed, one at least; a smaller number than asked for is reported."""
    room = max(0, shortest - validation - input_size - 2 * horizon)
    found = max(1, min(windows, room // step + 1))
    if found < windows:
        log.warning("%d windows instead of %d: the shortest series has %d periods", found, windows, shortest)
    return found


def validation_periods(horizon: int, given: int = 0) -> int:
    """Periods held back for validation: one horizon unless given."""
    return given or horizon


def longest_input(horizon: int, defaults: tuple[int | None, ...] = ()) -> int:
    """An upper bound of the periods that window models read: the longest candidate of a search, or a model's own default."""
    # fixed values: the candidates of the search
    searched = (4, horizon // 2, 6, horizon, min(14, 2 * horizon))
    return max(*searched, *(d for d in defaults if d is not None))


def taken(engine: Callable, inputs: dict[str, object]) -> dict[str, object]:
    """Those of ``inputs`` that ``engine`` has a parameter for; all of them where it takes any keyword."""
    wanted = inspect.signature(engine).parameters
    if any(p.kind is inspect.Parameter.VAR_KEYWORD for p in wanted.values()):
        return dict(inputs)
    return {name: value for name, value in inputs.items() if name in wanted}


@dataclass(frozen=True)
class Windows:
    """Columns over a one-row calendar (start, end, periods), so that no value has to reach the driver."""

    horizon: int
    share: float = 0.8
    step: int = 1

    def count(self, periods: Column) -> Column:
        return (periods - F.bround(periods * self.share, 0).cast("int") - F.lit(self.step) + 1).cast("int")

    def first(self, periods: Column) -> Column:
        return (periods - F.lit(self.horizon) - F.lit(self.step) * (self.count(periods) - 1)).cast("int")

    def last(self, periods: Column) -> Column:
        return (periods - F.lit(self.horizon)).cast("int")
