"""Models that are window expressions: seasonal naive and historic average, with normal intervals.

All windows of a series come from one shuffle by series. A forecast for position t made at cutoff
t - i is a lag of the target or of a running statistic, so there is no join and no loop over cutoffs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.levels import QUANTILES, normal_quantile
from ..plans.spec import PanelSpec
from ..plans.windows import Windows
from .backtest import splits


def _long(rows: DataFrame, spec: PanelSpec, model: str, point: Column, sigma: Column, quantiles: tuple[float, ...]) -> DataFrame:
    values = F.array(
        F.struct(F.lit(None).cast("double").alias("q"), point.alias("value")),
        *(F.struct(F.lit(q).alias("q"), (point if abs(q - 0.5) < 1e-9 else normal_quantile(point, sigma, q)).alias("value")) for q in quantiles),
    )
    cells = rows.select(F.col(spec.id).alias("id"), F.col(spec.time).alias("ds"), "ct", "step", F.col(spec.target).alias("y"), F.explode(values).alias("c"))
    return cells.select("id", "ds", "ct", "step", "y", F.lit(model).alias("model"), "c.q", "c.value")


def _at_cutoff(name: str, horizon: int, own) -> Column:
    """The statistic ``name`` as it stood 1 .. horizon rows ago, by step."""
    return F.array(*(F.lag(name, k).over(own) for k in range(1, horizon + 1)))


def seasonal_naive(panel: DataFrame, spec: PanelSpec, windows: Windows, season: int, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Step i repeats position ct - s + ((i - 1) mod s) + 1; null with less history than a season.

    Interval: normal with sigma * sqrt(floor((i - 1) / s) + 1), sigma^2 the sum of squared seasonal differences up to the cutoff over n - s.
    """
    own = Window.partitionBy(spec.id).orderBy("t")
    run = own.rowsBetween(Window.unboundedPreceding, 0)
    h = windows.horizon
    wraps = (h - 1) // season + 1
    out = panel.withColumn("_d", F.col(spec.target) - F.lag(spec.target, season).over(own))
    out = out.withColumn("_v", F.sum(F.col("_d") * F.col("_d")).over(run))
    out = out.withColumns({"_vs": _at_cutoff("_v", h, own), "_ys": F.array(*(F.lag(spec.target, season * k).over(own) for k in range(1, wraps + 1)))})
    rows = splits(out, windows)
    turn = F.floor((F.col("step") - 1) / season).cast("int")
    sigma = F.sqrt(F.try_divide(F.col("_vs")[F.col("step") - 1], F.col("ct") - season)) * F.sqrt(turn + 1)
    point = F.when(F.col("ct") >= season, F.col("_ys")[turn])
    return _long(rows, spec, "SEASONAL_NAIVE", point, sigma, quantiles)


def historic_average(panel: DataFrame, spec: PanelSpec, windows: Windows, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """The mean up to the cutoff; interval: normal with s * sqrt(1 + 1/n), s the sample standard deviation."""
    own = Window.partitionBy(spec.id).orderBy("t")
    run = own.rowsBetween(Window.unboundedPreceding, 0)
    h = windows.horizon
    out = panel.withColumns({"_m": F.avg(spec.target).over(run), "_s": F.stddev_samp(spec.target).over(run)})
    out = out.withColumns({"_ms": _at_cutoff("_m", h, own), "_ss": _at_cutoff("_s", h, own)})
    rows, at = splits(out, windows), F.col("step") - 1
    return _long(rows, spec, "HISTORIC_AVERAGE", F.col("_ms")[at], F.col("_ss")[at] * F.sqrt(1 + F.try_divide(F.lit(1.0), F.col("ct"))), quantiles)
