"""Statistics, scalers and encoders, fitted on the periods up to a cutoff.

A fit is a small table with a row per series (or category); it is joined back, and Spark broadcasts it
only where its measured size allows. The cutoff is a literal, which reaches the scan, or a one-row table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.spec import Frequency, PanelSpec

STAT_QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)  # columns carry them in percent: dots in names would need quoting


def train_rows(panel: DataFrame, spec: PanelSpec, cutoff: date | DataFrame | None) -> DataFrame:
    """Rows up to the cutoff: a date, or a one-row table with the column ``cutoff``."""
    if cutoff is None:
        return panel
    if isinstance(cutoff, DataFrame):
        return panel.join(F.broadcast(cutoff.select(F.col("cutoff").alias("_cutoff"))), F.col(spec.time) <= F.col("_cutoff")).drop("_cutoff")
    return panel.where(F.col(spec.time) <= F.lit(cutoff))


def series_stats(panel: DataFrame, spec: PanelSpec, cutoff=None) -> DataFrame:
    """Per series of non-null targets: mean, population std, min, max, quantiles. Series without any are left out."""
    y = F.col(spec.target)
    q = F.percentile(y, F.array(*map(F.lit, STAT_QUANTILES)))
    out = train_rows(panel, spec, cutoff).where(y.isNotNull()).groupBy(spec.id).agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"), F.min(y).alias("min"), F.max(y).alias("max"), q.alias("_q"))
    return out.select(spec.id, "mean", "std", "min", "max", *(F.col("_q")[i].alias(f"quantile_{round(100 * x)}") for i, x in enumerate(STAT_QUANTILES)))


def encode_statistics(panel: DataFrame, spec: PanelSpec, cutoff=None) -> tuple[DataFrame, PanelSpec]:
    """Mean and sample std, skewness, excess kurtosis and quantiles of the (scaled) target as static features.

    Skewness, kurtosis and quantiles are 0 with fewer than four rows or where undefined; mean and std are columns but no features.
    """
    y = F.col(spec.target)
    q = F.percentile(y, F.array(*map(F.lit, STAT_QUANTILES)))
    stats = train_rows(panel, spec, cutoff).groupBy(spec.id).agg(F.count(y).alias("_n"), F.avg(y).alias("target_mean"), F.stddev_samp(y).alias("target_std"), F.skewness(y).alias("_s"), F.kurtosis(y).alias("_k"), q.alias("_q"))
    names = ["target_skewness", "target_kurtosis", *(f"target_quantile_{round(100 * x)}" for x in STAT_QUANTILES)]
    values = [F.col("_s"), F.col("_k"), *(F.col("_q")[i] for i in range(len(STAT_QUANTILES)))]
    safe = [F.when(F.col("_n") >= 4, v).alias(n) for n, v in zip(names, values, strict=True)]
    out = panel.join(stats.select(spec.id, "target_mean", "target_std", *safe), spec.id, "left")
    return out.withColumns({n: F.coalesce(F.when(~F.isnan(n), F.col(n)), F.lit(0.0)) for n in names}), spec.add("static", *names)


@dataclass(frozen=True)
class Scaler:
    """Per-series scaling of the target: ``standard``, ``max`` (default) or ``robust``."""

    kind: str = "max"
    quantile: float = 0.9

    def __post_init__(self):
        if self.kind not in ("standard", "max", "robust"):
            raise ValueError(f"unknown scaler {self.kind!r}")

    def fit(self, panel: DataFrame, spec: PanelSpec, cutoff=None) -> DataFrame:
        """Per series: ``_shift`` and ``_scale``; a scale of 0 or none becomes 1."""
        y = F.col(spec.target)
        if self.kind == "standard":
            shift, scale = F.avg(y), F.stddev_samp(y)
        elif self.kind == "max":
            shift, scale = F.lit(0.0), F.max(y)
        else:
            shift, scale = F.lit(0.0), F.greatest(F.percentile(y, F.lit(self.quantile)), F.min(F.when(y > 0, y)))
        safe = F.when((F.col("_scale") == 0) | F.isnan("_scale") | F.col("_scale").isNull(), 1.0).otherwise(F.col("_scale"))
        return train_rows(panel, spec, cutoff).groupBy(spec.id).agg(shift.alias("_shift"), scale.alias("_scale")).withColumn("_scale", safe)

    def _apply(self, panel: DataFrame, spec: PanelSpec, fitted: DataFrame, columns: list[str], expression) -> DataFrame:
        shift, scale = F.coalesce("_shift", F.lit(0.0)), F.coalesce("_scale", F.lit(1.0))
        return panel.join(fitted, spec.id, "left").withColumns({c: expression(F.col(c), shift, scale) for c in columns}).drop("_shift", "_scale")

    def transform(self, panel: DataFrame, spec: PanelSpec, fitted: DataFrame) -> DataFrame:
        return self._apply(panel, spec, fitted, [spec.target], lambda x, m, s: (x - m) / s)

    def inverse(self, panel: DataFrame, spec: PanelSpec, fitted: DataFrame, columns: list[str] | None = None) -> DataFrame:
        return self._apply(panel, spec, fitted, columns or [spec.target], lambda x, m, s: x * s + m)


def min_max(panel: DataFrame, spec: PanelSpec, cutoff=None) -> DataFrame:
    """Numeric, non-categorical exogenous columns to [0, 1] by the extremes of all rows (or those up to the cutoff); constant columns become 0."""
    numeric = [f.name for f in panel.schema.fields if f.name in spec.exogenous and f.name not in spec.categorical and isinstance(f.dataType, T.NumericType)]
    if not numeric:
        return panel
    ends = train_rows(panel, spec, cutoff).agg(*(F.min(c).cast("double").alias(f"_lo_{c}") for c in numeric), *(F.max(c).cast("double").alias(f"_hi_{c}") for c in numeric))
    lo, hi = (lambda c: F.col(f"_lo_{c}")), (lambda c: F.col(f"_hi_{c}"))
    out = panel.join(F.broadcast(ends))  # one row
    scaled = {c: F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c) - lo(c), hi(c) - lo(c)), F.lit(0.0))) for c in numeric}
    return out.withColumns(scaled).select(*panel.columns)


def mark_categorical(panel: DataFrame, spec: PanelSpec) -> PanelSpec:
    """Exogenous columns that aren't numeric count as categorical."""
    return spec.add("categorical", *(f.name for f in panel.schema.fields if f.name in spec.exogenous and not isinstance(f.dataType, T.NumericType)))


def encode_categories(panel: DataFrame, spec: PanelSpec, cutoff=None) -> tuple[DataFrame, PanelSpec]:
    """``<column>_encoded``: (sum of train targets + prior) / (count + 1), prior the train mean; unseen, null and single values get the prior."""
    if not spec.categorical:
        return panel, spec
    train = train_rows(panel, spec, cutoff)
    out = panel.join(F.broadcast(train.agg(F.avg(spec.target).alias("_prior"))))  # one row
    for c in spec.categorical:
        sums = train.where(F.col(c).isNotNull()).groupBy(c).agg(F.sum(spec.target).alias("_sum"), F.count(spec.target).alias("_n"))
        value = F.when(F.col("_n") > 1, (F.col("_sum") + F.col("_prior")) / (F.col("_n") + 1))
        out = out.join(sums, c, "left").withColumn(f"{c}_encoded", F.coalesce(value, F.col("_prior"))).drop("_sum", "_n")
    names = {c: f"{c}_encoded" for c in spec.categorical}
    return out.select(*panel.columns, *names.values()), spec.rename(names).remove(*names.values(), role="categorical")


def calendar_features(frequency: Frequency, time: str = "ds") -> dict[str, Column]:
    """Sine and cosine of the month, and for daily panels of the weekday (Monday 0)."""
    turn = lambda x, n: F.lit(2 * math.pi) * x / F.lit(float(n))
    month, day = turn(F.month(time), 12), turn(F.weekday(time), 7)
    out = {"month_sin": F.sin(month), "month_cos": F.cos(month)}
    return ({"weekday_sin": F.sin(day), "weekday_cos": F.cos(day)} if frequency is Frequency.DAILY else {}) | out


def add_calendar(panel: DataFrame, spec: PanelSpec, frequency: Frequency) -> tuple[DataFrame, PanelSpec]:
    features = calendar_features(frequency, spec.time)
    return panel.withColumns(features), spec.add("future", *features)


def prepare(panel: DataFrame, spec: PanelSpec, frequency: Frequency, scaler: Scaler, cutoff) -> tuple[DataFrame, PanelSpec, DataFrame]:
    """Min-max, target scaling, calendar, category and statistics encoding, in this order; also returns the scaler's fit."""
    spec = mark_categorical(panel, spec)
    out = min_max(panel, spec)
    fitted = scaler.fit(out, spec, cutoff)
    out, spec = add_calendar(scaler.transform(out, spec, fitted), spec, frequency)
    out, spec = encode_categories(out, spec, cutoff)
    out, spec = encode_statistics(out, spec, cutoff)
    return out, spec, fitted
