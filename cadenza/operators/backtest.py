"""Rolling-origin backtests as one plan: cutoffs, windows, forecasts in long and wide form, checks.

A forecast table is long: id, ds, ct (position of the cutoff), step, y, model, q (null: point), value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.levels import column_name
from ..plans.spec import Frequency, PanelSpec
from ..plans.windows import Windows
from .panel import calendar, shift

KEY = ("id", "ct", "step")


def cutoffs(panel: DataFrame, spec: PanelSpec, frequency: Frequency, windows: Windows) -> DataFrame:
    """(window, ct, cutoff): a row per window, whatever the number of series."""
    cal = calendar(panel, frequency, spec.time)
    n, first = windows.count(F.col("periods")), windows.first(F.col("periods"))
    rows = cal.select("start", first.alias("first"), F.explode(F.sequence(F.lit(0), n - 1)).alias("window"))
    return rows.select("window", (F.col("first") + F.col("window") * windows.step).alias("ct")).join(F.broadcast(cal.select("start"))).select("window", "ct", shift(F.col("start"), F.col("ct") - 1, frequency).alias("cutoff"))


def splits(panel: DataFrame, windows: Windows) -> DataFrame:
    """Validation rows of every window of a completed panel: a row at t belongs to the cutoffs t-h .. t-1 that exist; no join."""
    steps = panel.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(windows.horizon)))).withColumn("ct", F.col("t") - F.col("step"))
    first, last = windows.first(F.col("periods")), windows.last(F.col("periods"))
    return steps.where(F.col("ct").between(first, last) & ((F.col("ct") - first) % windows.step == 0))


def context(panel: DataFrame, spec: PanelSpec, ct, length: int) -> DataFrame:
    """The last ``length`` rows up to a cutoff position (a column or number)."""
    at = F.lit(ct) if isinstance(ct, int) else ct
    return panel.where((F.col("t") <= at) & (F.col("t") > at - F.lit(length)))


def train_scale(panel: DataFrame, spec: PanelSpec, windows: Windows) -> DataFrame:
    """(id, scale): mean over the cutoffs of the mean target up to each, from running means."""
    run = Window.partitionBy(spec.id).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    means = panel.withColumn("_m", F.avg(spec.target).over(run))
    first, last = windows.first(F.col("periods")), windows.last(F.col("periods"))
    return means.where(F.col("t").between(first, last) & ((F.col("t") - first) % windows.step == 0)).groupBy(spec.id).agg(F.avg("_m").alias("scale"))


def seasonal_scale(panel: DataFrame, spec: PanelSpec, windows: Windows, season: int, on: str = "first") -> DataFrame:
    """(id, absolute, squared): mean absolute and squared seasonal differences of the rows up to the first cutoff (``on='all'``: all rows)."""
    diffs = panel.withColumn("_d", F.col(spec.target) - F.lag(spec.target, season).over(Window.partitionBy(spec.id).orderBy("t")))
    if on == "first":
        diffs = diffs.where(F.col("t") <= windows.first(F.col("periods")))
    return diffs.groupBy(spec.id).agg(F.avg(F.abs("_d")).alias("absolute"), F.avg(F.col("_d") * F.col("_d")).alias("squared"))


def to_wide(forecasts: DataFrame, models: list[str], quantiles: list[float | None]) -> DataFrame:
    """id, ds, ct, step, y and a column per model and quantile; names are known, so one aggregation does."""
    same = lambda q: F.col("q").isNull() if q is None else F.abs(F.col("q") - q) < 1e-9
    cells = [F.max(F.when((F.col("model") == m) & same(q), F.col("value"))).alias(column_name(m, q)) for m in models for q in quantiles]
    return forecasts.groupBy("id", "ds", "ct", "step", "y").agg(*cells)


def to_long(wide: DataFrame, models: list[str], quantiles: list[float | None]) -> DataFrame:
    present = [(m, q) for m in models for q in quantiles if column_name(m, q) in wide.columns]
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("model"), F.lit(q).cast("double").alias("q"), F.col(f"`{column_name(m, q)}`").cast("double").alias("value")) for m, q in present)))
    return wide.select("id", "ds", "ct", "step", "y", cells.alias("c")).select("id", "ds", "ct", "step", "y", "c.*").where("value IS NOT NULL")


def with_points(wide: DataFrame, models: list[str]) -> DataFrame:
    """Each model's point column: its own, else its median, else its mean."""
    out = wide
    for m in models:
        if m in wide.columns:
            continue
        source = next((c for c in (f"{m}-median", f"{m}-mean") if c in wide.columns), None)
        if source is None:
            raise ValueError(f"{m} has no point forecast")
        out = out.withColumn(m, F.col(f"`{source}`"))
    return out


def trim(wide: DataFrame, models: list[str], levels: list[int]) -> DataFrame:
    """Keys, truth, points, and the bounds of the levels asked for."""
    keep = [c for c in ("id", "ds", "ct", "step", "y") if c in wide.columns]
    keep += [c for m in models for c in (m, f"{m}-median", *(f"{m}-{s}-{x}" for x in levels for s in ("lo", "hi"))) if c in wide.columns]
    return wide.select(*(F.col(f"`{c}`") for c in keep))


def combine(*tables: DataFrame) -> DataFrame:
    """Forecasts of several engines; of repeated (id, cutoff, step, model, quantile), the first table's stays."""
    ranked = [t.withColumn("_from", F.lit(k)) for k, t in enumerate(tables)]
    out = ranked[0]
    for t in ranked[1:]:
        out = out.unionByName(t)
    first = F.row_number().over(Window.partitionBy("id", "ct", "step", "model", "q").orderBy("_from", "value"))
    return out.withColumn("_n", first).where("_n = 1").drop("_n", "_from")


def combine_wide(left: DataFrame, right: DataFrame) -> DataFrame:
    """Column-wise outer alignment on (id, ds, ct, step); columns both have come from the left."""
    keys = ["id", "ds", "ct", "step"]
    own = [c for c in right.columns if c not in left.columns]
    shared = [c for c in right.columns if c in left.columns and c not in keys]
    other = right.select(*keys, *(F.col(f"`{c}`") for c in own), *(F.col(f"`{c}`").alias(f"_r_{c}") for c in shared))
    out = left.join(other, keys, "full_outer")
    return out.select(*keys, *(F.coalesce(F.col(f"`{c}`"), F.col(f"`_r_{c}`")).alias(c) if c in shared else F.col(f"`{c}`") for c in [*(c for c in left.columns if c not in keys), *own]))


def drop_dead(forecasts: DataFrame) -> DataFrame:
    """Long form without models that have no value."""
    alive = forecasts.groupBy("model").agg(F.count(F.when(~F.isnan("value"), F.col("value"))).alias("_n")).where("_n > 0")
    return forecasts.join(F.broadcast(alive.select("model")), "model", "left_semi")  # a row per model


def value_shares(forecasts: DataFrame) -> DataFrame:
    """(model, share of rows with a value)."""
    return forecasts.groupBy("model").agg(F.avg((F.col("value").isNotNull() & ~F.isnan("value")).cast("int")).alias("share"))


def check(forecasts: DataFrame, panel: DataFrame | None = None, windows: Windows | None = None) -> None:
    """Raise if there are no forecasts, none has a value, or one (id, cutoff, step, model, quantile) has several rows or a window is incomplete."""
    totals = forecasts.agg(F.count("*").alias("rows"), F.count(F.when(~F.isnan("value"), F.col("value"))).alias("valued")).first()
    if not totals["rows"]:
        raise ValueError("no forecasts")
    if not totals["valued"]:
        raise ValueError("no model has a value")
    if forecasts.groupBy("id", "ct", "step", "model", "q").count().where("count > 1").limit(1).count():
        raise ValueError("a forecast has several rows")
    if panel is not None and windows is not None:
        wanted = splits(panel, windows).select(*KEY)
        models = forecasts.select("model").distinct()
        if wanted.join(F.broadcast(models)).join(forecasts.where("q IS NULL").select(*KEY, "model"), [*KEY, "model"], "left_anti").limit(1).count():
            raise ValueError("a window lacks forecasts")
