"""Nineteen metrics per series and model, in one aggregation over the forecast table.

Errors are summed per (series, model, cutoff) with partial aggregation; stock metrics use the at most ``horizon`` rows of a
window as one small array; scales are one row per series. Undefined values (scale 0 without a guard) are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import QUANTILES
from ..plans.spec import PanelSpec
from ..plans.windows import Windows
from .backtest import seasonal_scale, train_scale

POINT = ("MAE", "MSE", "RMSE", "MASE", "MSSE", "RMSSE", "SPEC", "SSPEC", "APIS", "SAPIS", "SMAE", "SRMSE", "SBIAS", "SABSBIAS")
PROBABILISTIC = {"SMQL": None, "SQL_60": 0.6, "SQL_70": 0.7, "SQL_80": 0.8, "SQL_90": 0.9}
METRICS = (*POINT, *PROBABILISTIC)
EPSILON = 1e-8


def pinball(y: Column, f: Column, q: Column) -> Column:
    return F.greatest(q * (y - f), (q - 1) * (y - f))


def spec_cost(window: Column, a1: float = 1.0, a2: float = 1.0) -> Column:
    """Stock-keeping cost of a window, an array of (step, y, f) in order: mean over t of the sum over i <= t of
    max(0, a1 * min(y_i, Y_i - F_t), a2 * min(f_i, F_i - Y_t)) * (t - i + 1), with cumulative Y and F."""
    zero = F.array().cast("array<struct<y:double,f:double,cy:double,cf:double>>")

    def push(acc: Column, x: Column) -> Column:
        cy = F.when(F.size(acc) > 0, F.try_element_at(acc, F.lit(-1))["cy"]).otherwise(0.0) + x["y"]
        cf = F.when(F.size(acc) > 0, F.try_element_at(acc, F.lit(-1))["cf"]).otherwise(0.0) + x["f"]
        return F.concat(acc, F.array(F.struct(x["y"].alias("y"), x["f"].alias("f"), cy.alias("cy"), cf.alias("cf"))))

    summed = F.aggregate(window, zero, push)
    indexed = F.transform(summed, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    cost = lambda t, i: F.greatest(F.lit(0.0), a1 * F.least(i["x"]["y"], i["x"]["cy"] - t["x"]["cf"]), a2 * F.least(i["x"]["f"], i["x"]["cf"] - t["x"]["cy"])) * (t["i"] - i["i"] + 1)
    inner = lambda t: F.aggregate(F.slice(indexed, F.lit(1), t["i"] + 1), F.lit(0.0), lambda a, i: a + cost(t, i))
    return F.aggregate(indexed, F.lit(0.0), lambda a, t: a + inner(t)) / F.size(window)


def point_metrics(forecasts: DataFrame, scale: DataFrame, seasonal: DataFrame, a1: float = 1.0, a2: float = 1.0) -> DataFrame:
    """Wide: id, model and a column per metric of POINT, from rows with null ``q`` and a value."""
    rows = forecasts.where("q IS NULL AND value IS NOT NULL")
    e = F.col("value") - F.col("y")
    window = F.transform(F.array_sort(F.collect_list(F.struct("step", "y", F.col("value").alias("f")))), lambda x: F.struct(x["y"].cast("double").alias("y"), x["f"].alias("f")))
    cut = rows.groupBy("id", "model", "ct").agg(F.count("*").alias("n"), F.sum(F.abs(e)).alias("ae"), F.sum(e * e).alias("se"), F.sum(e).alias("be"), window.alias("w"))
    n = F.size("w")
    # the double cumulative sum of errors weighs the error at t by n - t + 1
    apis = F.abs(F.aggregate(F.transform("w", lambda x, i: (n - i) * (x["y"] - x["f"])), F.lit(0.0), lambda a, x: a + x))
    cut = cut.select("id", "model", "n", "ae", "se", "be", spec_cost(F.col("w"), a1, a2).alias("spec"), apis.alias("apis"), F.abs(F.col("be") / F.col("n")).alias("absbias"))
    one = cut.groupBy("id", "model").agg(*(F.sum(c).alias(c) for c in ("n", "ae", "se", "be")), F.avg("spec").alias("SPEC"), F.avg("apis").alias("APIS"), F.avg("absbias").alias("absbias"))
    out = one.join(scale, "id", "left").join(seasonal, "id", "left")
    guarded = F.greatest(F.abs("scale"), F.lit(EPSILON))
    mae, mse = F.col("ae") / F.col("n"), F.col("se") / F.col("n")
    values = {
        "MAE": mae, "MSE": mse, "RMSE": F.sqrt(mse),
        "MASE": F.try_divide(mae, F.col("absolute")), "MSSE": F.try_divide(mse, F.col("squared")), "RMSSE": F.sqrt(F.try_divide(mse, F.col("squared"))),
        "SPEC": F.col("SPEC"), "SSPEC": F.try_divide(F.col("SPEC"), F.col("scale")), "APIS": F.col("APIS"), "SAPIS": F.try_divide(F.col("APIS"), F.col("scale")),
        "SMAE": mae / guarded, "SRMSE": F.sqrt(mse) / guarded, "SBIAS": F.col("be") / F.col("n") / guarded, "SABSBIAS": F.col("absbias") / guarded,
    }
    return out.select("id", "model", *(v.alias(k) for k, v in values.items()))


def quantile_metrics(forecasts: DataFrame, seasonal: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Wide: id, model, SMQL over the grid and the single-quantile losses, all over the mean absolute seasonal difference."""
    rows = forecasts.where("q IS NOT NULL AND value IS NOT NULL")
    loss = pinball(F.col("y"), F.col("value"), F.col("q"))
    in_grid = F.lit(False)
    for q in quantiles:
        in_grid = in_grid | (F.abs(F.col("q") - q) < 1e-9)
    losses = [F.avg(F.when(in_grid if q is None else F.abs(F.col("q") - q) < 1e-9, loss)).alias(m) for m, q in PROBABILISTIC.items()]
    one = rows.groupBy("id", "model").agg(*losses).join(seasonal, "id", "left")
    return one.select("id", "model", *(F.try_divide(F.col(m), F.col("absolute")).alias(m) for m in PROBABILISTIC))


def evaluate(forecasts: DataFrame, panel: DataFrame, spec: PanelSpec, windows: Windows, season: int, metrics: tuple[str, ...] = METRICS, scale_on: str = "first", quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """Long: id, metric, model, error for the metrics asked for."""
    unknown = [m for m in metrics if m not in METRICS]
    if unknown:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    seasonal = seasonal_scale(panel, spec, windows, season, scale_on).withColumnRenamed(spec.id, "id")
    scale = train_scale(panel, spec, windows).withColumnRenamed(spec.id, "id")
    parts = []
    if any(m in POINT for m in metrics):
        parts.append(melt(point_metrics(forecasts, scale, seasonal), tuple(m for m in metrics if m in POINT)))
    if any(m in PROBABILISTIC for m in metrics):
        parts.append(melt(quantile_metrics(forecasts, seasonal, quantiles), tuple(m for m in metrics if m in PROBABILISTIC)))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def melt(wide: DataFrame, metrics: tuple[str, ...]) -> DataFrame:
    """id, model, a column per metric -> id, metric, model, error."""
    return wide.unpivot(["id", "model"], list(metrics), "metric", "error").select("id", F.upper("metric").alias("metric"), "model", "error")


def melt_models(wide: DataFrame, metrics: tuple[str, ...] | None = None) -> DataFrame:
    """id, metric, a column per model -> id, metric, model, error; metric names in capitals, only those asked for."""
    models = [c for c in wide.columns if c not in ("id", "metric")]
    out = wide.withColumn("metric", F.upper("metric")).unpivot(["id", "metric"], models, "model", "error")
    return out.where(F.col("metric").isin(*metrics)) if metrics else out


def by_model(long: DataFrame, models: list[str]) -> DataFrame:
    """id, metric and a column per model."""
    return long.groupBy("id", "metric").agg(*(F.max(F.when(F.col("model") == m, F.col("error"))).alias(m) for m in models))


def summary(long: DataFrame) -> DataFrame:
    """Per metric and model: mean, population std, min, max."""
    e = F.col("error")
    return long.groupBy("metric", "model").agg(F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"), F.min(e).alias("min"), F.max(e).alias("max"))


def box_data(long: DataFrame) -> DataFrame:
    """What a box plot draws, per metric and model: quartiles, whisker ends within 1.5 quartile ranges, mean."""
    q = long.groupBy("metric", "model").agg(F.percentile("error", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.avg("error").alias("mean"))
    q = q.select("metric", "model", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "mean")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = long.join(F.broadcast(q), ["metric", "model"]).where(F.col("error").between(F.col("q1") - reach, F.col("q3") + reach))  # a row per metric and model
    ends = inside.groupBy("metric", "model").agg(F.min("error").alias("low"), F.max("error").alias("high"))
    return q.join(ends, ["metric", "model"])
