"""Operators on small panels with results worked out by hand."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import backtest, features, metrics, panel, recursive
from cadenza.operators.registry import best_trial, cross_validate, register_backend
from cadenza.plans.config import Config
from cadenza.plans.runner import JsonTracker, TaskPlan, run_task
from cadenza.plans.spec import Frequency, Hierarchy, PanelSpec, Task
from cadenza.plans.windows import Windows
from cadenza.sources import files
from cadenza.streaming.rollup import rolling_demand

D = date(2024, 1, 1)


def frame(spark, rows, schema="id string, ds date, y double"):
    return spark.createDataFrame(rows, schema)


def days(values, name="a"):
    return [(name, D + timedelta(days=k), None if v is None else float(v)) for k, v in enumerate(values)]


def test_gap_fill_and_fills_stay_within_series(spark):
    rows = [("a", D, 1.0, 5.0), ("a", D + timedelta(days=2), 2.0, None), ("b", D + timedelta(days=1), 3.0, None)]
    spec = PanelSpec(past=("x",))
    df = frame(spark, rows, "id string, ds date, y double, x double")
    full = panel.complete(df, spec, Frequency.DAILY)
    got = {(r["id"], r["t"]): (r["y"], r["x"]) for r in panel.fill(full, spec).collect()}
    assert got == {("a", 1): (1.0, 5.0), ("a", 2): (0.0, 5.0), ("a", 3): (2.0, 5.0), ("b", 1): (0.0, None), ("b", 2): (3.0, None), ("b", 3): (0.0, None)}
    leaky = {(r["id"], r["t"]): r["x"] for r in panel.fill(full, spec, across=True).collect()}
    assert leaky[("b", 3)] == 5.0
    assert panel.complete(df.limit(0), spec, Frequency.DAILY).count() == 0


def test_month_ends_clamp(spark):
    r = spark.createDataFrame([(date(2024, 3, 31),)], "d date").select(panel.shift(F.col("d"), -1, Frequency.MONTHLY).alias("d")).first()
    assert r["d"] == date(2024, 2, 29)


def test_cutoffs_and_splits_of_thirty_days(spark):
    p = panel.complete(frame(spark, days(range(30))), PanelSpec(), Frequency.DAILY)
    w = Windows(7)
    cuts = [(r["ct"], r["cutoff"]) for r in backtest.cutoffs(p, PanelSpec(), Frequency.DAILY, w).orderBy("ct").collect()]
    assert [c for c, _ in cuts] == list(range(18, 24)) and cuts[0][1] == D + timedelta(days=17)
    s = backtest.splits(p, w).collect()
    assert len(s) == 42 and all(r["t"] == r["ct"] + r["step"] for r in s)


@pytest.mark.parametrize(
    "y,f,want",
    [
        ([1, 2, 3, 4], [1, 2, 3, 4], {"MAE": 0, "SPEC": 0, "APIS": 0, "SBIAS": 0}),
        ([0, 0, 5, 0], [0, 5, 0, 0], {"SPEC": 1.25, "APIS": 5, "MAE": 2.5, "RMSE": 3.535534, "SBIAS": 0}),
        ([0, 5, 0, 0], [0, 0, 5, 0], {"SPEC": 1.25, "APIS": 5}),
        ([2, 0, 3, 1], [1, 1, 1, 1], {"SPEC": 1.5, "APIS": 5, "MAE": 1, "RMSE": 1.224745, "SBIAS": -0.5}),
    ],
)
def test_metrics_by_hand(spark, y, f, want):
    rows = [("a", 10, k + 1, float(a), "M", None, float(b)) for k, (a, b) in enumerate(zip(y, f))]
    fc = spark.createDataFrame(rows, "id string, ct int, step int, y double, model string, q double, value double")
    scale = spark.createDataFrame([("a", 1.0)], "id string, scale double")
    seasonal = spark.createDataFrame([("a", 0.0, 0.0)], "id string, absolute double, squared double")
    r = metrics.point_metrics(fc, scale, seasonal).first()
    assert {k: round(r[k], 6) for k in want} == want
    assert r["MASE"] is None


def test_statistics_of_five_values(spark):
    df = frame(spark, days([1, 2, 4, 9, 20]) + days([3, 3, 3, 3], "c") + days([1, 2, 3], "s"))
    s = features.series_stats(df, PanelSpec()).where("id = 'a'").first()
    assert [round(s[f"quantile_{q}"], 6) for q in (10, 25, 50, 75, 90)] == [1.4, 2, 4, 9, 15.6] and round(s["std"], 6) == 6.968501
    out, spec = features.encode_statistics(df, PanelSpec())
    got = {r["id"]: r for r in out.collect()}
    assert round(got["a"]["target_skewness"], 6) == 0.999603 and round(got["a"]["target_kurtosis"], 6) == -0.526142 and round(got["a"]["target_std"], 6) == 7.79102
    assert got["c"]["target_skewness"] == got["c"]["target_kurtosis"] == 0
    assert got["s"]["target_quantile_50"] == 0 and len(spec.static) == 7


@pytest.mark.parametrize("kind", ["standard", "max", "robust"])
def test_scalers_invert_and_guard_zero(spark, kind):
    df, s = frame(spark, days([0, 0, 0], "z") + days([1, 5, 9])), features.Scaler(kind)
    fit = s.fit(df, PanelSpec())
    scaled = s.transform(df, PanelSpec(), fit)
    assert [r["y"] for r in scaled.where("id = 'z'").collect()] == [0, 0, 0]
    assert sorted(round(r["y"], 9) for r in s.inverse(scaled, PanelSpec(), fit).collect()) == [0, 0, 0, 1, 5, 9]
    with pytest.raises(ValueError):
        features.Scaler("other")


def test_no_look_ahead(spark):
    df = frame(spark, days([1, 2, 100]))
    assert features.Scaler("max").fit(df, PanelSpec(), D + timedelta(days=1)).first()["_scale"] == 2


def test_category_encoding(spark):
    rows = [("a", D, 4.0, "x"), ("a", D + timedelta(days=1), 2.0, "x"), ("b", D, 6.0, "single"), ("b", D + timedelta(days=5), 9.0, "unseen"), ("b", D + timedelta(days=6), 9.0, None)]
    df = frame(spark, rows, "id string, ds date, y double, k string")
    spec = features.mark_categorical(df, PanelSpec(future=("k",)))
    out, new = features.encode_categories(df, spec, D + timedelta(days=1))
    got = {r["k"]: r["k_encoded"] for r in out.collect()}
    assert got == {"x": (6 + 4) / 3, "single": 4.0, "unseen": 4.0, None: 4.0} and new.future == ("k_encoded",)


def one(y, params=(0.1, 0.1)):
    return np.array(y, float)[None, :], np.array([params], float), np.array([len(y)])


def test_intermittent_models_by_hand():
    y = [0, 3, 0, 0, 6, 0, 2, 0]
    assert round(float(recursive.croston(*one(y))[0, 0]), 6) == 1.440909
    chance, size, _ = (float(x[0, 0]) for x in recursive.tsb(*one(y)))
    assert (round(chance, 6), round(size, 6), round(chance * size, 6)) == (0.216044, 3.17, 0.68486)
    assert recursive.croston(*one([0] * 4))[0, 0] == 0 and recursive.tsb(*one([0] * 4))[1][0, 0] == 0


def plain_levels(values, alpha):
    out = values[:1]
    for v in values[1:]:
        out.append(alpha * v + (1 - alpha) * out[-1])
    return out


def plain_fitted(y, a, b, kind):
    """One value a period, known before it: None before the first demand."""
    out = []
    for t in range(len(y)):
        at = [k for k in range(t) if y[k] > 0]
        if not at:
            out.append(None)
            continue
        size = plain_levels([y[k] for k in at], a)[-1]
        if kind == "croston":
            out.append(0.95 * size / plain_levels([float(k - j) for j, k in zip([-1, *at], at)], b)[-1])
        else:
            out.append(size * plain_levels([float(v != 0) for v in y[:t]], b)[-1])
    return out


def demand(seed, n=40, share=0.4):
    r = np.random.default_rng(seed)
    return np.where(r.random(n) < share, r.integers(1, 9, n), 0).astype(float)


def test_matrices_equal_a_plain_loop_per_series_and_cutoff():
    series, cuts = np.stack([demand(1), demand(2, share=0.1), np.zeros(40), demand(3, share=1.0)]), np.array([1, 7, 25, 40])
    params = np.array([(0.2, 0.1), (0.05, 0.3), (0.1, 0.1), (0.3, 0.05)])
    c, (chance, size, sigma) = recursive.croston(series, params, cuts), recursive.tsb(series, params, cuts)
    for k, y in enumerate(series):
        for j, cut in enumerate(cuts):
            f = [plain_fitted([*y[:cut], 0], *params[k], kind) for kind in ("croston", "tsb")]
            assert np.isclose(c[k, j], 0.95 * y[cut - 1] if f[0][-1] is None else f[0][-1])
            assert np.isclose(chance[k, j] * size[k, j], f[1][-1] or 0)
            e = [v - x for v, x in zip(f[1][:-1], y) if v is not None]
            assert np.isclose(sigma[k, j], np.sqrt(sum(x * x for x in e) / cut) if f[1][-1] is not None else 0)


@pytest.mark.parametrize("tune,kind,grid", [(recursive.tune_croston, "croston", recursive.CROSTON_GRID), (recursive.tune_tsb, "tsb", recursive.TSB_GRID)])
def test_tuning_finds_the_least_error(tune, kind, grid):
    series = np.stack([demand(5), demand(6, share=0.15), np.zeros(40)])
    got = tune(series)
    assert got[2].tolist() == [grid[0]] * 2
    for k in range(2):
        y = series[k].tolist()
        error = lambda a, b: np.mean([(v - x) ** 2 for v, x in zip(plain_fitted(y, a, b, kind), y) if v is not None])
        assert error(*got[k]) <= min(error(a, b) for a in grid[::5] for b in grid[::5]) + 1e-6


def test_tsb_quantiles_follow_the_simulation():
    r = np.random.default_rng(1)
    draws = np.where(r.random(400_000) < 0.6, np.maximum(0, 5 + 2 * r.standard_normal(400_000)), 0)
    for q in (0.2, 0.5, 0.8, 0.9):
        assert abs(np.quantile(draws, q) - recursive.tsb_quantile(q, 0.6, 5, 2)) < 0.05


@pytest.mark.parametrize("model", recursive.RECURSIVE)
def test_recursive_models_cover_every_window(spark, model):
    t = np.arange(60)
    df = frame(spark, days(10 + 0.1 * t + 3 * np.sin(2 * np.pi * t / 7)) + days(np.where(t % 5 == 0, 4, 0), "b"))
    p = panel.fill(panel.complete(df, PanelSpec(), Frequency.DAILY), PanelSpec())
    w = Windows(3)
    out = cross_validate(p, PanelSpec(), w, 7, [model], () if model == "CROSTON" else (0.1, 0.9))
    backtest.check(out, p, w)
    rows = out.where("q IS NULL").collect()
    assert all(math.isfinite(r["value"]) for r in rows)
    if model in ("ETS", "ARIMA", "THETA"):
        assert np.mean([abs(r["value"] - r["y"]) for r in rows if r["id"] == "a"]) < 2.5


def test_forecast_checks(spark):
    df = spark.createDataFrame([("a", 1, 1, 1.0, "M", None, 2.0)], "id string, ct int, step int, y double, model string, q double, value double")
    backtest.check(df)
    for bad in (df.limit(0), df.withColumn("value", F.lit(float("nan"))), df.union(df)):
        with pytest.raises(ValueError):
            backtest.check(bad)
    assert backtest.drop_dead(df.union(df.withColumns({"model": F.lit("X"), "value": F.lit(None).cast("double")}))).count() == 1


def test_models_without_their_library_say_so(spark):
    p = panel.complete(frame(spark, days(range(30))), PanelSpec(), Frequency.DAILY)
    with pytest.raises(NotImplementedError, match="NHITS"):
        cross_validate(p, PanelSpec(), Windows(7), 7, ["NHITS"])
    with pytest.raises(ValueError):
        cross_validate(p, PanelSpec(), Windows(7), 7, ["LGBM"])
    with pytest.raises(ValueError):
        register_backend("LGBM", None)


def test_best_trial(spark):
    rows = [("a", "p1", 0.5), ("a", "p0", 0.5), ("a", "p2", 0.0), ("a", "p3", float("nan")), ("a", "p4", None), ("a", "p5", float("inf"))]
    assert best_trial(spark.createDataFrame(rows, "id string, params string, loss double"), ["id"]).first()["params"] == "p0"


def test_shrink(spark):
    df = spark.createDataFrame([("a", 1.5, None, 2)], "id string, y double, `q.5` double, n int")
    assert dict(panel.shrink(df, keep=("y",)).dtypes) == {"id": "string", "y": "double", "q.5": "float", "n": "int"}
    assert panel.shrink(df).first() == ("a", 1.5, None, 2)


def test_padding_keeps_static_values(spark):
    df = frame(spark, [("a", D, 1.0, "s"), ("b", D, 1.0, "t"), ("b", D + timedelta(days=1), 2.0, "t")], "id string, ds date, y double, k string")
    out = panel.pad_short(df, PanelSpec(static=("k",)), Frequency.DAILY, 2).collect()
    assert sorted((r["id"], r["ds"], r["y"], r["k"]) for r in out)[0] == ("a", D - timedelta(days=1), 0.0, "s") and len(out) == 4


def test_files(spark, tmp_path):
    df = frame(spark, days([1, 2]))
    for fmt in ("parquet", "csv", "feather"):
        files.write(df, str(tmp_path / fmt), fmt)
        assert files.read(spark, str(tmp_path / fmt), fmt).count() == 2
    files.append_log(df, str(tmp_path / "log"))
    files.append_log(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4
    with pytest.raises(ValueError):
        files.write(df, str(tmp_path / "x"), "orc")


def test_run_task_resumes(spark, tmp_path):
    task = Task("own", Hierarchy.PRODUCT, Frequency.DAILY, 3, name="own_product_daily_3")
    config = Config(models=("SEASONAL_NAIVE", "HISTORIC_AVERAGE"), metrics=("MAE", "SMQL"), root=str(tmp_path))
    rows = frame(spark, days(np.arange(60) % 7) + days(range(60), "b"))
    tracker = JsonTracker(tmp_path / "runs.jsonl")
    assert run_task(spark, task, config, tracker=tracker, panel=(rows, PanelSpec())) == "done"
    assert run_task(spark, task, config, panel=(rows, PanelSpec())) == "skipped"
    assert '"ok": true' in (tmp_path / "runs.jsonl").read_text()
    assert spark.read.parquet(str(tmp_path / "eval/task=own_product_daily_3")).where("metric = 'MAE' AND id = 'a' AND model = 'SEASONAL_NAIVE'").first()["error"] == 0


def test_streaming_roll_up_matches_the_batch(spark, tmp_path):
    src, rows = str(tmp_path / "in"), [(k % 3, f"2024-01-{1 + k % 20:02d} 10:00:00", float(k)) for k in range(100)]
    df = spark.createDataFrame(rows, "key int, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    query = rolling_demand(stream, F.col("key"), "ts", Frequency.WEEKLY, {"y": F.sum("v")}).writeStream.outputMode("complete").format("memory").queryName("weeks").start()
    query.processAllAvailable()
    query.stop()
    got = {(r["id"], r["ds"]): r["y"] for r in spark.table("weeks").collect()}
    want = {(r["id"], r["ds"]): r["y"] for r in panel.roll_up(df, [F.col("key").alias("id")], F.col("ts"), Frequency.WEEKLY, {"y": F.sum("v")}).collect()}
    assert got == want and all(d.weekday() == 0 for _, d in got)
    with pytest.raises(ValueError):
        rolling_demand(df, F.col("key"), "ts", Frequency.MONTHLY, {})


def test_task_plan_is_lazy_and_complete(spark):
    plan = TaskPlan.bind(Task("own", Hierarchy.PRODUCT, Frequency.DAILY, 7), frame(spark, days(range(30))), PanelSpec())
    assert plan.forecasts(["SEASONAL_NAIVE"], quantiles=()).count() == 42
    assert plan.first_cutoff.first()["cutoff"] == D + timedelta(days=17)
