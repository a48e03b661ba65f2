"""Specs, tasks, windows, levels, configuration: no Spark needed."""

import pytest

from cadenza.functions import levels as lv
from cadenza.plans.config import Config, load_yaml, output_path
from cadenza.plans.spec import TASKS, Frequency, Hierarchy, PanelSpec, Task
from cadenza.plans.windows import backtest_offset, feasible_windows, longest_input, taken, train_periods, validation_periods, window_count
from cadenza.sources.catalog import dataset
from cadenza.sources.files import FileFormat


def test_tasks():
    t = Task.parse("bakery_product_store_daily_7")
    assert (t.dataset, t.hierarchy, t.frequency, t.horizon) == ("bakery", Hierarchy.PRODUCT_STORE, Frequency.DAILY, 7)
    assert len(TASKS) == 46
    for bad in ("bakery_daily_7", "a_product_hourly_7", "a_shelf_daily_7", "a_product_daily_x"):
        with pytest.raises(ValueError):
            Task.parse(bad)


def test_windows_of_a_short_daily_panel():
    assert (train_periods(30), window_count(30), backtest_offset(7, 6)) == (24, 6, 12)
    assert [window_count(t) for t in (357, 83, 2499)] == [71, 17, 500]
    assert feasible_windows(10, 40, 7, 14, 7) == 6
    assert feasible_windows(10, 5, 7, 14, 7) == 1


def test_fewer_windows_are_reported(caplog):
    assert feasible_windows(3, 40, 7, 14, 7) == 3 and not caplog.records
    assert feasible_windows(10, 40, 7, 14, 7) == 6 and "6 windows instead of 10" in caplog.text


def test_sizes_of_window_models():
    assert (validation_periods(7), validation_periods(7, 3)) == (7, 3)
    assert [longest_input(h) for h in (1, 3, 7, 30)] == [6, 6, 14, 30] and longest_input(7, (None, 48)) == 48


def test_an_engine_gets_what_it_takes():
    assert taken(lambda df, h: None, {"df": 1, "h": 2, "static": 3}) == {"df": 1, "h": 2}
    assert taken(lambda df, **rest: None, {"df": 1, "h": 2}) == {"df": 1, "h": 2}


def test_period_aliases():
    assert [f.period_alias for f in Frequency] == ["D", "W-MON", "M"]


def test_roles():
    s = PanelSpec(past=("a",), future=("b", "a"), static=("c",)).add("categorical", "a", "z")
    assert (s.exogenous, s.categorical, s.columns) == (("a", "b", "c"), ("a",), ("id", "ds", "y", "a", "b", "c"))
    assert s.remove("a").exogenous == ("b", "c")
    assert s.remove("a", role="past").exogenous == ("b", "a", "c")
    assert s.rename({"a": "a2"}).exogenous == ("a2", "b", "c")
    assert s.add("past", "a").past == ("a",)
    with pytest.raises(ValueError):
        s.add("other", "x")


def test_quantiles_and_levels():
    assert lv.levels_of() == [80, 60, 40, 20]
    assert lv.resolve([80, 0], None) == (0.1, 0.5, 0.9)
    for bad in ((0.5,), (0.2, 0.1), (0.1, 0.1), (0.0, 0.5)):
        with pytest.raises(ValueError):
            lv.check_quantiles(bad)
    with pytest.raises(ValueError):
        lv.resolve([80], (0.1, 0.9))
    assert [lv.column_name("M", q) for q in (None, 0.1, 0.5, 0.9)] == ["M", "M-lo-80", "M-median", "M-hi-80"]
    assert lv.model_names(["id", "A-lo-80", "A", "B-x-median"]) == ["A", "B-x"]
    with pytest.raises(ValueError):
        lv.model_names(["id", "A"])


def test_config(tmp_path):
    assert load_yaml(tmp_path / "absent.yaml") == {}
    (tmp_path / "public").mkdir()
    (tmp_path / "public/task.yaml").write_text("tasks: [yaz_product_daily_7]\n")
    (tmp_path / "public/forecast.yaml").write_text("models: [ets, croston]\n")
    (tmp_path / "public/metrics.yaml").write_text(": : not yaml [")
    c = Config.load(tmp_path)
    assert ([t.name for t in c.tasks], c.models, c.seed, c.format) == (["yaz_product_daily_7"], ("ETS", "CROSTON"), 42, FileFormat.FEATHER)
    for bad in ({"tasks": ["x"]}, {"models": ["LGBM"]}, {"metrics": ["x"]}, {"format": "orc"}):
        with pytest.raises(ValueError):
            Config.build(bad)
    assert output_path("d", "cv", c.tasks[0]) == "d/cv/task=yaz_product_daily_7"
    with pytest.raises(ValueError):
        output_path("d", "x", c.tasks[0])


def test_unknown_and_unregistered_datasets():
    with pytest.raises(ValueError):
        dataset("nothing")
    with pytest.raises(LookupError):
        dataset("m5")
