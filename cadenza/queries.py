"""Registered queries over the test tables, each with a DuckDB twin written from the definitions.

The twins use literal joins where the operators use window expressions, so that agreement says something.
"""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.levels import QUANTILES, column_name, interpolate, levels_of
from .operators import backtest, features, metrics, models, panel, recursive
from .plans.runner import TaskPlan
from .plans.spec import Frequency, Hierarchy, PanelSpec, Task
from .sources.catalog import Dataset, merged

Z = NormalDist().inv_cdf
Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def retail(spark: SparkSession, sf_dir: str) -> Dataset:
    """Line items with their part, as a dataset of products and stores."""

    def load(s: SparkSession) -> DataFrame:
        fact, part = _read(s, sf_dir, "lineitem"), _read(s, sf_dir, "part")
        return merged(fact.select("l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_discount"), (part.select("p_partkey", "p_brand", "p_type", "p_size"), "l_partkey", "p_partkey"))

    return Dataset("retail", load, "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", past=("l_discount",), static=("p_type", "p_size"))


def _task(frequency: Frequency, horizon: int) -> Task:
    return Task("retail", Hierarchy.PRODUCT, frequency, horizon)


#: name: (rows of id, ds, y in SQL; frequency; horizon)
_FACT = "SELECT CAST({key} AS VARCHAR) AS id, CAST(date_trunc('{unit}', {time}) AS DATE) AS ds, CAST({value} AS DOUBLE) AS y FROM {tables} GROUP BY 1, 2"
_LINES = "lineitem LEFT JOIN part ON l_partkey = p_partkey"
PANELS = {
    "brand_week": (_FACT.format(key="p_brand", unit="week", time="l_shipdate", value="sum(l_quantity)", tables=_LINES), Frequency.WEEKLY, 4),
    "store_week": (_FACT.format(key="l_suppkey", unit="week", time="l_shipdate", value="sum(l_quantity)", tables="lineitem"), Frequency.WEEKLY, 4),
    "part_month": (_FACT.format(key="l_partkey", unit="month", time="l_shipdate", value="sum(l_quantity)", tables="lineitem"), Frequency.MONTHLY, 3),
    "brand_day": (_FACT.format(key="p_brand", unit="day", time="l_shipdate", value="sum(l_quantity)", tables=_LINES), Frequency.DAILY, 7),
    "event_day": (_FACT.format(key="event_type", unit="day", time="ts", value="count(*)", tables="events"), Frequency.DAILY, 7),
}
#: panel: (table, key, time, value)
_SOURCE = {
    "brand_week": ("lineitem", "p_brand", "l_shipdate", F.sum),
    "store_week": ("lineitem", "l_suppkey", "l_shipdate", F.sum),
    "part_month": ("lineitem", "l_partkey", "l_shipdate", F.sum),
    "brand_day": ("lineitem", "p_brand", "l_shipdate", F.sum),
    "event_day": ("events", "event_type", "ts", F.count),
}


def rolled(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, key, time, fold = _SOURCE[name]
    fact = _read(spark, sf_dir, table)
    if key == "p_brand":
        fact = merged(fact, (_read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "l_partkey", "p_partkey"))
    value = fold("l_quantity" if table == "lineitem" else F.lit(1)).cast("double")
    return panel.roll_up(fact, [F.col(key).cast("string").alias("id")], F.col(time), PANELS[name][1], {"y": value})


def plan(spark: SparkSession, sf_dir: str, name: str) -> TaskPlan:
    _, frequency, horizon = PANELS[name]
    return TaskPlan.bind(_task(frequency, horizon), rolled(spark, sf_dir, name), PanelSpec())


def rich_plan(spark: SparkSession, sf_dir: str) -> TaskPlan:
    """Monthly parts with features."""
    rows, spec = retail(spark, sf_dir).panel(spark, Hierarchy.PRODUCT, Frequency.MONTHLY)
    return TaskPlan.bind(_task(Frequency.MONTHLY, 3), rows, spec)


def _r(*names: str) -> list:
    return [F.round(F.col(f"`{n}`"), 6).alias(n) for n in names]


#: Added before rounding where exact halves occur (means of a few whole numbers): the last bit of a sum would decide them.
_OFF = 1e-9


# ---------------------------------------------------------------- SQL building blocks
def _with(name: str, more: str = "") -> str:
    raw, f, h = PANELS[name]
    return f"""WITH raw AS ({raw}), {_grid(f, h)}{more}
"""


def _grid(f: Frequency, h: int) -> str:
    step = "1 MONTH" if f is Frequency.MONTHLY else f"{f.step} DAY"
    return f"""
b AS (SELECT min(ds) AS lo, max(ds) AS hi FROM raw),
cal AS (SELECT CAST(d AS DATE) AS ds, CAST(row_number() OVER (ORDER BY d) AS INTEGER) AS t FROM (SELECT unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL {step})) AS d FROM b)),
p AS MATERIALIZED (SELECT i.id, c.ds, c.t, coalesce(r.y, 0) AS y FROM (SELECT DISTINCT id FROM raw) i CROSS JOIN cal c LEFT JOIN raw r ON r.id = i.id AND r.ds = c.ds),
k AS (SELECT n, CAST(n - round_even(0.8 * n, 0) AS INTEGER) AS nw FROM (SELECT max(t) AS n FROM cal)),
c AS (SELECT CAST(unnest(range(n - {h} - (nw - 1), n - {h} + 1)) AS INTEGER) AS ct FROM k)"""


def _cv(name: str) -> str:
    """Forecasts of both window models: id, ct, i, ds, y, model, f, sg."""
    _, f, h = PANELS[name]
    s = f.season
    return f""",
d AS (SELECT id, t, y - lag(y, {s}) OVER (PARTITION BY id ORDER BY t) AS d FROM p),
ha AS (SELECT p.id, c.ct, avg(y) AS m, stddev_samp(y) AS sd FROM p JOIN c ON p.t <= c.ct GROUP BY 1, 2),
sv AS (SELECT d.id, c.ct, CASE WHEN c.ct > {s} THEN sqrt(sum(d.d * d.d) / (c.ct - {s})) END AS sg FROM d JOIN c ON d.t <= c.ct GROUP BY d.id, c.ct),
st AS (SELECT CAST(unnest(range(1, {h + 1})) AS INTEGER) AS i),
cv AS (
SELECT a.id, c.ct, st.i, a.ds, a.y, 'SEASONAL_NAIVE' AS model, s.y AS f, sv.sg * sqrt(floor((st.i - 1) / {s}) + 1) AS sg
FROM c CROSS JOIN st JOIN p a ON a.t = c.ct + st.i JOIN p s ON s.id = a.id AND s.t = c.ct - {s} + ((st.i - 1) % {s}) + 1 LEFT JOIN sv ON sv.id = a.id AND sv.ct = c.ct
UNION ALL
SELECT a.id, c.ct, st.i, a.ds, a.y, 'HISTORIC_AVERAGE', ha.m, ha.sd * sqrt(1 + 1.0 / c.ct) FROM c CROSS JOIN st JOIN p a ON a.t = c.ct + st.i JOIN ha ON ha.id = a.id AND ha.ct = c.ct),
sc AS (SELECT id, avg(m) AS scale FROM ha GROUP BY 1),
ss AS (SELECT id, avg(abs(d)) AS ab, avg(d * d) AS sq FROM d WHERE t <= (SELECT min(ct) FROM c) GROUP BY 1),
zq AS (SELECT * FROM (VALUES {", ".join(f"({q}, {Z(q) if q != 0.5 else 0.0!r})" for q in QUANTILES)}) AS v(q, z)),
cq AS (SELECT id, model, ct, i, y, CAST(q AS DOUBLE) AS q, f + z * sg AS v FROM cv CROSS JOIN zq WHERE sg IS NOT NULL)"""


_GUARD = "greatest(abs(scale), 1e-8)"
_SIMPLE = {"MAE": "avg(abs(y - f))", "MSE": "avg((y - f) * (y - f))", "RMSE": "sqrt(avg((y - f) * (y - f)))"}
_BY = "SELECT cv.id, model, {v} AS error FROM cv JOIN sc ON sc.id = cv.id JOIN ss ON ss.id = cv.id GROUP BY cv.id, model, scale, ab, sq"
_STOCK = """, cum AS (SELECT *, sum(y) OVER w AS cy, sum(f) OVER w AS cf FROM cv WINDOW w AS (PARTITION BY id, model, ct ORDER BY i ROWS UNBOUNDED PRECEDING)),
per AS (SELECT a.id, a.model, a.ct, sum(greatest(0, least(x.y, x.cy - a.cf), least(x.f, x.cf - a.cy)) * (a.i - x.i + 1)) / count(DISTINCT a.i) AS v
        FROM cum a JOIN cum x ON x.id = a.id AND x.model = a.model AND x.ct = a.ct AND x.i <= a.i GROUP BY 1, 2, 3)"""
_PER_APIS = """, cum AS (SELECT *, sum(y - f) OVER (PARTITION BY id, model, ct ORDER BY i ROWS UNBOUNDED PRECEDING) AS ce FROM cv),
per AS (SELECT id, model, ct, abs(sum(ce)) AS v FROM cum GROUP BY 1, 2, 3)"""
_PER_BIAS = ", per AS (SELECT id, model, ct, abs(avg(f - y)) AS v FROM cv GROUP BY 1, 2, 3)"
_FROM_PER = "SELECT per.id, model, avg(v){by} AS error FROM per JOIN sc ON sc.id = per.id GROUP BY per.id, model, scale"


def _metric_body(m: str) -> str:
    if m in _SIMPLE:
        return _BY.format(v=_SIMPLE[m])
    simple = {
        "MASE": "avg(abs(y - f)) / nullif(ab, 0)", "MSSE": "avg((y - f) * (y - f)) / nullif(sq, 0)", "RMSSE": "sqrt(avg((y - f) * (y - f)) / nullif(sq, 0))",
        "SMAE": f"avg(abs(y - f)) / {_GUARD}", "SRMSE": f"sqrt(avg((y - f) * (y - f))) / {_GUARD}", "SBIAS": f"avg(f - y) / {_GUARD}",
    }
    if m in simple:
        return _BY.format(v=simple[m])
    if m in ("SPEC", "SSPEC"):
        return _STOCK + _FROM_PER.format(by="" if m == "SPEC" else " / nullif(scale, 0)")
    if m in ("APIS", "SAPIS"):
        return _PER_APIS + _FROM_PER.format(by="" if m == "APIS" else " / nullif(scale, 0)")
    if m == "SABSBIAS":
        return _PER_BIAS + _FROM_PER.format(by=f" / {_GUARD}")
    q = metrics.PROBABILISTIC[m]
    return f"SELECT cq.id, model, avg(greatest(q * (y - v), (q - 1) * (y - v))) / nullif(ab, 0) AS error FROM cq JOIN ss ON ss.id = cq.id {'' if q is None else f'WHERE abs(q - {q}) < 1e-9'} GROUP BY cq.id, model, ab"


def _metric_sql(m: str, name: str = "brand_week") -> str:
    body = _metric_body(m)
    if body.startswith(","):
        ctes, _, final = body.rpartition("SELECT per.id")
        return f"{_with(name, _cv(name))}{ctes} SELECT id, model, round(error, 6) AS error FROM (SELECT per.id{final})"
    return f"{_with(name, _cv(name))} SELECT id, model, round(error, 6) AS error FROM ({body})"


# ---------------------------------------------------------------- queries
def _forecasts(p: TaskPlan, quantiles=QUANTILES) -> DataFrame:
    return p.forecasts(["SEASONAL_NAIVE", "HISTORIC_AVERAGE"], quantiles=quantiles)


def _metric(m: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = plan(spark, sf_dir, "brand_week")
        point = m in metrics.POINT
        return p.evaluated(_forecasts(p, () if point else QUANTILES), (m,)).select("id", "model", *_r("error"))

    return query


def _freq(name: str) -> Query:
    return lambda spark, sf_dir: rolled(spark, sf_dir, name).select("id", "ds", *_r("y"))


def _hier(h: Hierarchy) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, _ = retail(spark, sf_dir).panel(spark, h, Frequency.MONTHLY)
        return rows.select("id", "ds", *_r("y", "l_discount"))

    return query


def _hier_sql(key: str) -> str:
    return f"SELECT {key} AS id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds, round(sum(l_quantity), 6) AS y, round(avg(l_discount), 6) AS l_discount FROM lineitem GROUP BY 1, 2"


def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = retail(spark, sf_dir).load(spark)
    levels = {"brand": ("p_brand",), "store": ("l_suppkey",), "brand_store": ("p_brand", "l_suppkey"), "all": ()}
    return panel.roll_up_levels(rows, levels, F.col("l_shipdate"), Frequency.MONTHLY, {"y": F.sum("l_quantity")}).select("level", "p_brand", "l_suppkey", "ds", *_r("y"))


def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir, "store_week").panel.select("id", "ds", "t", *_r("y"))


def bfill_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rich_plan(spark, sf_dir).panel.select("id", "ds", "p_type", "p_size", *_r("y", "l_discount"))


_RICH = """WITH raw AS (SELECT CAST(l_partkey AS VARCHAR) AS id, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds, sum(l_quantity) AS y, avg(l_discount) AS l_discount, min(p_type) AS p_type, min(p_size) AS p_size
 FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""" + f""", {_grid(Frequency.MONTHLY, 3)},
g AS (SELECT p.id, p.ds, p.t, p.y, r.l_discount, r.p_type, r.p_size FROM p LEFT JOIN raw r ON r.id = p.id AND r.ds = p.ds),
f AS MATERIALIZED (SELECT id, ds, t, y, {", ".join(f"coalesce(first_value({x} IGNORE NULLS) OVER a, last_value({x} IGNORE NULLS) OVER z) AS {x}" for x in ("l_discount", "p_type", "p_size"))}
 FROM g WINDOW a AS (PARTITION BY id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), z AS (PARTITION BY id ORDER BY t ROWS UNBOUNDED PRECEDING)),
c0 AS (SELECT min(ct) AS ct FROM c)
"""


def sku_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = plan(spark, sf_dir, "part_month").stats()
    return s.select("id", *_r(*(c for c in s.columns if c != "id")))


_Q = features.STAT_QUANTILES


def stat_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the target under the default scaler."""
    p = plan(spark, sf_dir, "part_month")
    s = features.Scaler()
    scaled = s.transform(p.panel, p.spec, s.fit(p.panel, p.spec, p.first_cutoff))
    out, _ = features.encode_statistics(scaled, p.spec, p.first_cutoff)
    return out.where("t = 1").select("id", F.round(F.col("target_mean") + _OFF, 6).alias("target_mean"), *_r(*(c for c in out.columns if c.startswith("target_") and c != "target_mean")))


def _scale(kind: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = plan(spark, sf_dir, "store_week")
        s = features.Scaler(kind)
        return s.transform(p.panel, p.spec, s.fit(p.panel, p.spec, p.first_cutoff)).select("id", "ds", *_r("y"))

    return query


def inverse_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(spark, sf_dir, "store_week")
    s = features.Scaler("standard")
    fitted = s.fit(p.panel, p.spec, p.first_cutoff)
    return s.inverse(s.transform(p.panel, p.spec, fitted), p.spec, fitted).select("id", "ds", *_r("y"))


_SCALES = {
    "standard": ("avg(y)", "stddev_samp(y)"),
    "max": ("0", "max(y)"),
    "robust": ("0", "greatest(quantile_cont(y, 0.9), min(y) FILTER (WHERE y > 0))"),
}


def _scale_sql(kind: str) -> str:
    shift, scale = _SCALES[kind]
    fit = f", fit AS (SELECT id, {shift} AS m, coalesce(nullif({scale}, 0), 1) AS s FROM p WHERE t <= (SELECT min(ct) FROM c) GROUP BY 1)"
    return f"{_with('store_week', fit)} SELECT p.id, ds, round((y - m) / s, 6) AS y FROM p JOIN fit ON fit.id = p.id"


def minmax_exog(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rich_plan(spark, sf_dir)
    return features.min_max(p.panel, features.mark_categorical(p.panel, p.spec)).select("id", "ds", *_r("l_discount", "p_size"))


def category_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rich_plan(spark, sf_dir)
    out, _ = features.encode_categories(p.panel, features.mark_categorical(p.panel, p.spec), p.first_cutoff)
    return out.select("id", "ds", "p_type", *_r("p_type_encoded"))


def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(spark, sf_dir, "brand_day")
    out, _ = features.add_calendar(p.panel, p.spec, Frequency.DAILY)
    return out.select("id", "ds", *_r("weekday_sin", "weekday_cos", "month_sin", "month_cos"))


def static_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = rich_plan(spark, sf_dir)
    return panel.static_table(p.panel, p.spec)


def pad_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.pad_short(rolled(spark, sf_dir, "part_month"), PanelSpec(), Frequency.MONTHLY, 30).select("id", "ds", *_r("y"))


def cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(spark, sf_dir, "part_month")
    return backtest.cutoffs(p.panel, p.spec, Frequency.MONTHLY, p.windows).select("ct", "cutoff")


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(spark, sf_dir, "event_day")
    return backtest.splits(p.panel, p.windows).select("id", "ct", "step", "ds", *_r("y"))


def train_cutoff_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(spark, sf_dir, "brand_week")
    return backtest.train_scale(p.panel, p.spec, p.windows).select("id", *_r("scale"))


def _window_cv(model: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(spark, sf_dir, "store_week").forecasts([model], quantiles=()).where("value IS NOT NULL").select("id", "ct", "step", "ds", *_r("y", "value"))

    return query


def _window_intervals(model: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(spark, sf_dir, "brand_week").forecasts([model]).where("q IS NOT NULL AND value IS NOT NULL").select("id", "ct", "step", "q", *_r("value"))

    return query


def wide_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long forecasts pivoted to columns per model and bound."""
    names = ["SEASONAL_NAIVE", "HISTORIC_AVERAGE"]
    wide = backtest.to_wide(_forecasts(plan(spark, sf_dir, "brand_week"), (0.1, 0.5, 0.9)), names, [None, 0.1, 0.5, 0.9])
    out = backtest.trim(backtest.with_points(wide, names), names, [80])
    return out.select("id", "ct", "step", *(F.round(F.col(f"`{c}`"), 6).alias(c.replace("-", "_").lower()) for c in out.columns if c.startswith(tuple(names))))


def _recursive(model: str, fixed: tuple[float, float] | None, name: str = "part_month", quantiles: tuple[float, ...] = ()) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        p = plan(spark, sf_dir, name)
        out = recursive.recursive(p.panel, p.spec, p.windows, PANELS[name][1].season, model, quantiles, fixed)
        return out.select("id", "ct", "step", *(["q"] if quantiles else []), *_r("value"))

    return query


_DEMAND = """,
dm AS (SELECT id, t, y, t - coalesce(lag(t) OVER (PARTITION BY id ORDER BY t), 0) AS gap, row_number() OVER (PARTITION BY id ORDER BY t) AS j FROM p WHERE y > 0),
w AS (SELECT dm.id, c.ct, y, gap, j, max(j) OVER (PARTITION BY dm.id, c.ct) AS m FROM dm JOIN c ON dm.t <= c.ct),
lv AS (SELECT id, ct, sum(y * CASE WHEN j = 1 THEN pow(0.9, m - 1) ELSE 0.1 * pow(0.9, m - j) END) AS size, sum(gap * CASE WHEN j = 1 THEN pow(0.9, m - 1) ELSE 0.1 * pow(0.9, m - j) END) AS gap FROM w GROUP BY 1, 2)"""
_STEPS = "(SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS step)"
_EVERY = "(SELECT DISTINCT p.id, c.ct, s.step FROM p CROSS JOIN c CROSS JOIN " + _STEPS + " s)"
_CROSTON = f"{_with('part_month', _DEMAND)} SELECT e.id, e.ct, e.step, round(coalesce(0.95 * size / gap, 0), 6) AS value FROM {_EVERY} e LEFT JOIN lv ON lv.id = e.id AND lv.ct = e.ct"
_CHANCE = """, o AS (SELECT p.id, c.ct, sum(CASE WHEN y <> 0 THEN 1 ELSE 0 END * CASE WHEN t = 1 THEN pow(0.9, c.ct - 1) ELSE 0.1 * pow(0.9, c.ct - t) END) AS chance FROM p JOIN c ON p.t <= c.ct GROUP BY 1, 2)"""
_TSB = f"{_with('part_month', _DEMAND + _CHANCE)} SELECT e.id, e.ct, e.step, round(coalesce(chance * size, 0), 6) AS value FROM {_EVERY} e LEFT JOIN lv ON lv.id = e.id AND lv.ct = e.ct LEFT JOIN o ON o.id = e.id AND o.ct = e.ct"


def _tuned_levels(f: Frequency, h: int, raw: str, first: float, last: float) -> str:
    """Levels of sizes and gaps for each weight of a grid after each demand of the first window's history, as weighted running sums."""
    return f"""WITH raw AS ({raw}), {_grid(f, h)},
t0 AS (SELECT min(ct) AS ct FROM c),
g AS (SELECT round({first} + 0.01 * i, 2) AS w FROM (SELECT unnest(range({round((last - first) * 100) + 1})) AS i)),
dm AS (SELECT id, t, y, t - coalesce(lag(t) OVER (PARTITION BY id ORDER BY t), 0) AS gap, row_number() OVER (PARTITION BY id ORDER BY t) AS j,
 coalesce(lead(t) OVER (PARTITION BY id ORDER BY t), (SELECT ct FROM t0) + 1) AS next, lead(y) OVER (PARTITION BY id ORDER BY t) AS ahead FROM p WHERE y > 0 AND t <= (SELECT ct FROM t0)),
lv AS (SELECT id, t, j, w, next, ahead, pow(1 - w, j) * sum(y * a * pow(1 - w, -j)) OVER o AS size, pow(1 - w, j) * sum(gap * a * pow(1 - w, -j)) OVER o AS gap
 FROM (SELECT *, CASE WHEN j = 1 THEN 1 ELSE w END AS a FROM dm CROSS JOIN g) WINDOW o AS (PARTITION BY id, w ORDER BY j ROWS UNBOUNDED PRECEDING))"""


#: A level holds from after its demand to the next one: so many periods, of which only the last has demand.
_CROSTON_AUTO = _tuned_levels(PANELS["part_month"][1], PANELS["part_month"][2], PANELS["part_month"][0], 0.05, 0.30) + f""",
se AS (SELECT s.id, s.w AS a, q.w AS b, sum((least(s.next, (SELECT ct FROM t0)) - s.t) * pow(0.95 * s.size / q.gap, 2) - 2 * 0.95 * s.size / q.gap * coalesce(s.ahead, 0) + coalesce(s.ahead * s.ahead, 0)) / nullif(sum(least(s.next, (SELECT ct FROM t0)) - s.t), 0) AS e
 FROM lv s JOIN lv q ON q.id = s.id AND q.j = s.j GROUP BY 1, 2, 3),
best AS (SELECT id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(e, 6), a, b) AS r FROM se) WHERE r = 1),
ids AS (SELECT i.id, coalesce(a, 0.05) AS a, coalesce(b, 0.05) AS b FROM (SELECT DISTINCT id FROM p) i LEFT JOIN best ON best.id = i.id),
dx AS (SELECT id, t, y, t - coalesce(lag(t) OVER (PARTITION BY id ORDER BY t), 0) AS gap, row_number() OVER (PARTITION BY id ORDER BY t) AS j FROM p WHERE y > 0),
wx AS (SELECT dx.id, c.ct, y, gap, j, a, b, max(j) OVER (PARTITION BY dx.id, c.ct) AS m FROM dx JOIN ids ON ids.id = dx.id JOIN c ON dx.t <= c.ct),
fx AS (SELECT id, ct, 0.95 * sum(y * CASE WHEN j = 1 THEN 1 ELSE a END * pow(1 - a, m - j)) / sum(gap * CASE WHEN j = 1 THEN 1 ELSE b END * pow(1 - b, m - j)) AS f FROM wx GROUP BY 1, 2)
SELECT e.id, e.ct, e.step, round(coalesce(f, 0), 6) AS value FROM {_EVERY} e LEFT JOIN fx ON fx.id = e.id AND fx.ct = e.ct"""
_TSB_AUTO = _tuned_levels(PANELS["event_day"][1], PANELS["event_day"][2], PANELS["event_day"][0], 0.02, 0.50) + """,
ch AS (SELECT id, t, w, pow(1 - w, t) * sum(CASE WHEN y <> 0 THEN 1 ELSE 0 END * CASE WHEN t = 1 THEN 1 ELSE w END * pow(1 - w, -t)) OVER (PARTITION BY id, w ORDER BY t ROWS UNBOUNDED PRECEDING) AS chance FROM p CROSS JOIN g),
se AS (SELECT s.id, s.w AS a, q.w AS b, avg(pow(s.size * q.chance - p.y, 2)) AS e FROM lv s JOIN ch q ON q.id = s.id AND q.t >= s.t AND q.t < s.next AND q.t < (SELECT ct FROM t0) JOIN p ON p.id = s.id AND p.t = q.t + 1 GROUP BY 1, 2, 3),
best AS (SELECT id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(e, 6), a, b) AS r FROM se) WHERE r = 1),
ids AS (SELECT i.id, coalesce(a, 0.02) AS a, coalesce(b, 0.02) AS b FROM (SELECT DISTINCT id FROM p) i LEFT JOIN best ON best.id = i.id),
dx AS (SELECT id, t, y, row_number() OVER (PARTITION BY id ORDER BY t) AS j FROM p WHERE y > 0),
wx AS (SELECT dx.id, c.ct, y, j, a, max(j) OVER (PARTITION BY dx.id, c.ct) AS m FROM dx JOIN ids ON ids.id = dx.id JOIN c ON dx.t <= c.ct),
fx AS (SELECT id, ct, sum(y * CASE WHEN j = 1 THEN 1 ELSE a END * pow(1 - a, m - j)) AS size FROM wx GROUP BY 1, 2),
oc AS (SELECT ch.id, ch.t AS ct, chance FROM ch JOIN ids ON ids.id = ch.id AND round(ids.b, 2) = round(ch.w, 2))
SELECT c.ct, s.step, i.id, round(coalesce(size * chance, 0), 6) AS value FROM ids i CROSS JOIN c CROSS JOIN (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS step) s LEFT JOIN fx ON fx.id = i.id AND fx.ct = c.ct LEFT JOIN oc ON oc.id = i.id AND oc.ct = c.ct"""


def _three(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(spark, sf_dir, "brand_week")
    return p.evaluated(_forecasts(p, ()), ("MAE", "RMSE", "SAPIS"))


def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(_three(spark, sf_dir)).select("metric", "model", *_r("mean", "std", "min", "max"))


def metrics_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = metrics.by_model(_three(spark, sf_dir), ["SEASONAL_NAIVE", "HISTORIC_AVERAGE"])
    return metrics.melt_models(wide.withColumn("metric", F.lower("metric")), ("MAE", "SAPIS")).select("id", "metric", "model", *_r("error"))


def mean_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three(spark, sf_dir).groupBy("metric", "model").agg(F.avg("error").alias("mean")).select("metric", "model", *_r("mean"))


def box_plot_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.box_data(_three(spark, sf_dir)).select("metric", "model", *_r("q1", "median", "q3", "mean", "low", "high"))


_EVAL3 = _with("brand_week", _cv("brand_week")) + ", mae AS (" + _metric_body("MAE") + "), rmse AS (" + _metric_body("RMSE") + ")" + _PER_APIS + """, sapis AS (""" + _FROM_PER.format(by=" / nullif(scale, 0)") + """),
ev AS (SELECT 'MAE' AS metric, * FROM mae UNION ALL SELECT 'RMSE', * FROM rmse UNION ALL SELECT 'SAPIS', * FROM sapis)
"""


def combine_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two engines whose results overlap: the first one's rows stay; every cutoff stays."""
    p = plan(spark, sf_dir, "event_day")
    first = models.historic_average(p.panel, p.spec, p.windows, ())
    second = models.seasonal_naive(p.panel, p.spec, p.windows, 7, ()).unionByName(first.withColumn("value", F.lit(-1.0)))
    return backtest.combine(first, second).select("id", "ct", "step", "ds", "model", *_r("y", "value"))


def combine_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(spark, sf_dir, "event_day")
    a = backtest.to_wide(models.historic_average(p.panel, p.spec, p.windows, ()), ["HISTORIC_AVERAGE"], [None])
    b = backtest.to_wide(models.seasonal_naive(p.panel, p.spec, p.windows, 7, ()).where("step <= 5"), ["SEASONAL_NAIVE"], [None])
    return backtest.combine_wide(a, b).select("id", "ct", "step", "ds", *_r("y", "HISTORIC_AVERAGE", "SEASONAL_NAIVE"))


def drop_dead_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(spark, sf_dir, "event_day")
    alive = models.historic_average(p.panel, p.spec, p.windows, ())
    dead = alive.withColumns({"model": F.lit("DEAD"), "value": F.lit(float("nan"))})
    kept = backtest.drop_dead(alive.unionByName(dead))
    return kept.groupBy("model").agg(F.count("*").alias("n"))


def value_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(spark, sf_dir, "part_month")
    holes = models.historic_average(p.panel, p.spec, p.windows, ()).withColumn("value", F.when(F.col("step") > 1, F.col("value")))
    return backtest.value_shares(holes).select("model", *_r("share"))


def quantile_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = backtest.to_wide(plan(spark, sf_dir, "brand_week").forecasts(["HISTORIC_AVERAGE"]), ["HISTORIC_AVERAGE"], [None, *QUANTILES])
    sources = [F.col(f"`{column_name('HISTORIC_AVERAGE', q)}`") for q in QUANTILES]
    return wide.select("id", "ct", "step", *(F.round(interpolate(QUANTILES, sources, q), 6).alias(f"q{round(1000 * q)}") for q in (0.05, 0.15, 0.5, 0.62, 0.95)))


def _interpolate_sql() -> str:
    def mix(q: float) -> str:
        if q <= QUANTILES[0]:
            return f"f + {Z(QUANTILES[0])!r} * sg"
        if q >= QUANTILES[-1]:
            return f"f + {Z(QUANTILES[-1])!r} * sg"
        low = max(x for x in QUANTILES if x <= q + 1e-12)
        high = min(x for x in QUANTILES if x > q + 1e-12)
        z = Z(low) + (Z(high) - Z(low)) * (q - low) / (high - low) if abs(q - low) > 1e-12 else Z(low)
        return f"f + {z!r} * sg"

    columns = ", ".join(f"round({mix(q)}, 6) AS q{round(1000 * q)}" for q in (0.05, 0.15, 0.5, 0.62, 0.95))
    return f"{_with('brand_week', _cv('brand_week'))} SELECT id, ct, i AS step, {columns} FROM cv WHERE model = 'HISTORIC_AVERAGE'"


def levels_from_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of each level of the default grid for the last window, from the long table."""
    rows = plan(spark, sf_dir, "brand_week").forecasts(["HISTORIC_AVERAGE"]).where("step = 1 AND q IS NOT NULL")
    same = lambda q: F.abs(F.col("q") - q) < 1e-9
    cells = [F.struct(F.lit(x).alias("level"), F.max(F.when(same((1 - x / 100) / 2), F.struct("ct", "value")))["value"].alias("lo"), F.max(F.when(same((1 + x / 100) / 2), F.struct("ct", "value")))["value"].alias("hi")) for x in levels_of()]
    out = rows.groupBy("id").agg(F.array(*cells).alias("c")).select("id", F.explode("c").alias("c"))
    return out.select("id", "c.level", F.round("c.lo", 6).alias("lo"), F.round("c.hi", 6).alias("hi"))


def shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.shortest_series(rolled(spark, sf_dir, "part_month"), PanelSpec())


def infer_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.infer_step(rolled(spark, sf_dir, "store_week"), PanelSpec()).select(F.col("days").cast("int").alias("days"))


def future_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.future_frame(rolled(spark, sf_dir, "part_month"), PanelSpec(), Frequency.MONTHLY, 3)


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(spark, sf_dir, "brand_week")
    return backtest.context(p.panel, p.spec, p.windows.first(F.col("periods")), 12).select("id", "ds", "t", *_r("y"))


def seasonal_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(spark, sf_dir, "brand_week")
    return backtest.seasonal_scale(p.panel, p.spec, p.windows, 52).select("id", *_r("absolute", "squared"))


def prepared_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole preparation: min-max, scaling, calendar, categories, statistics."""
    out, _, _ = rich_plan(spark, sf_dir).prepared(features.Scaler("max"))
    return out.select("id", "ds", *_r("y", "l_discount", "p_size", "month_sin", "month_cos", "p_type_encoded", "target_std", "target_quantile_50"), F.round(F.col("target_mean") + _OFF, 6).alias("target_mean"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly demand per brand: both window models over all windows, four metrics per series and model."""
    p = plan(spark, sf_dir, "brand_week")
    out = p.evaluated(_forecasts(p, ()), ("MAE", "MASE", "SAPIS", "SSPEC"))
    return out.select("id", "metric", "model", *_r("error"))


def _box_sql() -> str:
    return _EVAL3 + """, bx AS (SELECT metric, model, quantile_cont(error, 0.25) AS q1, quantile_cont(error, 0.5) AS median, quantile_cont(error, 0.75) AS q3, avg(error) AS mean FROM ev GROUP BY 1, 2)
SELECT metric, model, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(mean, 6) AS mean, round(min(error), 6) AS low, round(max(error), 6) AS high
FROM bx JOIN ev USING (metric, model) WHERE error BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY metric, model, q1, median, q3, mean"""


def _flagship_sql() -> str:
    parts = []
    for m in ("MAE", "MASE", "SAPIS", "SSPEC"):
        parts.append(f"SELECT '{m}' AS metric, * FROM ({_metric_sql(m)})")
    return "SELECT id, metric, model, error FROM (" + " UNION ALL ".join(parts) + ")"


def _intervals_sql(model: str) -> str:
    return f"{_with('brand_week', _cv('brand_week'))} SELECT id, ct, i AS step, q, round(v, 6) AS value FROM cq WHERE model = '{model}'"


_ENC = """, fit AS (SELECT id, coalesce(nullif(max(y), 0), 1) AS s FROM p WHERE t <= (SELECT min(ct) FROM c) GROUP BY 1),
x AS (SELECT p.id, y / s AS y FROM p JOIN fit ON fit.id = p.id WHERE t <= (SELECT min(ct) FROM c)),
mo AS (SELECT id, avg(y) AS m, count(*) AS n FROM x GROUP BY 1),
ce AS (SELECT x.id, any_value(n) AS n, avg(y) AS m, stddev_samp(y) AS sd, avg((y - m) ** 2) AS m2, avg((y - m) ** 3) AS m3, avg((y - m) ** 4) AS m4, {q} FROM x JOIN mo ON mo.id = x.id GROUP BY x.id)
SELECT id, round(m + 1e-9, 6) AS target_mean, round(sd, 6) AS target_std, round(CASE WHEN n >= 4 AND m2 > 0 THEN m3 / pow(m2, 1.5) ELSE 0 END, 6) AS target_skewness, round(CASE WHEN n >= 4 AND m2 > 0 THEN m4 / (m2 * m2) - 3 ELSE 0 END, 6) AS target_kurtosis, {r} FROM ce""".format(
    q=", ".join(f"quantile_cont(y, {q}) AS q{i}" for i, q in enumerate(_Q)), r=", ".join(f"round(CASE WHEN n >= 4 THEN q{i} ELSE 0 END, 6) AS target_quantile_{round(100 * q)}" for i, q in enumerate(_Q))
)

QUERIES: dict[str, Query] = {
    "flagship": flagship,
    "freq_daily": _freq("brand_day"), "freq_weekly": _freq("store_week"), "freq_monthly": _freq("part_month"), "freq_events": _freq("event_day"),
    "hier_product": _hier(Hierarchy.PRODUCT), "hier_store": _hier(Hierarchy.STORE), "hier_product_store": _hier(Hierarchy.PRODUCT_STORE), "hier_grouping_sets": grouping_sets,
    "gap_fill": gap_fill, "bfill_ffill": bfill_ffill, "sku_stats": sku_stats, "stat_encoder": stat_encoder,
    "scale_standard": _scale("standard"), "scale_max": _scale("max"), "scale_robust": _scale("robust"), "inverse_scale": inverse_scale,
    "minmax_exog": minmax_exog, "category_encode": category_encode, "calendar_features": calendar_features, "prepared_panel": prepared_panel,
    "static_table": static_table, "pad_short": pad_short, "shortest_series": shortest, "infer_step": infer_step, "future_frame": future_frame, "context_window": context_window,
    "cutoffs": cutoffs, "splits": splits, "train_cutoff_scale": train_cutoff_scale, "seasonal_scale": seasonal_scale,
    "seasonal_naive_cv": _window_cv("SEASONAL_NAIVE"), "seasonal_naive_intervals": _window_intervals("SEASONAL_NAIVE"),
    "historic_average_cv": _window_cv("HISTORIC_AVERAGE"), "historic_average_intervals": _window_intervals("HISTORIC_AVERAGE"), "wide_forecasts": wide_forecasts,
    "croston_fixed": _recursive("CROSTON", (0.1, 0.1)), "tsb_fixed": _recursive("TSB", (0.1, 0.1)),
    "croston_auto": _recursive("CROSTON", None), "tsb_auto": _recursive("TSB", None), "tsb_auto_events": _recursive("TSB", None, "event_day"), "tsb_intervals": _recursive("TSB", None, "event_day", QUANTILES),
    **{f"{m.lower()}_auto": _recursive(m, None, "brand_week") for m in ("THETA", "ETS", "ARIMA", "CES")},
    **{f"metric_{m.lower()}": _metric(m) for m in metrics.METRICS},
    "metrics_summary": metrics_summary, "metrics_melt": metrics_melt, "mean_error": mean_error, "box_plot_stats": box_plot_stats,
    "combine_models": combine_models, "combine_wide": combine_wide, "drop_dead_models": drop_dead_models, "value_shares": value_shares,
    "quantile_interpolate": quantile_interpolate, "levels_from_quantiles": levels_from_quantiles,
}

_FREQ_SQL = "SELECT id, ds, round(y, 6) AS y FROM ({})"
_CV_STORE = _with("store_week", _cv("store_week"))
_CV_EVENT = _with("event_day", _cv("event_day"))
ORACLE_SQL: dict[str, str] = {
    "flagship": _flagship_sql(),
    "freq_daily": _FREQ_SQL.format(PANELS["brand_day"][0]), "freq_weekly": _FREQ_SQL.format(PANELS["store_week"][0]), "freq_monthly": _FREQ_SQL.format(PANELS["part_month"][0]), "freq_events": _FREQ_SQL.format(PANELS["event_day"][0]),
    "hier_product": _hier_sql("CAST(l_partkey AS VARCHAR)"), "hier_store": _hier_sql("CAST(l_suppkey AS VARCHAR)"), "hier_product_store": _hier_sql("l_partkey || '_' || l_suppkey"),
    "hier_grouping_sets": " UNION ALL ".join(
        f"SELECT '{n}' AS level, {b} AS p_brand, {s} AS l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS ds, round(sum(l_quantity), 6) AS y FROM {_LINES} GROUP BY ALL"
        for n, b, s in (("brand", "p_brand", "CAST(NULL AS BIGINT)"), ("store", "CAST(NULL AS VARCHAR)", "l_suppkey"), ("brand_store", "p_brand", "l_suppkey"), ("all", "CAST(NULL AS VARCHAR)", "CAST(NULL AS BIGINT)"))
    ),
    "gap_fill": _with("store_week") + "SELECT id, ds, t, round(y, 6) AS y FROM p",
    "bfill_ffill": _RICH + "SELECT id, ds, p_type, p_size, round(y, 6) AS y, round(l_discount, 6) AS l_discount FROM f",
    "sku_stats": _with("part_month") + "SELECT id, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS std, round(min(y), 6) AS min, round(max(y), 6) AS max, " + ", ".join(f"round(quantile_cont(y, {q}), 6) AS quantile_{round(100 * q)}" for q in _Q) + " FROM p WHERE t <= (SELECT min(ct) FROM c) GROUP BY 1",
    "stat_encoder": _with("part_month", _ENC),
    "scale_standard": _scale_sql("standard"), "scale_max": _scale_sql("max"), "scale_robust": _scale_sql("robust"),
    "inverse_scale": _with("store_week") + "SELECT id, ds, round(y, 6) AS y FROM p",
    "minmax_exog": _RICH + ", e AS (SELECT min(l_discount) AS a, max(l_discount) AS b, min(p_size) AS x, max(p_size) AS y FROM f) SELECT id, ds, round(coalesce((l_discount - a) / nullif(b - a, 0), 0), 6) AS l_discount, round(coalesce((p_size - x) / nullif(e.y - x, 0), 0), 6) AS p_size FROM f CROSS JOIN e",
    "category_encode": _RICH + ", tr AS (SELECT f.* FROM f JOIN c0 ON f.t <= c0.ct), pr AS (SELECT avg(y) AS prior FROM tr), s AS (SELECT p_type, sum(y) AS sy, count(*) AS n FROM tr GROUP BY 1) SELECT id, ds, f.p_type, round(CASE WHEN n > 1 THEN (sy + prior) / (n + 1) ELSE prior END, 6) AS p_type_encoded FROM f CROSS JOIN pr LEFT JOIN s ON s.p_type = f.p_type",
    "calendar_features": _with("brand_day") + "SELECT id, ds, round(sin(2 * pi() * (isodow(ds) - 1) / 7), 6) AS weekday_sin, round(cos(2 * pi() * (isodow(ds) - 1) / 7), 6) AS weekday_cos, round(sin(2 * pi() * month(ds) / 12), 6) AS month_sin, round(cos(2 * pi() * month(ds) / 12), 6) AS month_cos FROM p",
    "prepared_panel": _RICH + """, e AS (SELECT min(l_discount) AS a, max(l_discount) AS b, min(p_size) AS x, max(p_size) AS z FROM f),
mx AS (SELECT id, coalesce(nullif(max(y), 0), 1) AS s FROM f JOIN c0 ON f.t <= c0.ct GROUP BY 1),
u AS (SELECT f.id, ds, t, f.y / s AS y, l_discount, p_size, p_type FROM f JOIN mx ON mx.id = f.id),
tr AS MATERIALIZED (SELECT u.* FROM u JOIN c0 ON u.t <= c0.ct), pr AS (SELECT avg(y) AS prior FROM tr), ca AS (SELECT p_type, sum(y) AS sy, count(*) AS n FROM tr GROUP BY 1),
sq AS (SELECT id, avg(y) AS tm, stddev_samp(y) AS ts, CASE WHEN count(*) >= 4 THEN quantile_cont(y, 0.5) ELSE 0 END AS tq FROM tr GROUP BY 1)
SELECT u.id, ds, round(tm + 1e-9, 6) AS target_mean, round(ts, 6) AS target_std, round(tq, 6) AS target_quantile_50, round(u.y, 6) AS y, round(coalesce((l_discount - a) / nullif(b - a, 0), 0), 6) AS l_discount, round(coalesce((p_size - x) / nullif(z - x, 0), 0), 6) AS p_size,
 round(sin(2 * pi() * month(ds) / 12), 6) AS month_sin, round(cos(2 * pi() * month(ds) / 12), 6) AS month_cos, round(CASE WHEN n > 1 THEN (sy + prior) / (n + 1) ELSE prior END, 6) AS p_type_encoded
FROM u JOIN sq ON sq.id = u.id CROSS JOIN e CROSS JOIN pr LEFT JOIN ca ON ca.p_type = u.p_type""",
    "static_table": "SELECT CAST(l_partkey AS VARCHAR) AS id, min(p_type) AS p_type, min(p_size) AS p_size FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "pad_short": f"WITH raw AS ({PANELS['part_month'][0]}), s AS (SELECT id, count(*) AS n, min(ds) AS lo FROM raw GROUP BY 1) SELECT id, ds, round(y, 6) AS y FROM raw UNION ALL SELECT id, CAST(lo - to_months(CAST(k AS INTEGER)) AS DATE), 0 FROM (SELECT id, lo, unnest(range(1, 31 - n)) AS k FROM s WHERE n < 30)",
    "shortest_series": f"SELECT min(n) AS shortest FROM (SELECT count(*) AS n FROM ({PANELS['part_month'][0]}) GROUP BY id)",
    "infer_step": f"WITH raw AS ({PANELS['store_week'][0]}), l AS (SELECT id FROM raw GROUP BY 1 ORDER BY count(*) DESC, id LIMIT 1), g AS (SELECT CAST(ds - lag(ds) OVER (ORDER BY ds) AS INTEGER) AS days FROM raw WHERE id IN (SELECT id FROM l)) SELECT days FROM g WHERE days IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, days LIMIT 1",
    "future_frame": f"SELECT id, CAST(last + to_months(step) AS DATE) AS ds, step FROM (SELECT id, max(ds) AS last FROM ({PANELS['part_month'][0]}) GROUP BY 1) CROSS JOIN {_STEPS}",
    "context_window": _with("brand_week") + "SELECT id, ds, t, round(y, 6) AS y FROM p WHERE t <= (SELECT min(ct) FROM c) AND t > (SELECT min(ct) FROM c) - 12",
    "cutoffs": _with("part_month") + "SELECT ct, ds AS cutoff FROM c JOIN cal ON t = ct",
    "splits": _with("event_day") + "SELECT p.id, c.ct, CAST(p.t - c.ct AS INTEGER) AS step, p.ds, round(p.y, 6) AS y FROM c JOIN p ON p.t > c.ct AND p.t <= c.ct + 7",
    "train_cutoff_scale": _with("brand_week", _cv("brand_week")) + "SELECT id, round(scale, 6) AS scale FROM sc",
    "seasonal_scale": _with("brand_week", _cv("brand_week")) + "SELECT id, round(ab, 6) AS absolute, round(sq, 6) AS squared FROM ss",
    "seasonal_naive_cv": _CV_STORE + "SELECT id, ct, i AS step, ds, round(y, 6) AS y, round(f, 6) AS value FROM cv WHERE model = 'SEASONAL_NAIVE'",
    "historic_average_cv": _CV_STORE + "SELECT id, ct, i AS step, ds, round(y, 6) AS y, round(f, 6) AS value FROM cv WHERE model = 'HISTORIC_AVERAGE'",
    "seasonal_naive_intervals": _intervals_sql("SEASONAL_NAIVE"), "historic_average_intervals": _intervals_sql("HISTORIC_AVERAGE"),
    "wide_forecasts": _with("brand_week", _cv("brand_week")) + "SELECT id, ct, i AS step, " + ", ".join(
        f"max(CASE WHEN model = '{m}' THEN {v} END) AS {m.lower()}{n}" for m in ("SEASONAL_NAIVE", "HISTORIC_AVERAGE") for n, v in (("", "round(f, 6)"), ("_median", "round(f, 6)"), ("_lo_80", f"round(f + {Z(0.1)!r} * sg, 6)"), ("_hi_80", f"round(f + {Z(0.9)!r} * sg, 6)"))
    ) + " FROM cv GROUP BY 1, 2, 3",
    "croston_fixed": _CROSTON, "tsb_fixed": _TSB, "croston_auto": _CROSTON_AUTO, "tsb_auto_events": _TSB_AUTO,
    **{f"metric_{m.lower()}": _metric_sql(m) for m in metrics.METRICS},
    "metrics_summary": _EVAL3 + "SELECT metric, model, round(avg(error), 6) AS mean, round(stddev_pop(error), 6) AS std, round(min(error), 6) AS min, round(max(error), 6) AS max FROM ev GROUP BY 1, 2",
    "metrics_melt": _EVAL3 + "SELECT id, metric, model, round(error, 6) AS error FROM ev WHERE metric IN ('MAE', 'SAPIS')",
    "mean_error": _EVAL3 + "SELECT metric, model, round(avg(error), 6) AS mean FROM ev GROUP BY 1, 2",
    "box_plot_stats": _box_sql(),
    "combine_models": _CV_EVENT + "SELECT id, ct, i AS step, ds, model, round(y, 6) AS y, round(f, 6) AS value FROM cv",
    "combine_wide": _CV_EVENT + "SELECT id, ct, i AS step, ds, round(any_value(y), 6) AS y, round(max(f) FILTER (WHERE model = 'HISTORIC_AVERAGE'), 6) AS HISTORIC_AVERAGE, round(max(f) FILTER (WHERE model = 'SEASONAL_NAIVE' AND i <= 5), 6) AS SEASONAL_NAIVE FROM cv GROUP BY 1, 2, 3, 4",
    "drop_dead_models": _CV_EVENT + "SELECT model, count(*) AS n FROM cv WHERE model = 'HISTORIC_AVERAGE' GROUP BY 1",
    "value_shares": _with("part_month", _cv("part_month")) + "SELECT model, round(avg(CASE WHEN i > 1 THEN 1 ELSE 0 END), 6) AS share FROM cv WHERE model = 'HISTORIC_AVERAGE' GROUP BY 1",
    "quantile_interpolate": _interpolate_sql(),
    "levels_from_quantiles": _with("brand_week", _cv("brand_week")) + f"SELECT id, level, round(f - z * sg, 6) AS lo, round(f + z * sg, 6) AS hi FROM cv CROSS JOIN (SELECT * FROM (VALUES {', '.join(f'({x}, {Z((1 + x / 100) / 2)!r})' for x in levels_of())}) AS v(level, z)) WHERE model = 'HISTORIC_AVERAGE' AND i = 1 AND ct = (SELECT max(ct) FROM c)",
}
