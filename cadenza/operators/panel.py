"""From fact rows to a complete panel: roll-ups, calendar, fills, padding.

After :func:`complete` a panel has one row per series and period and a position ``t`` counted from
one. Positions replace date arithmetic in everything that follows, so windows need neither range joins nor
a look at the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.spec import Frequency, PanelSpec


def bucket(time: Column, frequency: Frequency) -> Column:
    """First day of the period: the day, the Monday, the first of the month."""
    return {Frequency.DAILY: F.to_date(time), Frequency.WEEKLY: F.to_date(F.date_trunc("week", time)), Frequency.MONTHLY: F.to_date(F.date_trunc("month", time))}[frequency]


def roll_up(fact: DataFrame, keys: list[Column], time: Column, frequency: Frequency, aggregates: dict[str, Column]) -> DataFrame:
    """Frequency and hierarchy roll-up in one aggregation: targets are sums, numeric features means, static ones first values, as given."""
    return fact.groupBy(*keys, bucket(time, frequency).alias("ds")).agg(*(c.alias(n) for n, c in aggregates.items()))


def roll_up_levels(fact: DataFrame, levels: dict[str, tuple[str, ...]], time: Column, frequency: Frequency, aggregates: dict[str, Column]) -> DataFrame:
    """Several hierarchy levels in one pass over the facts: (level, the key columns with null where rolled up, ds, aggregates)."""
    keys = sorted({c for cols in levels.values() for c in cols})
    masks = {name: sum((c not in cols) << (len(keys) - i) for i, c in enumerate(keys)) for name, cols in levels.items()}  # ds is the last bit
    dated = fact.withColumn("ds", bucket(time, frequency))
    sets = [[F.col(c) for c in cols] + [F.col("ds")] for cols in levels.values()]
    out = dated.groupingSets(sets, *keys, "ds").agg(F.grouping_id(*keys, "ds").alias("_g"), *(c.alias(n) for n, c in aggregates.items()))
    name = F.coalesce(*(F.when(F.col("_g") == g, F.lit(n)) for n, g in masks.items()))
    return out.select(name.alias("level"), *keys, "ds", *aggregates)


def periods_between(start: Column, end: Column, frequency: Frequency) -> Column:
    """Periods from ``start`` to ``end``, both counted."""
    if frequency is Frequency.MONTHLY:
        return ((F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start) + 1).cast("int")
    return F.floor(F.datediff(end, start) / frequency.step + 1).cast("int")


def calendar(panel: DataFrame, frequency: Frequency, time: str = "ds") -> DataFrame:
    """One row: start, end, periods."""
    ends = panel.agg(F.min(time).alias("start"), F.max(time).alias("end"))
    return ends.withColumn("periods", periods_between(F.col("start"), F.col("end"), frequency))


def shift(date: Column, periods: Column | int, frequency: Frequency) -> Column:
    n = F.lit(periods) if isinstance(periods, int) else periods
    return F.add_months(date, n) if frequency is Frequency.MONTHLY else F.date_add(date, (n * frequency.step).cast("int"))


def complete(panel: DataFrame, spec: PanelSpec, frequency: Frequency) -> DataFrame:
    """Every series at every period from the first to the last of all series, with position ``t`` and ``periods``; absent cells are null."""
    cal = calendar(panel, frequency, spec.time).where("periods IS NOT NULL")
    grid = panel.select(spec.id).distinct().join(F.broadcast(cal))  # one row of calendar
    grid = grid.select(spec.id, "start", "periods", F.explode(F.sequence(F.lit(1), F.col("periods"))).alias("t"))
    grid = grid.select(spec.id, shift(F.col("start"), F.col("t") - 1, frequency).alias(spec.time), "t", "periods")
    return grid.join(panel, [spec.id, spec.time], "left")


def fill(panel: DataFrame, spec: PanelSpec, across: bool = False) -> DataFrame:
    """Features: next value of the series, else its last one; target: 0. ``across`` lets a series take values of the one before it, as an ungrouped fill does."""
    own = Window.partitionBy(spec.id).orderBy(spec.time)
    ahead, behind = own.rowsBetween(0, Window.unboundedFollowing), own.rowsBetween(Window.unboundedPreceding, 0)
    features = [c for c in spec.columns if c not in spec.base]
    out = panel.withColumns({c: F.coalesce(F.first(c, True).over(ahead), *([] if across else [F.last(c, True).over(behind)])) for c in features})
    if across and features:
        whole = Window.orderBy(spec.id, spec.time).rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumns({c: F.last(c, True).over(whole) for c in features})
    return out.withColumn(spec.target, F.coalesce(spec.target, F.lit(0.0)))


def select_panel(panel: DataFrame, spec: PanelSpec, framework: str = "neural") -> DataFrame:
    """Columns that a family of models reads: statistical ones the base columns only."""
    keep = spec.base if framework == "stats" else spec.columns
    return panel.select(*keep)


def shrink(panel: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Doubles as floats, but for the columns of ``keep``: half the bytes of a shuffle or a file. Strings are dictionaries in Parquet anyway."""
    return panel.withColumns({c: F.col(f"`{c}`").cast("float") for c, kind in panel.dtypes if kind == "double" and c not in keep})


def static_table(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row per series with its static features (those of the earliest period)."""
    return panel.groupBy(spec.id).agg(*(F.min_by(c, spec.time).alias(c) for c in spec.static))


def shortest_series(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    return panel.groupBy(spec.id).count().agg(F.min("count").alias("shortest"))


def pad_short(panel: DataFrame, spec: PanelSpec, frequency: Frequency, least: int) -> DataFrame:
    """Rows of zeros before series of fewer than ``least`` rows; static features keep the series' value, other text features are null."""
    kinds = dict(panel.dtypes)
    ends = panel.groupBy(spec.id).agg(F.count("*").alias("_n"), F.min(spec.time).alias("_start"), *(F.min_by(c, spec.time).alias(c) for c in spec.static))
    short = ends.where(F.col("_n") < least).withColumn("_k", F.explode(F.sequence(F.lit(1), (F.lit(least) - F.col("_n")).cast("int"))))
    zero = lambda c: F.lit(None if kinds[c] in ("string", "date") else 0).cast(kinds[c])
    columns = [c for c in panel.columns if c not in (spec.id, spec.time, *spec.static)]
    pads = short.select(spec.id, shift(F.col("_start"), -F.col("_k"), frequency).alias(spec.time), *spec.static, *(zero(c).alias(c) for c in columns))
    return panel.unionByName(pads)


def infer_step(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Most frequent distance in days between neighbouring rows of the longest series (ties: the least id, the least distance)."""
    longest = panel.groupBy(spec.id).count().orderBy(F.desc("count"), spec.id).limit(1).select(spec.id)
    one = panel.join(F.broadcast(longest), spec.id, "left_semi")
    gaps = one.select(F.datediff(spec.time, F.lag(spec.time).over(Window.partitionBy(spec.id).orderBy(spec.time))).alias("days")).where("days IS NOT NULL")
    return gaps.groupBy("days").count().orderBy(F.desc("count"), "days").limit(1).select("days")


def future_frame(panel: DataFrame, spec: PanelSpec, frequency: Frequency, horizon: int) -> DataFrame:
    """The periods after each series' last one."""
    last = panel.groupBy(spec.id).agg(F.max(spec.time).alias("_last"))
    steps = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.select(spec.id, shift(F.col("_last"), F.col("step"), frequency).alias(spec.time), "step")
