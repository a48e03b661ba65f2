"""Roll-ups of event streams: the batch frequency roll-up with event-time windows and a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.spec import Frequency

_WINDOW = {Frequency.DAILY: ("1 day", "0 days"), Frequency.WEEKLY: ("7 days", "4 days")}  # weeks since the epoch's Thursday start four days later, on Mondays


def rolling_demand(events: DataFrame, key: Column, time: str, frequency: Frequency, aggregates: dict[str, Column], lateness: str = "2 days") -> DataFrame:
    """(id, ds, aggregates) per series and period; works on streams and on batches alike. Months have no fixed length and aren't offered."""
    if frequency not in _WINDOW:
        raise ValueError("streams are rolled up by day or week")
    length, start = _WINDOW[frequency]
    window = F.window(F.col(time), length, startTime=start)
    out = events.withWatermark(time, lateness).groupBy(key.alias("id"), window.alias("w")).agg(*(c.alias(n) for n, c in aggregates.items()))
    return out.select("id", F.to_date("w.start").alias("ds"), *aggregates)
