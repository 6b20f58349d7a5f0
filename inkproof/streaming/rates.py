"""Requests for each identity in fixed windows, as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.state import window_counts
from .keyed import NumberInWindow, use_rocksdb


def counts(stream: DataFrame, key: str, at: str, limit: int, length: str = "1 minute", late: str = "2 minutes") -> DataFrame:
    """Counts with a watermark, to be written in append or update mode.

    Append gives a window once, when the watermark has passed it, and then drops its state; requests
    that come later still are left out. (Complete mode would keep every window's state.)
    """
    return window_counts(stream.withWatermark(at, late), key, at, limit, length)


def numbered(stream: DataFrame, key: str, at: str, limit: int, seconds: int = 60, late: str = "2 minutes", order: tuple[str, ...] = ()) -> DataFrame:
    """Each request as it arrives, with ``window_start``, ``n`` (its number in its fixed window) and ``over_limit``.

    State is a count for each identity and open window; a timer drops it when the watermark, ``late``
    behind the latest request, passes the window's end. Requests later than that are left out.
    """
    use_rocksdb(stream.sparkSession)
    start = F.floor(F.unix_micros(at) / F.lit(1_000_000 * seconds)) * seconds
    timed = stream.withWatermark(at, late).withColumn("_window", start.cast("long"))
    fields = ", ".join(f"`{c}` {kind}" for c, kind in timed.dtypes)
    out = timed.groupBy(key, "_window").transformWithState(NumberInWindow([key, "_window"], timed.columns, at, list(order), limit, seconds), f"{fields}, n long, over_limit boolean", "append", "eventTime")
    return out.withColumn("window_start", F.timestamp_seconds("_window")).drop("_window")
