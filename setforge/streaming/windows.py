"""Sketches of event streams: registers by tumbling window, batch or stream.

Registers only grow, so late rows within the watermark update a window in place, and a stream's state is one row a
window, key and slot. The same function runs on a batch and on a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setforge.functions.hashing import exponential, uniform_draw
from setforge.operators.setsketch import SketchParams, register


def window_registers(events: DataFrame, p: SketchParams, time: str, item: str, key: str, width: str = "1 day", late: str | None = None, slide: str | None = None, family: str = "md5") -> DataFrame:
    """(window_start, key, slot, reg) of the items in each tumbling (or sliding) window of the time column."""
    rows = events.where(F.col(item).isNotNull() & F.col(time).isNotNull())
    if late:  # a watermark needs a time with a zone: that of the session
        rows = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    rows = rows.select(F.col(time).alias("at"), F.col(key).alias("key"), F.col(item).alias("item"), F.explode(F.sequence(F.lit(0), F.lit(p.m - 1))).alias("slot"))
    x = exponential(uniform_draw(F.col("item"), F.col("slot"), "k", family=family)) / p.a
    rows = rows.withColumn("reg", register(x, p))
    span = F.window("at", width, slide) if slide else F.window("at", width)
    out = rows.groupBy(span.alias("w"), "key", "slot").agg(F.max("reg").alias("reg"))
    return out.select(F.col("w.start").alias("window_start"), "key", "slot", "reg")


def session_members(events: DataFrame, time: str, item: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(item, session_start, session_end, n) by gaps of inactivity."""
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if late else events
    out = rows.groupBy(F.session_window(time, gap).alias("w"), F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("item", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
