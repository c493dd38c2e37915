"""Order-aware minwise signatures of sequences (for edit similarity).

Items are (token, occurrence number). Each slot keeps the l items of least value, puts them in the order of their
positions and hashes their tokens. Ranks are limited before the exchange, so l rows a set, slot and task are moved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setforge.functions.hashing import draw


def ordered_signature(sequences: DataFrame, m: int, l: int, seed: int = 0, family: str = "md5") -> DataFrame:  # noqa: E741
    """(set_id, slot, value): md5 of the l tokens; sequences shorter than l have no row."""
    if not (m >= 1 and 1 <= l < 16):
        raise ValueError("m >= 1 and 1 <= l < 16")
    nth = F.row_number().over(Window.partitionBy("set_id", "item").orderBy("pos"))
    rows = sequences.where("item is not null").withColumn("nth", nth)
    rows = rows.select("set_id", "pos", "item", "nth", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("slot"))
    rows = rows.withColumn("x", draw(F.col("item"), F.col("nth"), F.col("slot"), seed, family=family))
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("set_id", "slot").orderBy("x", "pos"))).where(F.col("rank") <= l)
    kept = best.groupBy("set_id", "slot").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("item").cast("string").alias("item")))).alias("p")).where(F.size("p") == l)
    return kept.select("set_id", "slot", F.md5(F.array_join(F.transform("p", lambda x: x["item"]), "#")).alias("value"))
