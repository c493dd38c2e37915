"""Similarity of sets: of signatures slot by slot, and exact."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def neighbours(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of set ids that follow each other, a + 1 = b: as many pairs as sets at most."""
    ids = sets.select("set_id").distinct()
    return ids.select(F.col("set_id").alias("a"), (F.col("set_id") + 1).alias("b")).join(ids.withColumnRenamed("set_id", "b"), "b", "left_semi")


def equal_share(a: Column, b: Column) -> Column:
    """Share of equal slots of two wide signatures; an error if their lengths differ, null if there are no slots."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("signatures of different length"))).when(F.size(a) > 0, same / F.size(a))


def neighbour_slots(long: DataFrame, value: str = "value") -> DataFrame:
    """(a, b, slot, va, vb): long signatures of sets that follow each other, a + 1 = b, slot by slot.

    The signatures are made once: each row goes out under its own id and under the next one, and both meet in an
    aggregation. A join of the table with itself and with its ids makes them three times.
    """
    id_, no = F.col("set_id"), F.lit(False)
    ends = F.array(F.struct(id_.alias("b"), (~no).alias("right")), F.struct((id_ + 1).alias("b"), no.alias("right")))
    rows = long.where("set_id is not null").select("slot", F.col(value).alias("v"), F.explode(ends).alias("e")).select("e.b", "slot", "e.right", "v")
    right = F.col("right")
    both = rows.groupBy("b", "slot").agg(F.max(F.when(~right, F.col("v"))).alias("va"), F.max(F.when(right, F.col("v"))).alias("vb"), F.max(~right).alias("l"), F.max(right).alias("r"))
    return both.where("l and r").select((F.col("b") - 1).alias("a"), "b", "slot", "va", "vb")


def neighbour_jaccard(long: DataFrame, m: int, value: str = "value") -> DataFrame:
    """``signature_jaccard`` of the sets that follow each other."""
    return _share(neighbour_slots(long, value), m)


def signature_jaccard(long: DataFrame, pairs: DataFrame, m: int, value: str = "value") -> DataFrame:
    """(a, b, n_equal, jaccard, distance) of pairs (a, b) over long signatures; slots that a set lacks are unequal."""
    left = long.select(F.col("set_id").alias("a"), "slot", F.col(value).alias("va"))
    right = long.select(F.col("set_id").alias("b"), "slot", F.col(value).alias("vb"))
    return _share(pairs.join(left, "a").join(right, ["b", "slot"]), m)


def _share(rows: DataFrame, m: int) -> DataFrame:
    same = F.sum(F.when(F.col("va") == F.col("vb"), 1).otherwise(0))
    out = rows.groupBy("a", "b").agg(same.alias("n_equal"))
    return out.select("a", "b", "n_equal", (F.col("n_equal") / m).alias("jaccard"), (1 - F.col("n_equal") / m).alias("distance"))


def exact_jaccard(sets: DataFrame, pairs: DataFrame, m: int = 64) -> DataFrame:
    """(a, b, n_both, n_any, jaccard, distance, sigma) of item sets; sigma for a signature of m slots."""
    sizes = sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("n"))
    left = pairs.join(sets.withColumnRenamed("set_id", "a"), "a")
    both = left.join(sets.withColumnRenamed("set_id", "b"), ["b", "item"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    rows = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").join(both, ["a", "b"], "left").na.fill(0, ["n_both"])
    rows = rows.withColumn("n_any", F.col("na") + F.col("nb") - F.col("n_both"))
    jac = F.col("n_both") / F.col("n_any")
    return rows.select("a", "b", "n_both", "n_any", F.round(jac, 9).alias("jaccard"), F.round(1 - jac, 9).alias("distance"), F.round(F.sqrt(jac * (1 - jac) / m), 9).alias("sigma"))


def exact_probability_jaccard(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, jp, distance) of weighted sets: the sum over shared items i of 1 / sum_j max(a_j/a_i, b_j/b_i).

    max(a_j/a_i, b_j/b_i) is a_j/a_i where a_j/b_j >= a_i/b_i and b_j/b_i elsewhere, so with the items of a pair in the
    order of a_j/b_j two running sums give every inner sum: n log n instead of n squared.
    """
    left = pairs.join(sets.toDF("a", "item", "wa"), "a").select("a", "b", "item", "wa", F.lit(0.0).alias("wb"))
    right = pairs.join(sets.toDF("b", "item", "wb"), "b").select("a", "b", "item", F.lit(0.0).alias("wa"), "wb")
    rows = left.unionByName(right).groupBy("a", "b", "item").agg(F.sum("wa").alias("wa"), F.sum("wb").alias("wb"))
    rows = rows.withColumn("ratio", F.when(F.col("wb") > 0, F.col("wa") / F.when(F.col("wb") > 0, F.col("wb"))).otherwise(float("inf")))
    order = Window.partitionBy("a", "b").orderBy("ratio", "item")
    above, below = order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({"up": F.sum("wa").over(above), "down": F.coalesce(F.sum("wb").over(below), F.lit(0.0))})
    shared = (F.col("wa") > 0) & (F.col("wb") > 0)
    part = F.when(shared, 1.0 / (F.col("up") / F.when(shared, F.col("wa")) + F.col("down") / F.when(shared, F.col("wb"))))
    out = rows.groupBy("a", "b").agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("jp"))
    return out.select("a", "b", F.round("jp", 9).alias("jp"), F.round(1 - F.col("jp"), 9).alias("distance"))
