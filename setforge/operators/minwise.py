"""Minwise sketches of unweighted sets in one pass: SuperMinHash in two forms.

An item visits all m slots in an order of its own; in the j-th slot it leaves r + j with r uniform. A slot keeps the
least value (float form), or the hash of the item that left it (integer form). An item's order and values are made once
in a task (``fold``) and sets are reduced to their slots there, so nothing else is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setforge.functions.hashing import draw, draw_array, item_hash_array, uniform_array
from setforge.operators.fold import folded, least, owners


def permutation(item: Column, m: int, family: str = "md5") -> Column:
    """The slots 0 .. m-1 in the item's order; up to 2048 of them rank and slot share one bigint, which sorts fast."""
    slots = F.sequence(F.lit(0), F.lit(m - 1))
    rank = lambda k: draw(item, k, "p", family=family)
    if m <= 2048:
        order = F.sort_array(F.transform(slots, lambda k: rank(k) * 2048 + k))
        return F.transform(order, lambda x: x.bitwiseAND(F.lit(2047).cast("bigint")).cast("int"))
    return F.transform(F.sort_array(F.transform(slots, lambda k: F.struct(rank(k).alias("b"), k.alias("k")))), lambda x: x["k"])


def _visits(items: list, m: int, family: str) -> tuple[np.ndarray, np.ndarray]:
    """(items, slots): for each slot the round j in which the item visits it; by round the 52 bits it leaves there."""
    rank = draw_array(items, [(k, "p") for k in range(m)], family)
    order = np.argsort(rank, axis=1, kind="stable")  # the order of ``permutation``: equal ranks by slot
    turn = np.empty_like(order)
    np.put_along_axis(turn, order, np.arange(m)[None, :], axis=1)
    bits = draw_array(items, [(j, "r") for j in range(m)], family)
    return turn, np.take_along_axis(bits, turn, axis=1)


def superminhash(sets: DataFrame, m: int, family: str = "md5") -> DataFrame:
    """(set_id, slot, value double)."""
    if m < 1:
        raise ValueError("m >= 1")

    def values(items):
        turn, bits = _visits(items, m, family)
        return uniform_array(bits) + turn

    parts = folded(sets, ["set_id"], F.col("item"), values, m, least, "slot int, x double", family)
    return parts.groupBy("set_id", "slot").agg(F.min("x").alias("value"))


def superminhash2(sets: DataFrame, m: int, family: str = "md5") -> DataFrame:
    """(set_id, slot, value bigint): the hash of the slot's item. Round and uniform share a bigint of 11 and 52 bits."""
    if m < 1:
        raise ValueError("m >= 1")
    if m > 2048:
        raise ValueError("m <= 2048")

    def values(items):
        turn, bits = _visits(items, m, family)
        return np.column_stack([turn << 52 | bits, item_hash_array(items, family)])

    def first(starts, scores, more):
        x = np.ascontiguousarray(scores[:, :m].T)
        row, slot = owners(starts, x)
        return row, [pa.array(slot, pa.int32()), pa.array(x[slot, row]), pa.array(scores[row, m])]

    parts = folded(sets, ["set_id"], F.col("item"), values, m + 1, first, "slot int, x long, hash long", family)
    best = parts.groupBy("set_id", "slot").agg(F.min(F.struct("x", "hash")).alias("best"))
    return best.select("set_id", "slot", F.col("best.hash").alias("value"))
