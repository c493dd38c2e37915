"""Consistent weighted sampling: signatures whose slots agree with the probability Jaccard similarity.

Long form: (set_id, slot, h, item), the item of least h = E(item, slot) / weight. Min and argmin are associative, so sets
are reduced to their slots on the map side (``fold``), a hot set too, and sketches merge by the least h of each slot: the
sketch of the pointwise largest weights.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from setforge.functions.hashing import draw, draw_array, truncated_exponential, uniform_array, uniform_draw
from setforge.operators.fold import ROWS, STEP, folded, hashed, lengths, owners, run_starts, steps, together


def _least(rows: DataFrame, *keys: str) -> DataFrame:
    best = rows.groupBy(*keys).agg(F.min(F.struct("h", "item")).alias("m"))
    return best.select(*keys, "m.h", "m.item")


def sample(sets: DataFrame, m: int, family: str = "md5", scattered: bool = True) -> DataFrame:
    """Independent slots (P-MinHash): for each slot an exponential clock of rate weight for every item.

    scattered: the rows of a set don't follow each other (as those of ``token_weights`` do) and are brought together first.
    """
    if m < 1:
        raise ValueError("m >= 1")
    labels = [(k,) for k in range(m)]

    def clocks(items):
        return -np.log(uniform_array(draw_array(items, labels, family)))

    def first(starts, clock, more):
        h = np.ascontiguousarray(clock.T) / more[0].to_numpy(zero_copy_only=False)
        row, slot = owners(starts, h)
        return row, [pa.array(slot, pa.int32()), pa.array(h[slot, row]), more[1].take(pa.array(row))]

    rows = together(sets, "set_id") if scattered else sets
    kind = sets.select("item").schema[0].dataType.simpleString()
    parts = folded(rows, ["set_id"], F.col("item"), clocks, m, first, f"slot int, h double, item {kind}", family, [F.col("weight"), F.col("item")])
    return _least(parts, "set_id", "slot")


def item_points(items: DataFrame, m: int, points: int, family: str = "md5") -> DataFrame:
    """(item, slot, c) for distinct items: the first arrival in each slot of the item's unit-rate point process.

    Point i arrives at i - 1 + E, E exponential of rate ln(m/(m-1)) on [0, 1), in a slot drawn with replacement. Items that
    the first ``points`` leave without some slot go on, up to 64 * m points (a slot is missed with probability e**-64).
    """
    if m < 2:
        raise ValueError("m >= 2")
    rows = items.select("item").distinct().select("item", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    slot = lambda i: (draw(F.col("item"), i, "s", family=family) % m).cast("int")
    arrival = lambda i: i + truncated_exponential(uniform_draw(F.col("item"), i, "e", family=family), math.log(m / (m - 1)))
    first = rows.select("item", slot(F.col("i")).alias("slot"), arrival(F.col("i")).alias("c")).groupBy("item", "slot").agg(F.min("c").alias("c"))
    whole = first.groupBy("item").agg(F.collect_list(F.struct("slot", "c")).alias("hits"))  # m at most
    none = F.filter("hits", lambda x: F.lit(False))
    later = F.transform(F.sequence(F.lit(points), F.lit(max(64 * m, 2 * points) - 1)), lambda i: F.struct(slot(i).alias("slot"), arrival(i).alias("c")))
    later = F.filter(later, lambda x: ~F.array_contains(F.transform("hits", lambda y: y["slot"]), x["slot"]))
    more = F.when(F.size("hits") < m, later).otherwise(none)
    every = whole.select("item", F.explode(F.concat("hits", more)).alias("p")).select("item", "p.slot", "p.c")
    return every.groupBy("item", "slot").agg(F.min("c").alias("c"))  # already together by item


def sample_points(sets: DataFrame, m: int, points: int | None = None, family: str = "md5", scattered: bool = True) -> DataFrame:
    """Correlated slots (one point process for each item): the items' points are those of ``item_points``.

    A set draws the next point of an item only while it can still take a slot: an item of weight w, whose i-th point isn't
    below i / w, is done once every slot of the set has less. That leaves no slot otherwise than all points would.
    """
    if m < 2:
        raise ValueError("m >= 2")
    points = points or 12 * m
    last = max(64 * m, 2 * points)
    kind = sets.select("item").schema[0].dataType.simpleString()
    schema = StructType([*sets.select("set_id").schema.fields, *StructType.fromDDL(f"slot int, h double, item {kind}").fields])

    def run(batches):
        for batch in steps(batches, max(1, min(ROWS, STEP // m))):
            starts = run_starts([batch.column(0)])
            row, slot, h = _arrivals(starts, batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False), m, last, family)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(slot, pa.int32()), pa.array(h), batch.column(3).take(at)], schema.names)

    rows = together(sets, "set_id") if scattered else sets
    parts = rows.select("set_id", hashed(F.col("item"), family).alias("hashed"), "weight", "item").mapInArrow(run, schema)
    return _least(parts, "set_id", "slot")


def _arrivals(starts: np.ndarray, items: list, weight: np.ndarray, m: int, last: int, family: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, slot, h) of the points that can own a slot of their run, all that own one among them."""
    n, rate = len(items), math.log(m / (m - 1))
    owner = np.repeat(np.arange(len(starts)), lengths(starts, n))
    best, hit, n_hit = np.full((len(starts), m), np.inf), np.zeros((n, m), bool), np.zeros(n, np.int64)
    active, found = np.arange(n), []
    for i in range(last):
        names = [items[k] for k in active]
        slot = draw_array(names, [(i, "s")], family)[:, 0] % m
        new = np.flatnonzero(~hit[active, slot])
        row, slot = active[new], slot[new]
        hit[row, slot] = True
        n_hit[row] += 1
        can = i / weight[row] <= best[owner[row], slot]
        row, slot = row[can], slot[can]
        if len(row):
            u = uniform_array(draw_array([names[k] for k in new[can]], [(i, "e")], family)[:, 0])
            h = (i - np.log(1.0 - (1.0 - u) * (1.0 - float(np.exp(-rate)))) / rate) / weight[row]
            np.minimum.at(best, (owner[row], slot), h)
            found.append((row, slot, h))
        worst = best.max(axis=1)
        active = active[((i + 1) / weight[active] <= worst[owner[active]]) & (n_hit[active] < m)]
        if not len(active):
            break
    row, slot, h = (np.concatenate(x) for x in zip(*found, strict=True))
    own = h == best[owner[row], slot]
    return row[own], slot[own], h[own]


def merge(*sketches: DataFrame) -> DataFrame:
    """The sketch of the pointwise largest weights of the same sets."""
    both = sketches[0]
    for s in sketches[1:]:
        both = both.unionByName(s)
    return _least(both.select("set_id", "slot", "h", "item"), "set_id", "slot")


def merge_groups(sketches: DataFrame, *keys: str) -> DataFrame:
    return _least(sketches.select(*keys, "slot", "h", "item"), *keys, "slot")


def wide(long: DataFrame, value: str | Column = "item", name: str = "sig") -> DataFrame:
    """(set_id, sig): the values by slot; a set has m of them at most."""
    value = F.col(value) if isinstance(value, str) else value
    pairs = long.groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct(F.col("slot"), value.alias("v")))).alias("p"))
    return pairs.select("set_id", F.transform("p", lambda x: x["v"]).alias(name))
