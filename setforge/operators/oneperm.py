"""One-permutation hashing with two densifications.

An item makes one draw: a bin and a uniform. Bins keep the least draw and its item's hash; that is the mergeable sketch.
Densification comes at read, inside the row of a set: an empty bin takes the value of an originally filled one. Optimal:
the bin probes a sequence of bins of its own. Reverse: filled bins are thrown at targets pass by pass, and the first to
reach a bin fills it. Either sequence is the same for all sets and ends with all bins in ring order, so that one filled
bin is enough.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setforge.functions.hashing import TWO52, draw_array, hash32, item_hash_array
from setforge.operators.fold import MEMO, folded, lengths


def bins(sets: DataFrame, m: int, family: str = "md5") -> DataFrame:
    """(set_id, slot, r, value): least uniform of each filled bin and the hash of its item."""
    if m < 1:
        raise ValueError("m >= 1")

    def draws(items):
        both = draw_array(items, [("b",), ("u",)], family)
        return np.column_stack([both[:, 0] % m, both[:, 1], item_hash_array(items, family)])

    def first(starts, scores, more):
        bin_, u, hash_ = np.ascontiguousarray(scores.T)
        run = np.repeat(np.arange(len(starts)), lengths(starts, len(scores)))
        at, n = run * m + bin_, len(starts) * m
        if n > MEMO:
            seen, at = np.unique(at, return_inverse=True)
            n = len(seen)
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, at, u)
        row = np.flatnonzero(u == best[at])
        return row, [pa.array(bin_[row], pa.int32()), pa.array(u[row]), pa.array(hash_[row])]

    parts = folded(sets, ["set_id"], F.col("item"), draws, 3, first, "slot int, u long, hash long", family)
    best = parts.groupBy("set_id", "slot").agg(F.min(F.struct("u", "hash")).alias("x"))
    return best.select("set_id", "slot", ((F.col("x.u").cast("double") + 1.0) / TWO52).alias("r"), F.col("x.hash").alias("value"))


def merge_bins(*sketches: DataFrame) -> DataFrame:
    both = sketches[0]
    for s in sketches[1:]:
        both = both.unionByName(s)
    best = both.groupBy("set_id", "slot").agg(F.min(F.struct("r", "value")).alias("x"))
    return best.select("set_id", "slot", "x.r", "x.value")


def _draw(m: int, *labels: object) -> int:
    return int(hashlib.md5("#".join(map(str, labels)).encode()).hexdigest()[:13], 16) % m


def probes(m: int) -> list[list[int]]:
    """For each bin the bins it looks at, optimal densification."""
    return [[_draw(m, "probe", k, t) for t in range(m)] + [(k + d) % m for d in range(1, m)] for k in range(m)]


def throws(m: int) -> list[list[int]]:
    """For each bin the bins that are thrown at it, by pass and bin, reverse densification."""
    hits: list[list[int]] = [[] for _ in range(m)]
    for turn in range(m):
        for k in range(m):
            hits[_draw(m, "throw", k, turn)].append(k)
    return [hits[k] + [(k + d) % m for d in range(1, m)] for k in range(m)]


def donors(m: int, scheme: str) -> list[list[int]]:
    if scheme not in ("optimal", "reverse"):
        raise ValueError("scheme is optimal or reverse")
    return probes(m) if scheme == "optimal" else throws(m)


def densify(raw: DataFrame, m: int, scheme: str = "optimal") -> DataFrame:
    """(set_id, sig: m values, n_empty) of raw bins; sets without a bin have no row."""
    found = raw.groupBy("set_id").agg(F.map_from_entries(F.collect_list(F.struct("slot", "value"))).alias("b"))
    filled = found.select("set_id", F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda k: F.try_element_at("b", k)).alias("v"))
    table = F.array(*[F.array(*map(F.lit, row)) for row in donors(m, scheme)])  # folded to one literal

    def give(v: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            taken = F.get(v, F.element_at(F.filter(F.get(table, k), lambda j: F.get(v, j).isNotNull()), 1))
            return F.coalesce(x, taken)

        return F.transform(v, one)

    return filled.select("set_id", give(F.col("v")).alias("sig"), F.size(F.filter("v", lambda x: x.isNull())).alias("n_empty"))


def compact(sig: Column, bits: int) -> Column:
    """The top bits of a 32-bit hash of each value; 32: the hash itself."""
    if not 1 <= bits <= 32:
        raise ValueError("1 <= bits <= 32")
    return F.transform(sig, lambda v: F.shiftrightunsigned(hash32(v), 32 - bits))
