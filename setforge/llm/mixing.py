"""Mixing sources to target weights by Pfair scheduling.

Documents of a source come in blocks, and a slot takes one block. The target is the ideal division of the slots: at every moment
the sources that have something left share in proportion to their weights, so a source's share grows when another one is
used up. Block k (from 1) of a source may be taken from the slot on in which the ideal division reaches k-1 of its blocks and must
be taken by the slot in which it reaches k; of the released blocks the one with the earliest deadline gets the slot. On
one sequence this is feasible, as the ideal division itself keeps to these windows, and then after every slot each source's
number of blocks is less than one away from its ideal number, from the first slot to the last and for any number of
sources. Windows are computed in whole numbers from the weights as given, never from rounded ones, so the deviation
doesn't grow with the number of slots. Nothing is dropped or repeated: every row gets one place.

Sources of equal weight and equal size have the same windows. The driver schedules such kinds, not sources: it holds the
kinds (R rows have at most sqrt(2 R) different sizes, and no more kinds unless more weights are given) and, for each of their blocks, the
runs of slots that its members take in turn. Blocks have ``block_rows`` rows, or so many more that there are about ``max_blocks`` of
them and one a source, so there are at most about twice ``max_blocks`` runs. The slots of all sources are written out from the
runs on the executors. Members of a kind are numbered in the order of a hash of their names.

Within a source, rows are in the order of a hash of doc_id. Ranks need no task with a whole source: a source's hash range
is cut in buckets of about ``bucket_rows`` rows, ranks count inside a bucket, and bucket sizes are added up; members of a kind
are numbered in the same way. What is broadcast are the kinds and the sources of more than ``bucket_rows`` rows.

Defined results: a null source is a source of its own; sources without a weight, or with 0, follow when the weighted
ones are used up, in proportion to their sizes; rows with equal doc_id follow each other; an empty table gives an empty
result; input columns named like the three results are replaced.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MixParams:
    """weights: by source; None: the number of rows to the power ``temperature``. max_sources has no effect: all sources are scheduled."""

    weights: Mapping[str, float] | None = None
    temperature: float = 0.5
    block_rows: int = 16
    bucket_rows: int = 4_096
    max_blocks: int = 1 << 20
    max_sources: int = 2_048

    def __post_init__(self):
        if min(self.block_rows, self.bucket_rows, self.max_blocks, self.max_sources) < 1:
            raise ValueError("block_rows, bucket_rows, max_blocks, max_sources >= 1")
        if self.weights and any(not 0 <= w < float("inf") for w in self.weights.values()):
            raise ValueError("weights are finite and not negative")


def whole_weights(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of the weights."""
    ratios = [float(w).as_integer_ratio() for w in weights]
    base = max(d for _, d in ratios)  # denominators of floats are powers of two
    return [n * (base // d) for n, d in ratios]


def turns(weights: list[int], blocks: list[int], members: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """The whole schedule of kinds of sources, kind c having members[c] sources of blocks[c] blocks: runs (c, k, i, t, length).

    Members i, i + 1, ... of kind c, from 0, take their block k, from 0, in the slots t, t + 1, ...; slots ascend from 0 without gaps.
    """
    kinds = range(len(weights))
    ends = sorted(kinds, key=lambda c: Fraction(blocks[c], weights[c]))  # the order in which the ideal division uses them up
    used, rate = [0], [sum(m * w for m, w in zip(members, weights, strict=True))]
    for c in ends:  # blocks of the kinds used up, weight of the others
        used.append(used[-1] + members[c] * blocks[c])
        rate.append(rate[-1] - members[c] * weights[c])

    def reached(c: int, k: int) -> tuple[int, int]:
        """When the ideal division reaches k blocks of a member, rounded down and up."""
        w = weights[c]
        j = bisect_left(kinds, True, key=lambda j: blocks[ends[j]] * w >= k * weights[ends[j]])
        return used[j] + k * rate[j] // w, used[j] - (-k * rate[j] // w)

    ready: list[tuple[int, int, int, int]] = []  # deadline, kind, block, member
    waiting = [(0, c, 0) for c in kinds]  # release, kind, block
    t = 0
    while ready or waiting:
        while waiting and waiting[0][0] <= t:
            c, k = heapq.heappop(waiting)[1:]
            down, up = reached(c, k + 1)
            heapq.heappush(ready, (up, c, k, 0))
            if k + 1 < blocks[c]:
                heapq.heappush(waiting, (down, c, k + 1))
        deadline, c, k, i = heapq.heappop(ready)
        length = min(members[c] - i, waiting[0][0] - t) if waiting else members[c] - i
        assert t + length <= deadline
        yield c, k, i, t, length
        t += length
        if i + length < members[c]:
            heapq.heappush(ready, (deadline, c, k, i + length))


def edf(weights: list[int], blocks: list[int]) -> list[list[int]]:
    """Slots, from 0, of each source's blocks, until the first source has none left."""
    slots: list[list[int]] = [[] for _ in weights]
    for k, _, _, t, _ in turns(weights, blocks, [1] * len(weights)):
        slots[k].append(t)
        if len(slots[k]) == blocks[k]:
            break
    return slots


def schedule(blocks: list[int], weights: list[float], members: list[int]) -> Iterator[tuple[int, int, int, int, int]]:
    """The runs of all kinds: first those with a weight, then the others in proportion to their blocks."""
    begin = 0
    for group in ([c for c, w in enumerate(weights) if w > 0], [c for c, w in enumerate(weights) if not w > 0]):
        if group:
            own = [blocks[c] for c in group]
            w = whole_weights([weights[c] for c in group]) if weights[group[0]] > 0 else own
            for c, k, i, t, length in turns(w, own, [members[c] for c in group]):
                yield group[c], k, i, begin + t, length
            begin += sum(blocks[c] * members[c] for c in group)


_PIECE = 4096
_RUN = ["kind", "k", "i", "slot", "length"]


def _timetable(spark: SparkSession, runs: Iterator[tuple[int, int, int, int, int]]) -> DataFrame:
    """kind, k, i, slot of every block of every source."""
    columns = [array("q") for _ in _RUN]
    for c, k, i, t, length in runs:
        for at in range(0, length, _PIECE):
            for column, x in zip(columns, (c, k, i + at, t + at, min(_PIECE, length - at)), strict=True):
                column.append(x)
    deal = np.argsort(np.arange(len(columns[0])) % 64, kind="stable")  # long runs go to different tasks
    table = pa.table({name: np.frombuffer(column, np.int64)[deal] if len(column) else pa.array([], pa.int64()) for name, column in zip(_RUN, columns, strict=True)})
    pieces = spark.createDataFrame(table).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1)).alias("at"))
    return pieces.select("kind", "k", (F.col("i") + F.col("at")).alias("i"), (F.col("slot") + F.col("at")).alias("slot"))


def _sizes(docs: DataFrame, p: MixParams) -> DataFrame:
    """s, n, w of every source."""
    sizes = docs.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    if p.weights is None:
        return sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(p.temperature))))
    given = docs.sparkSession.createDataFrame([(f"={s}", float(w)) for s, w in p.weights.items()] or [("", 0.0)], "s string, w double")
    return sizes.join(given, "s", "left").withColumn("w", F.coalesce("w", F.lit(0.0)))


def _hash(name: str):
    return F.shiftrightunsigned(F.xxhash64(name), 33)  # 31 bits of a hash


def _counted(df: DataFrame, key: str, last: str) -> tuple[DataFrame, DataFrame]:
    """df (with key, h, buckets) with its bucket and nth, the rank there by h and last; key, bucket, size, before of all buckets."""
    df = df.withColumn("bucket", F.shiftright(F.col("h") * F.col("buckets"), 31)).drop("buckets")
    sizes = df.groupBy(key, "bucket").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.withColumn("before", F.sum("size").over(Window.partitionBy(key).orderBy("bucket")) - F.col("size"))
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(key, "bucket").orderBy("h", last)) - 1), before


def mix(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """docs with mix_block (of its source), mix_slot and mix_position (the order; gaps only where a last block is short)."""
    spark, c = docs.sparkSession, F.col
    given = [x for x in docs.columns if x not in ("mix_block", "mix_slot", "mix_position")]
    # s is never null, so that one exchange serves window and join
    source = F.coalesce(F.concat(F.lit("="), c("source").cast("string")), F.lit("-"))
    rows = docs.select(F.struct(*given).alias("row"), source.alias("s"), c("doc_id").cast("string").alias("id"))
    sizes = _sizes(rows, p)
    kinds = sorted(sizes.groupBy("w", "n").agg(F.count(F.lit(1)).alias("m")).collect(), key=lambda r: (-r["w"], r["n"]))
    block_rows = max(p.block_rows, -(-sum(r["n"] * r["m"] for r in kinds) // p.max_blocks))
    timetable = _timetable(spark, schedule([-(-r["n"] // block_rows) for r in kinds], [r["w"] for r in kinds], [r["m"] for r in kinds]))

    table = [(r["w"], r["n"], k, -(-r["m"] // p.bucket_rows)) for k, r in enumerate(kinds)]
    members = sizes.join(F.broadcast(spark.createDataFrame(table, "w double, n long, kind long, buckets long")), ["w", "n"])
    members, before = _counted(members.select("s", "kind", "buckets", _hash("s").alias("h")), "kind", "s")
    members = members.join(before, ["kind", "bucket"]).select("s", "kind", (c("before") + c("nth")).alias("i"))

    large = F.broadcast(sizes.where(c("n") > p.bucket_rows).select("s", F.ceil(c("n") / p.bucket_rows).alias("buckets")))
    rows = rows.withColumn("h", _hash("id")).join(large, "s", "left").withColumn("buckets", F.coalesce("buckets", F.lit(1).cast("long")))
    rows, before = _counted(rows, "s", "id")
    blocks = F.explode(F.sequence(F.expr(f"before div {block_rows}"), F.expr(f"(before + size - 1) div {block_rows}")))
    slots = before.join(members, "s").select("s", "bucket", "before", "kind", "i", blocks.alias("k")).join(timetable, ["kind", "k", "i"])
    slots = slots.groupBy("s", "bucket").agg(F.min("before").alias("before"), F.array_sort(F.collect_list("slot")).alias("slots"))  # slots ascend with blocks
    rows = rows.join(slots, ["s", "bucket"]).withColumn("rank", c("before") + c("nth")).withColumn("block", F.expr(f"rank div {block_rows}"))
    rows = rows.withColumn("slot", F.get("slots", (c("block") - F.expr(f"before div {block_rows}")).cast("int")))
    return rows.select("row.*", c("block").cast("long").alias("mix_block"), c("slot").alias("mix_slot"), (c("slot") * block_rows + c("rank") % block_rows).cast("long").alias("mix_position"))


def in_order(docs: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """The rows of docs, partition by partition in the order of the mix, with their own columns only."""
    mixed = mix(docs, p).repartitionByRange("mix_position").sortWithinPartitions("mix_position")
    return mixed.drop("mix_block", "mix_slot", "mix_position")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    from setforge.llm.common import table

    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
