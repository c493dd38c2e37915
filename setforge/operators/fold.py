"""Sketches folded inside the map tasks: what an item scores in each slot is made once, and sets meet the exchange as slots.

The rows of a partition come in Arrow batches. The scores of their items are looked up in a memo of bounded size (a new
item is hashed, a full memo starts again), and rows of a set that follow each other are reduced to the least score of each
slot. What comes out is partial: an aggregation merges it, in whatever order or pieces the rows of a set came. Rows of a
set that lie scattered give right results too; ``together`` brings them side by side, so that fewer are moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Scores in the memo of a task, and in work at once; items in the memo and rows in work at most.
MEMO, STEP, ITEMS, ROWS = 1 << 22, 1 << 19, 1 << 18, 1 << 15

Scores = Callable[[list], np.ndarray]  # items -> (items, width)
#: (starts of the runs, scores of the rows, further columns) -> (row that gives the keys, columns)
Reduce = Callable[[np.ndarray, np.ndarray, list[pa.Array]], tuple[np.ndarray, list[pa.Array]]]


def together(sets: DataFrame, *keys: str) -> DataFrame:
    """The rows of each set side by side, in one partition unless they are very many: those are split."""
    return sets.hint("rebalance", *keys).sortWithinPartitions(*keys)


def hashed(item: Column, family: str) -> Column:
    """What of an item is looked up and hashed: its text in bytes, for xxhash64 its hash."""
    return F.xxhash64(item) if family == "xxhash64" else item.cast("string").cast("binary")


def steps(batches: Iterable[pa.RecordBatch], step: int) -> Iterator[pa.RecordBatch]:
    """The rows of the batches by ``step`` at most, small batches together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        while batch.num_rows:
            room = step - sum(x.num_rows for x in held)
            held.append(batch.slice(0, room))
            batch = batch.slice(room)
            if sum(x.num_rows for x in held) == step:
                yield pa.concat_batches(held)
                held = []
    if held:
        yield pa.concat_batches(held)


class Memo:
    """Scores by item, of a bounded number of items."""

    def __init__(self, scores: Scores, width: int):
        self.scores, self.limit = scores, max(1, min(ITEMS, MEMO // width))
        self.at: dict = {}
        self.rows: np.ndarray | None = None

    def __call__(self, items: pa.Array) -> np.ndarray:
        coded = pc.dictionary_encode(items, null_encoding="encode")
        names = coded.dictionary.to_pylist()
        at = np.fromiter(map(self.at.get, names, repeat(-1)), np.int64, len(names))
        if (at < 0).any():
            new = [names[k] for k in np.flatnonzero(at < 0)]
            if len(self.at) + len(new) > self.limit:
                self._forget(names, at)
            n = len(self.at)
            made = self.scores(new)
            if self.rows is None or n + len(new) > len(self.rows):
                held = np.empty((max(2 * (n + len(new)), 1024), made.shape[1]), made.dtype)
                if n:
                    held[:n] = self.rows[:n]
                self.rows = held
            self.rows[n : n + len(new)] = made
            at[at < 0] = np.arange(n, n + len(new))
            self.at.update(zip(new, range(n, n + len(new)), strict=True))
        return self.rows.take(at[coded.indices.to_numpy(zero_copy_only=False)], axis=0)

    def _forget(self, names: list, at: np.ndarray) -> None:
        """All but the items in use now."""
        used = np.flatnonzero(at >= 0)
        if len(used):
            self.rows[: len(used)] = self.rows[at[used]]
        at[used] = np.arange(len(used))
        self.at = {names[k]: n for n, k in enumerate(used)}


def _changes(column: pa.Array, out: np.ndarray) -> None:
    if pa.types.is_struct(column.type):
        for part in [pc.is_null(column), *column.flatten()]:
            _changes(part, out)
    elif pa.types.is_nested(column.type):
        out[:] = True
    else:
        codes = pc.dictionary_encode(column, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        out[1:] |= codes[1:] != codes[:-1]


def run_starts(keys: Sequence[pa.Array]) -> np.ndarray:
    """Where the keys differ from those of the row before."""
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for column in keys:
        _changes(column, new)
    return np.flatnonzero(new)


def lengths(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(starts, append=n)


def least(starts: np.ndarray, scores: np.ndarray, more: list[pa.Array]):
    """(slot, x): the least score of every slot."""
    m = scores.shape[1]
    best = np.minimum.reduceat(np.ascontiguousarray(scores.T), starts, axis=1).T
    return np.repeat(starts, m), [pa.array(np.tile(np.arange(m, dtype=np.int32), len(starts))), pa.array(best.ravel())]


def owners(starts: np.ndarray, by_slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the least scores, all of those that are equal; ``by_slot`` has a line for each slot."""
    n = by_slot.shape[1]
    best = np.repeat(np.minimum.reduceat(by_slot, starts, axis=1), lengths(starts, n), axis=1)
    slot, row = np.divmod(np.flatnonzero(by_slot == best), n)
    return row, slot


def folded(sets: DataFrame, keys: Sequence[str], item: Column, scores: Scores, width: int, reduce: Reduce, fields: str, family: str, more: Sequence[Column] = ()) -> DataFrame:
    """(keys, fields) of partial sketches; ``scores`` has ``width`` values an item."""
    kept = len(keys)
    schema = StructType([sets.select(k).schema[0] for k in keys] + StructType.fromDDL(fields).fields)
    step = max(1, min(ROWS, STEP // width))

    def run(batches):
        memo = Memo(scores, width)
        for batch in steps(batches, step):
            columns = batch.columns
            rows, values = reduce(run_starts(columns[:kept]), memo(columns[kept]), columns[kept + 1 :])
            rows = pa.array(rows)
            yield pa.RecordBatch.from_arrays([c.take(rows) for c in columns[:kept]] + values, schema.names)

    return sets.select(*keys, hashed(item, family).alias("hashed"), *[c.alias(f"more{k}") for k, c in enumerate(more)]).mapInArrow(run, schema)
