"""Quality classifier: logistic regression on hashed word n-grams, learned by follow-the-regularised-leader updates.

A word gives two tokens: its letters in lower case, and its shape (runs of capitals, small letters, digits, and the
other characters as they are). Features are hashed 1- and 2-grams of either, and whether a word equals the one before.
Values are counts over the number of words, so a score is a sparse dot product, however long the text.

FTRL-proximal keeps per weight the sums z and n of gradients and their squares and solves each weight in closed form with
L1 and L2, so most weights are exactly zero. Learning reads a bounded sample, ``max_rows`` labelled rows or so chosen by
a hash of doc_id, in one task; the non-zero weights (2 ** bits at most) go to the scoring tasks.

Defined results: null text counts as empty; an empty text is scored by the bias alone; null labels are left out and, of
repeated label rows, the largest holds; without labelled rows every score is 0.5; repeated document rows are scored
each; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setforge.llm.common import crc_bucket


@dataclass(frozen=True)
class FtrlParams:
    bits: int = 18
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    scale: float = 10.0
    epochs: int = 4
    max_rows: int = 8000
    folds: int = 3
    held_out: int = 1


class Words(dict):
    """Memo: word -> its letters' hash (high half) and its shape's hash (low half)."""

    def __missing__(self, word: str) -> int:
        from xxhash import xxh32_intdigest as digest

        if len(self) > 200_000:
            self.clear()
        shape = re.sub(r"(x+)", "x", re.sub(r"\d+", "0", "".join("X" if c.isupper() else "x" if c.isalpha() else c for c in word)))
        letters = "".join(c for c in word.lower() if c.isalnum())
        self[word] = value = digest(letters.encode("utf-8", "surrogatepass"), 7) << 32 | digest(shape[:32].encode("utf-8", "surrogatepass"), 11)
        return value


def _slots(x: np.ndarray, kind: int, bits: int) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15 * (kind + 1) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - bits)).astype(np.int64)


def features(text: str | None, memo: Words, p: FtrlParams) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text; no entries for an empty one."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    both = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    core, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    k = np.uint64(0x100000001B3)
    every = [_slots(core, 0, p.bits), _slots(shape, 1, p.bits), _slots(core[:-1] * k + core[1:], 2, p.bits), _slots(shape[:-1] * k + shape[1:], 3, p.bits), _slots((core[:-1] == core[1:]).astype(np.uint64), 4, p.bits)]
    slots, counts = np.unique(np.concatenate(every), return_counts=True)
    return slots, counts * (p.scale / len(words))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], p: FtrlParams) -> tuple[np.ndarray, float]:
    """Weights and bias from (slots, values, label) rows, in the order given, ``epochs`` times."""
    z, n, w = np.zeros(1 << p.bits), np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    bias_z = bias_n = bias = 0.0
    for _ in range(p.epochs):
        for slots, values, label in rows:
            x = w[slots] @ values + bias
            g0 = 1 / (1 + np.exp(-np.clip(x, -35, 35))) - label
            g = g0 * values
            old = n[slots]
            new = old + g * g
            z[slots] += g - (np.sqrt(new) - np.sqrt(old)) / p.alpha * w[slots]
            n[slots] = new
            zs = z[slots]
            w[slots] = np.where(np.abs(zs) <= p.l1, 0, -(zs - np.sign(zs) * p.l1) / ((p.beta + np.sqrt(new)) / p.alpha + p.l2))
            step = (np.sqrt(bias_n + g0 * g0) - np.sqrt(bias_n)) / p.alpha
            bias_z += g0 - step * bias
            bias_n += g0 * g0
            bias = -bias_z / ((p.beta + np.sqrt(bias_n)) / p.alpha)
    return w, float(bias)


def train(docs: DataFrame, labels: DataFrame, p: FtrlParams = FtrlParams()) -> tuple[list[int], list[float], float]:
    """(slots, weights, bias), learned from the rows of labels (doc_id, quality) that aren't held out, and their texts."""
    own = labels.where((crc_bucket("doc_id", p.folds) != p.held_out) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    total = own.count()
    if not total:
        return [], [], 0.0
    share = min(1.0, p.max_rows / total)
    some = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = rows.join(F.broadcast(some), "doc_id")  # about max_rows rows of two numbers

    def run(batches):
        memo, seen = Words(), []
        for batch in batches:
            for i, t, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                seen.append((i, *features(t.as_py(), memo, p), y))
        mixed = lambda i: i * 0x9E3779B97F4A7C15 % 2**64
        seen.sort(key=lambda r: (mixed(r[0]), len(r[1])))
        w, bias = fit([r[1:] for r in seen], p)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.list_(pa.int64())), pa.array([w[at]], pa.list_(pa.float64())), pa.array([bias])], ["slots", "weights", "bias"])

    got = sample.select("doc_id", "text", "label").repartition(1).mapInArrow(run, "slots array<long>, weights array<double>, bias double").collect()
    return (got[0]["slots"], got[0]["weights"], got[0]["bias"]) if got else ([], [], 0.0)


def score(docs: DataFrame, model: tuple[list[int], list[float], float], p: FtrlParams = FtrlParams()) -> DataFrame:
    """doc_id, score of every row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast((np.array(model[0], np.int32), np.array(model[1], np.float32), model[2]))  # 2 ** bits weights at most

    def run(batches):
        slots, weights, bias = sent.value
        w, memo = np.zeros(1 << p.bits), Words()
        w[slots] = weights
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                out = []
                for t in batch.column(1):
                    at, values = features(t.as_py(), memo, p)
                    out.append(1 / (1 + float(np.exp(-np.clip(w[at] @ values + bias, -35, 35)))))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def op5_quality_model(spark, sf_dir: str) -> DataFrame:
    from setforge.llm.common import table

    docs, p = table(spark, sf_dir, "documents"), FtrlParams()
    found = score(docs, train(docs, table(spark, sf_dir, "labels"), p), p)
    return found.select("doc_id", (crc_bucket("doc_id", p.folds) == p.held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
