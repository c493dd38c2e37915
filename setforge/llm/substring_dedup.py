"""Substring dedup by seed and extend.

Seeds: winnowed anchors. Of each window of ``length`` words the rightmost least hash of an ``anchor_words``-gram is its
anchor, so equal windows have equal anchors at equal places, and an anchor occurrence governs a run of consecutive
windows. Seeds meet by a join on the anchor. Extension goes both ways from an anchor to the ends of its run. Two
occurrences with equal runs repeat as a whole: only the first of each distinct run goes on. Where an anchor has several
distinct runs, these (not their copies) are extended window by window, by 128-bit hashes of the windows. What is covered
by windows that start earlier elsewhere merges to maximal repeats, and those are removed.

No pair of documents is ever formed: a seed that thousands of documents share costs a row for each occurrence and, after
the first aggregation, one for each distinct context.

Defined results: null text has no words; texts under ``length`` words lose nothing; of repeated (doc_id, text) rows each
is a document of its own, in the order of hash and text, after that of smaller doc_ids; an empty table gives an empty
result; other columns of the input are ignored; null doc_ids come first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setforge.llm.common import cut, discard

_B1 = 0x9E3779B97F4A7C15 | 1
_B2 = 0xC2B2AE3D27D4EB4F | 1


@dataclass(frozen=True)
class RepeatParams:
    length: int = 20
    anchor_words: int = 6

    def __post_init__(self):
        if not 1 <= self.anchor_words <= self.length:
            raise ValueError("1 <= anchor_words <= length")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # bytes.split() cuts at \x20 and \x09-\x0D only


def word_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word."""
    from xxhash import xxh3_128_digest as digest

    both = np.frombuffer(b"".join(map(digest, words)), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def run_hash(h: np.ndarray, n: int, base: int) -> np.ndarray:
    """Polynomial hashes of every run of n consecutive hashes, modulo 2**64, then mixed."""
    m = len(h) - n + 1
    acc = np.zeros(m, np.uint64)
    for k in range(n):
        acc = acc * np.uint64(base) + h[k : k + m]
    return mixed(acc)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def governing(anchors: np.ndarray, span: int) -> np.ndarray:
    """For each window of ``span`` consecutive anchor hashes, the place of its rightmost least one."""
    m = len(anchors) - span + 1
    low, at = anchors[:m].copy(), np.arange(m)
    for k in range(1, span):
        nxt = anchors[k : k + m]
        less = nxt <= low
        low = np.where(less, nxt, low)
        at = np.where(less, np.arange(k, k + m), at)
    return at


def seeds(words: list[bytes], p: RepeatParams):
    """Of each run of windows with one anchor occurrence: anchor hash, run hash, first window, number of windows."""
    n_win = len(words) - p.length + 1
    if n_win < 1:
        return None
    h1, h2 = word_hashes(words)
    anchors = run_hash(h1, p.anchor_words, _B1)
    at = governing(anchors, p.length - p.anchor_words + 1)
    first = np.concatenate(([0], np.flatnonzero(np.diff(at)) + 1))
    count = np.diff(np.concatenate((first, [n_win])))
    w1, w2 = run_hash(h1, p.length, _B1), run_hash(h2, p.length, _B2)
    # a run's hash: its first and last windows (which hold all its words), and its length; with the anchor 128 bits
    last = first + count - 1
    run = mixed(mixed(w1[first] + np.uint64(_B2) * w2[last]) ^ mixed(w2[first] + np.uint64(_B1) * w1[last]) + count.astype(np.uint64))
    return anchors[at[first]], run, first, count


def _seed_rows(docs: DataFrame, p: RepeatParams) -> DataFrame:
    """anchor, run, row, place (first window << 16 | number of windows) of every anchor occurrence."""

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                cols = [[], [], [], []]
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    got = seeds(words_of(t.as_py()), p)
                    if got:
                        anchor, runs, first, count = got
                        for c, x in zip(cols, (anchor.view(np.int64), runs.view(np.int64), np.full(len(first), i, np.int64), first << 16 | count), strict=True):
                            c.append(x)
                if cols[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in cols], ["anchor", "run", "row", "place"])

    return docs.select("row", "text").mapInArrow(run, "anchor long, run long, row long, place long")


def _window_rows(docs: DataFrame, p: RepeatParams) -> DataFrame:
    """Of rows (row, text, runs): the windows of the runs, one row each."""

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                batch = whole.slice(start, 128)
                out = [[], [], [], []]
                for i, t, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                    h1, h2 = word_hashes(words_of(t.as_py()))
                    w1, w2 = run_hash(h1, p.length, _B1), run_hash(h2, p.length, _B2)
                    at = np.concatenate([np.arange(a, a + n) for a, n in zip(runs.values.field(0).to_pylist(), runs.values.field(1).to_pylist(), strict=True)])
                    out[0].append(w1[at].view(np.int64))
                    out[1].append(w2[at].view(np.int64))
                    out[2].append(np.full(len(at), i, np.int64))
                    out[3].append(at)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["w1", "w2", "row", "first"])

    return docs.select("row", "text", "runs").mapInArrow(run, "w1 long, w2 long, row long, first long")


def repeats(docs: DataFrame, p: RepeatParams) -> DataFrame:
    """(row, spans: array of (first, count)): windows that start earlier elsewhere, in rows (row long, text)."""
    span = lambda place: [F.shiftright(place, 16).alias("first"), F.col(place).bitwiseAND(F.lit(0xFFFF)).alias("count")]
    found = cut(_seed_rows(docs, p), "seeds")
    runs = found.groupBy("anchor", "run").agg(F.min(F.struct("row", "place")).alias("head"), F.count(F.lit(1)).alias("n"))
    runs = cut(runs.select("anchor", "run", "head.row", "head.place", "n"), "runs")
    # copies of a run: all its windows start earlier in the first copy
    copied = runs.where("n > 1").select("anchor", "run", F.col("row").alias("row0"), F.col("place").alias("place0"))
    again = cut(found.join(copied, ["anchor", "run"]).where("row <> row0 or place <> place0").select("row", *span("place")), "again")
    discard(found)
    # an anchor with several distinct runs: extend each of them window by window
    shared = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor")
    heads = cut(runs.join(shared, "anchor", "left_semi").select("row", F.struct(*span("place")).alias("r")).groupBy("row").agg(F.collect_list("r").alias("runs")), "heads")
    discard(runs)
    windows = cut(_window_rows(docs.join(heads, "row"), p), "windows")
    firsts = windows.groupBy("w1", "w2").agg(F.min(F.struct("row", "first")).alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1").select("w1", "w2", F.col("m.row").alias("row0"), F.col("m.first").alias("first0"))
    late = windows.join(firsts, ["w1", "w2"]).where("row <> row0 or first <> first0").select("row", "first", F.lit(1).cast("long").alias("count"))
    return cut(again.unionByName(late).groupBy("row").agg(F.collect_list(F.struct("first", "count")).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, p: RepeatParams = RepeatParams()) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words, joined by one space) of every row of docs (doc_id, text).

    A first copy of a window is the one in the smallest doc_id, and in the earliest place of it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    repeated = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1 or doc_id is null")
    if not repeated.isEmpty():  # rows get numbers of their own, in the order of doc_id and text
        rows = cut(_numbered(rows), "rows")
    else:
        rows = rows.withColumn("row", F.col("doc_id"))
    spans = repeats(rows.select("row", "text"), p)

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                sizes, lost, kept = [], [], []
                for t, s in zip(batch.column(1), batch.column(2), strict=True):
                    words = words_of(t.as_py())
                    sizes.append(len(words))
                    if s.is_valid and len(s):
                        edge = np.zeros(len(words) + 1, np.int64)
                        first = s.values.field(0).to_numpy(zero_copy_only=False)
                        np.add.at(edge, first, 1)
                        np.add.at(edge, first + s.values.field(1).to_numpy(zero_copy_only=False) + p.length - 1, -1)
                        keep = np.cumsum(edge[:-1]) == 0
                        lost.append(int(len(words) - keep.sum()))
                        words = [words[k] for k in np.flatnonzero(keep).tolist()]
                    else:
                        lost.append(0)
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "text"])

    both = rows.join(spans, "row", "left").select("doc_id", "text", "spans")
    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, text binary")


def _numbered(rows: DataFrame) -> DataFrame:
    """Consecutive numbers in the order of doc_id, hash and text, by a count for each range partition."""
    ordered = cut(rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text").withColumn("part", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    sizes = ordered.groupBy("part").count().orderBy("part").collect()  # a row for each partition
    base, at = [], 0
    for r in sizes:
        base.append((r["part"], at))
        at += r["count"]
    if not base:
        return ordered.select("doc_id", "text", F.col("nth").alias("row"))
    base = rows.sparkSession.createDataFrame(base, "part int, base long")
    return ordered.join(F.broadcast(base), "part").select("doc_id", "text", (F.col("base") + F.col("nth")).alias("row"))


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    from setforge.llm.common import table

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: The same in DuckDB.
OP6_SQL = r"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(words[i : i + 19], ' ')) AS h FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS n FROM s) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + d AS i FROM late, (SELECT unnest(range(20)) AS d)),
pos AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS t, count(*) AS n FROM pos p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""
