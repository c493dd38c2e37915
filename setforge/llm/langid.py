"""Language identification by rank-order profiles of character n-grams.

A text's letters become codes (A-Z in lower case, other letters by their lower-case code point modulo 37); everything
else is a word boundary, and runs of it are one. A profile is the list of the most frequent 1-, 2- and 3-grams, by rank.
A document goes to the language whose profile has the least out-of-place distance: for each of the document's ranked
n-grams, how far its rank is from the rank in the profile, or ``top`` if it is not there.

Profiles are learned from text and lang alone. ``learn`` takes a bounded sample: about ``per_lang`` documents of each language,
chosen by a hash of doc_id; ``accepted`` takes every row that is not held out. Counts are summed on the executors;
languages x ``top`` ranks come to the driver.

``accepted`` rejects texts that are unlike every learned language: those with a score under ``margin`` times the score that
all but a thousandth of the learning rows of the same size class reach (the class is the bit length of the number of
distinct n-grams), by an exact count over all of them. Classes of under ``few`` learning rows take half the least of the other classes, or ``floor`` if there is
none. A short text of a few strange letters can pass.

Defined results: null text and text without a letter give ``und`` with score 0; repeated rows are scored each; an empty
table, or one without labelled rows, gives ``und`` for all; ties go to the alphabetically first language; other columns
of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setforge.llm.common import crc_bucket, plain_columns

SIDE = 64  # codes: 0 boundary, 1-26 a-z, 27-63 other letters
SPACE = SIDE + SIDE**2 + SIDE**3
UNKNOWN = "und"


@dataclass(frozen=True)
class LangParams:
    top: int = 400
    per_lang: int = 4000
    max_langs: int = 1000
    folds: int = 4
    held_out: int = 2
    margin: float = 0.8
    few: int = 100
    floor: float = 0.05


def _letter_codes() -> np.ndarray:
    lut = np.zeros(0x10000, np.uint8)
    for k in range(0x10000):
        c = chr(k)
        if c.isalpha():
            low = c.lower()[0]
            lut[k] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % 37
    return lut


_LUT: list[np.ndarray] = []


def codes(text: str) -> np.ndarray:
    """Letter codes with single zeros between words and at both ends; empty if there is no letter."""
    if not _LUT:
        _LUT.append(_letter_codes())
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(points) and points.max() >= 0x10000:
        far = points >= 0x10000
        out = _LUT[0][np.where(far, 0, points)]
        out[far] = [27 + c % 37 if chr(c).isalpha() else 0 for c in points[far].tolist()]
    else:
        out = _LUT[0][points]
    out = np.concatenate((np.zeros(1, np.uint8), out, np.zeros(1, np.uint8)))
    keep = out != 0
    keep[:-1] |= keep[1:]  # of a run of zeros only the last before a letter
    keep[-1] = True
    out = out[keep]
    return out.astype(np.int32) if len(out) > 1 else np.empty(0, np.int32)


def grams(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a text and their counts; 2- and 3-grams may begin or end with a boundary."""
    two = c[:-1] * SIDE + c[1:]
    three = two[:-1] * SIDE + c[2:]
    three = three[c[1:-1] != 0]
    every = np.concatenate((c[c != 0], two + SIDE, three + SIDE + SIDE**2))
    if len(every) > 200_000:
        counts = np.bincount(every, minlength=SPACE)
        found = np.flatnonzero(counts)
        return found, counts[found]
    return np.unique(every, return_counts=True)


def ranked(found: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes, most frequent first, equal counts by code."""
    if len(found) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        at = counts >= least
        found, counts = found[at], counts[at]
    return found[np.lexsort((found, -counts))][:top]


class Profiles:
    def __init__(self, langs: list[str], ranks: np.ndarray, top: int):
        self.langs, self.ranks, self.top = langs, ranks, top  # ranks: languages x SPACE, top where a code is not ranked

    @staticmethod
    def of(lists: dict[str, list[int]], top: int) -> Profiles:
        langs = sorted(lists)
        ranks = np.full((len(langs), SPACE), top, np.int16)
        for k, lang in enumerate(langs):
            ranks[k, lists[lang]] = np.arange(len(lists[lang]))
        return Profiles(langs, ranks, top)

    def judge(self, text: str | None) -> tuple[str, float, int]:
        """Language, score and size class of a text."""
        c = codes(text or "")
        if not len(c) or not self.langs:
            return UNKNOWN, 0.0, 0
        found, counts = grams(c)
        mine = ranked(found, counts, self.top)
        distance = np.abs(self.ranks[:, mine] - np.arange(len(mine), dtype=np.int16)).sum(axis=1, dtype=np.int64)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (self.top * len(mine))), len(found).bit_length()

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]


def _counts(rows: DataFrame, p: LangParams) -> list:
    """lang, count of the languages of labelled rows."""
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(p.max_langs + 1).collect()
    if len(counts) > p.max_langs:
        raise ValueError(f"more than {p.max_langs} languages")
    return counts


def sample(labelled: DataFrame, p: LangParams = LangParams()) -> DataFrame:
    """lang, text of about ``per_lang`` rows of each language."""
    rows = labelled.where("lang is not null and text is not null")
    sizes = _counts(rows, p)
    if not sizes:
        return rows.limit(0).select("lang", "text")
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, p.per_lang / r["count"]))])
    return rows.where((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)) < share[F.col("lang")]).select("lang", "text")


def train(rows: DataFrame, p: LangParams = LangParams()) -> dict[str, list[int]]:
    """Ranked n-gram codes of every language of rows (lang, text)."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                c = codes(text.as_py())
                if len(c):
                    sums = total.setdefault(lang, np.zeros(SPACE, np.int64))
                    found, counts = grams(c)
                    sums[found] += counts
        for lang, sums in total.items():
            found = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(sums[found])], ["lang", "code", "n"])

    sums = rows.select("lang", "text").mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    ranks = sums.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "code"))), 1, p.top).alias("r"))
    return {r["lang"]: [x["code"] for x in r["r"]] for r in ranks.collect()}


def predict(docs: DataFrame, lists: dict[str, list[int]], p: LangParams = LangParams()) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs (doc_id, text); lists is small: languages x top."""

    def run(batches):
        model = Profiles.of(lists, p.top)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [model.predict(t.as_py()) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def _not_held_out(docs: DataFrame, p: LangParams) -> DataFrame:
    return plain_columns(docs, "doc_id", "text", "lang").where(crc_bucket("doc_id", p.folds) != p.held_out)


def learning_rows(docs: DataFrame, p: LangParams = LangParams()) -> DataFrame:
    """lang, text of all labelled rows of docs that are not held out."""
    rows = _not_held_out(docs, p).where("lang is not null and text is not null").select("lang", "text")
    _counts(rows, p)
    return rows


def learn(docs: DataFrame, p: LangParams = LangParams()) -> dict[str, list[int]]:
    """Profiles from a sample of the rows of docs that are not held out."""
    return train(sample(_not_held_out(docs, p), p), p)


def least_scores(rows: DataFrame, lists: dict[str, list[int]], p: LangParams = LangParams()) -> dict[int, float]:
    """The least score to accept by size class, from rows (lang, text); a few classes come to the driver."""

    def run(batches):
        model = Profiles.of(lists, p.top)
        for batch in batches:
            found = [model.judge(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x[2] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.float64())], ["size", "score"])

    scores = rows.select("text").mapInArrow(run, "size int, score double").where("size > 0")
    # a score is a whole distance over a length: their number in a class doesn't grow with the rows
    same = scores.groupBy("size", "score").agg(F.count(F.lit(1)).alias("rows"))
    upto = same.withColumn("upto", F.sum("rows").over(Window.partitionBy("size").orderBy("score"))).withColumn("n", F.sum("rows").over(Window.partitionBy("size")))
    classes = upto.where("1000 * upto >= n").groupBy("size").agg(F.first("n").alias("n"), F.min("score").alias("low"))
    known = {r["size"]: max(p.floor, p.margin * r["low"]) for r in classes.where(F.col("n") >= p.few).collect()}
    other = max(p.floor, min(known.values()) / 2) if known else p.floor
    return {size: known.get(size, other) for size in range(SPACE.bit_length() + 1)}


def accepted(docs: DataFrame, p: LangParams = LangParams(), langs: tuple[str, ...] = ()) -> DataFrame:
    """The rows of docs whose language is known: a letter at least, a score as learned texts have and, if given, one of langs."""
    rows = learning_rows(docs, p)
    lists = train(rows, p)
    least = least_scores(rows, lists, p)
    names = docs.columns

    def run(batches):
        model = Profiles.of(lists, p.top)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [model.judge(t.as_py()) for t in batch.column(names.index("text"))]
                keep = [lang != UNKNOWN and score >= least[size] and (not langs or lang in langs) for lang, score, size in found]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    from setforge.llm.common import table

    docs, p = table(spark, sf_dir, "documents"), LangParams()
    found = predict(docs, learn(docs, p), p)
    return found.select("doc_id", (crc_bucket("doc_id", p.folds) == p.held_out).alias("held_out"), "lang_pred", "score")
