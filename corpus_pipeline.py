"""From documents to token ids: language, near copies, benchmark leaks, mixing, token file.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet in the shared folder and
reads it again as the next one's docs. The mixing stage keeps every document and decides their order: its partitions are
written in the order of the mix, and the last stage encodes documents in the order in which they are stored.

Defined results: rows without a doc_id are not compared with others and stay; null and letterless texts go in the first
stage; empty tables give empty results; further columns of documents travel on unchanged.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge.llm import decontamination, langid, mixing, simhash, token_file
from setforge.llm.common import cut, discard, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known."""
    return langid.accepted(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies (5-word shingles, similarity 0.8)."""
    return simhash.keep_one(docs, simhash.NEAR_COPIES)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return mixing.in_order(docs)


def stored_order(docs: DataFrame) -> DataFrame:
    """doc_id and text in the order of the files of docs and of the rows in them; of doc_id if docs isn't read from files."""
    rows = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    try:
        part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
        ordered = docs.select(*rows, F.struct(F.when(part != "", part.cast("long")).alias("part"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"))
    except AnalysisException:
        return token_file.by_doc_id(docs)
    return ordered.repartitionByRange("at").sortWithinPartitions("at").select("doc_id", "text")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the token file."""
    return token_file.token_file(stored_order(docs))


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", mix),
    ("token-ID output", token_ids),
]

#: SQL can't express fingerprints of this width, the schedule or the encoding; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    discard(before)
    return out
