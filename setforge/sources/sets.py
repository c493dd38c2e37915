"""Sets, weighted sets and sequences from tables.

Shapes: item sets (set_id, item); weighted sets (set_id, item, weight), one row for each set and item, weight > 0;
sequences (set_id, pos, item). NULL items, sets and weights are dropped, zero weights too; a negative, infinite or NaN
weight is an error. An empty set has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setforge.operators.fold import together

SPACE = r"\s+"
#: Ids on several rows that are broadcast at most.
REPEATED = 100_000


def tokens(text: Column) -> Column:
    """Lower-case tokens between white space."""
    return F.filter(F.split(F.lower(text), SPACE), lambda t: t != "")


def token_sets(docs: DataFrame) -> DataFrame:
    """Item sets of the distinct tokens of each document, made row by row."""
    return docs.select(F.col("doc_id").alias("set_id"), F.explode(F.array_distinct(tokens(F.col("text")))).alias("item"))


def token_weights(docs: DataFrame) -> DataFrame:
    """Weighted sets of term frequencies, the rows of a set side by side.

    A document is counted inside its row: sorted tokens change where a new one begins. Only documents whose id is on
    several rows are counted together, by shuffle; a bounded list of these ids is broadcast, beyond it all are shuffled.
    """
    ids = docs.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"))
    n = ids.limit(REPEATED + 1).count()
    alike = F.col("doc_id").eqNullSafe(F.col("again"))
    if n == 0:
        return _row_weights(docs)
    if n > REPEATED:
        return _shuffled_weights(docs)
    once, more = (docs.join(F.broadcast(ids), alike, how) for how in ("left_anti", "left_semi"))
    return _row_weights(once).unionByName(_shuffled_weights(more))


def _row_weights(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").alias("set_id"), F.sort_array(tokens(F.col("text"))).alias("t"))
    begins = F.filter(F.sequence(F.lit(0), F.size("t") - 1), lambda k: (k == 0) | (F.get("t", k) != F.get("t", k - 1)))
    rows = rows.where(F.size("t") > 0).select("set_id", "t", begins.alias("k"))
    terms = F.transform("k", lambda k, n: F.struct(F.get("t", k).alias("item"), (F.coalesce(F.get("k", n + 1), F.size("t")) - k).cast("double").alias("weight")))
    return rows.select("set_id", F.inline(terms))


def _shuffled_weights(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").alias("set_id"), F.explode(tokens(F.col("text"))).alias("item"))
    return together(rows.groupBy("set_id", "item").agg(F.count(F.lit(1)).cast("double").alias("weight")), "set_id")


def token_sequences(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").alias("set_id"), F.posexplode(tokens(F.col("text"))).alias("pos", "item"))


def weighted(rows: DataFrame, set_id: str, item: str, weight: Column) -> DataFrame:
    """Weighted sets: weights summed over each set and item. ``weight`` may be any expression."""
    w = weight.cast("double")
    bad = w.isNotNull() & ((w < 0) | F.isnan(w) | (w == float("inf")))
    rows = rows.select(F.col(set_id).alias("set_id"), F.col(item).alias("item"), F.when(bad, F.raise_error(F.lit("weights are finite and not negative")).cast("double")).otherwise(w).alias("weight"))
    rows = rows.where("set_id is not null and item is not null and weight is not null")
    return rows.groupBy("set_id", "item").agg(F.sum("weight").alias("weight")).where("weight > 0")


def from_map(rows: DataFrame, set_id: str, weights: str) -> DataFrame:
    """Weighted sets from a map column item -> weight."""
    return weighted(rows.select(F.col(set_id).alias("s"), F.explode(weights).alias("i", "w")), "s", "i", F.col("w"))


def supplier_parts(lineitem: DataFrame) -> DataFrame:
    """Quantities by supplier and part."""
    return weighted(lineitem, "l_suppkey", "l_partkey", F.col("l_quantity"))
