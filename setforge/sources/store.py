"""Stored sketches: wide signatures beside what they were made with, so that only comparable ones are compared.

A stored sketch is (set_id, sig, algo, m, family, seed, params); params is JSON. Two sketches can be compared or merged
if all but set_id and sig are equal.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setforge.operators.similarity import equal_share

META = ("algo", "m", "family", "seed", "params")


def described(wide: DataFrame, algo: str, m: int, family: str, seed: int = 0, params: Mapping[str, float] | None = None) -> DataFrame:
    """(set_id, sig) with its description."""
    values = (algo, m, family, seed, json.dumps(dict(params or {}), sort_keys=True))
    kinds = ("string", "int", "string", "bigint", "string")
    return wide.select("set_id", "sig", *[F.lit(v).cast(k).alias(n) for n, v, k in zip(META, values, kinds, strict=True)])


def write(sketches: DataFrame, path: str) -> None:
    """Parquet, a folder for each algorithm."""
    sketches.write.mode("append").partitionBy("algo").parquet(path)


def read(spark: SparkSession, path: str, algo: str | None = None) -> DataFrame:
    """The stored sketches; one algorithm's folder alone if it is named."""
    rows = spark.read.parquet(path)
    rows = rows.where(F.col("algo") == algo) if algo else rows
    return rows.select("set_id", "sig", *META)


def _same(a: str, b: str) -> Column:
    same = F.lit(True)
    for n in META:
        same = same & F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}"))
    return same


def compared(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, jaccard) of pairs (a, b) of stored sketches; an error where the two were made in different ways."""
    x, y = left.withColumnRenamed("set_id", "a").alias("x"), right.withColumnRenamed("set_id", "b").alias("y")
    rows = pairs.join(x, "a").join(y, "b")
    jac = F.when(_same("x", "y"), equal_share(F.col("x.sig"), F.col("y.sig"))).otherwise(F.raise_error(F.lit("sketches made in different ways can't be compared")).cast("double"))
    return rows.select("a", "b", jac.alias("jaccard"))
