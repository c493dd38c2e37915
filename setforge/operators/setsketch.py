"""SetSketch: registers on a logarithmic scale; cardinality, merge, Jaccard similarity with bounds and likelihood."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from setforge.functions.hashing import TWO52, draw_array, exponential
from setforge.operators.fold import folded, least


@dataclass(frozen=True)
class SketchParams:
    """Base b > 1, m registers, rate a, cap q (registers are 0 .. q+1)."""

    b: float = 1.001
    m: int = 4096
    a: float = 20.0
    q: int = 65534

    def __post_init__(self):
        if not (self.b > 1 and self.m >= 1 and self.a > 0 and self.q >= 1):
            raise ValueError("b > 1, m >= 1, a > 0, q >= 1")

    @property
    def ln_b(self) -> float:
        return math.log1p(self.b - 1)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> SketchParams:
        return SketchParams(**json.loads(text))


def write_params(spark, p: SketchParams, path: str) -> None:
    """The parameters as a JSON table, on any file system that Spark writes."""
    spark.createDataFrame([(p.b, p.m, p.a, p.q)], "b double, m bigint, a double, q bigint").coalesce(1).write.mode("overwrite").json(path)


def read_params(spark, path: str) -> SketchParams:
    return SketchParams(**spark.read.schema("b double, m bigint, a double, q bigint").json(path).first().asDict())


def registers(sets: DataFrame, p: SketchParams, *keys: str, family: str = "md5") -> DataFrame:
    """(keys, slot, reg) for sets given as rows with the keys (set_id if none) and item."""
    keys = keys or ("set_id",)
    labels = [(k, "k") for k in range(p.m)]
    parts = folded(sets, keys, F.col("item"), lambda items: -draw_array(items, labels, family), p.m, least, "slot int, x long", family)
    u = ((-F.min("x")).cast("double") + 1.0) / TWO52  # the largest uniform gives the least x
    return parts.groupBy(*keys, "slot").agg((exponential(u) / p.a).alias("x")).select(*keys, "slot", register(F.col("x"), p).alias("reg"))


def register(x: Column, p: SketchParams) -> Column:
    """floor(1 - log_b x) within 0 .. q+1."""
    return F.greatest(F.lit(0), F.least(F.lit(p.q + 1), F.floor(1.0 - F.ln(x) / p.ln_b))).cast("int")


def merge(sketches: DataFrame, *keys: str) -> DataFrame:
    """Union of the sets of each key: the largest registers. All must have been made with the same parameters."""
    return sketches.groupBy(*keys, "slot").agg(F.max("reg").alias("reg"))


def merge_wide(a: Column, b: Column, pa: SketchParams, pb: SketchParams) -> Column:
    """The same for two register arrays; parameters must match."""
    if (pa.m, pa.q) != (pb.m, pb.q) or abs(pa.b - pb.b) > 1e-12 * pa.b or abs(pa.a - pb.a) > 1e-12 * pa.a:
        raise ValueError("sketches with different parameters can't be merged")
    return F.zip_with(a, b, lambda x, y: F.greatest(x, y))


def cardinality(sketches: DataFrame, p: SketchParams, *keys: str) -> DataFrame:
    """(keys, n_est, rel_std); an empty set has no row."""
    total = F.sum(F.exp(-F.col("reg") * p.ln_b))
    n = p.m * (1 - 1 / p.b) / (p.a * p.ln_b) / total
    return sketches.groupBy(*keys).agg(F.round(n, 3).alias("n_est")).withColumn("rel_std", F.lit(relative_std(p)))


def relative_std(p: SketchParams) -> float:
    return round(math.sqrt(((p.b + 1) / (p.b - 1) * p.ln_b - 1) / p.m), 9)


def jaccard_bounds(jac: Column, p: SketchParams) -> tuple[Column, Column]:
    """(lower, upper) of the similarity, from the share of equal registers."""
    x = F.exp(jac * (p.ln_b / 2))
    low = F.greatest(F.lit(0.0), 2.0 * (x * math.sqrt(p.b) - 1.0) / (p.b - 1) - 1.0)
    return low, (x * x - 1.0) / (p.b - 1)


def compare(sketches: DataFrame, pairs: DataFrame, p: SketchParams) -> DataFrame:
    """(a, b, d_plus, d_minus, d_zero, n_a, n_b) of pairs (a, b) of set ids: registers larger, smaller, equal."""
    left = sketches.select(F.col("set_id").alias("a"), "slot", F.col("reg").alias("va"))
    right = sketches.select(F.col("set_id").alias("b"), "slot", F.col("reg").alias("vb"))
    return compared(pairs.join(left, "a").join(right, ["b", "slot"]), p)


def compared(rows: DataFrame, p: SketchParams) -> DataFrame:
    """The same from the registers of the pairs side by side, (a, b, slot, va, vb)."""
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    scale = p.m * (1 - 1 / p.b) / (p.a * p.ln_b)
    out = rows.groupBy("a", "b").agg(
        count(F.col("va") > F.col("vb")).alias("d_plus"), count(F.col("va") < F.col("vb")).alias("d_minus"), count(F.col("va") == F.col("vb")).alias("d_zero"),
        F.round(scale / F.sum(F.exp(-F.col("va") * p.ln_b)), 3).alias("n_a"), F.round(scale / F.sum(F.exp(-F.col("vb") * p.ln_b)), 3).alias("n_b"),
    )
    return out


def likelihood_b1(counts: DataFrame) -> DataFrame:
    """(a, b, jaccard): maximum likelihood in closed form, for b close to 1."""
    u, v = F.col("n_a") / (F.col("n_a") + F.col("n_b")), F.col("n_b") / (F.col("n_a") + F.col("n_b"))
    rows = counts.withColumns({"u": u, "v": v, "m": F.col("d_plus") + F.col("d_minus") + F.col("d_zero")})
    s, t = F.expr("u * u * (d_minus + d_zero)"), F.expr("v * v * (d_plus + d_zero)")
    jac = (s + t - F.sqrt((s - t) * (s - t) + F.expr("4.0 * d_minus * d_plus * u * u * v * v"))) / F.expr("2.0 * u * v * m")
    return rows.select("a", "b", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), jac)), 6).alias("jaccard"))


def likelihood(counts: DataFrame, p: SketchParams, steps: int = 100) -> DataFrame:
    """(a, b, jaccard): maximum likelihood by golden section on [0, min(n_a/n_b, n_b/n_a)], pairs side by side."""

    def pb(x):
        return -np.log1p(np.clip(-x * (p.b - 1) / p.b, -1 + 1e-300, None)) / p.ln_b

    def term(n, q):  # n ln q, 0 where n is 0
        return np.where(n > 0, n * np.log(np.maximum(q, 1e-300)), 0.0)

    def cost(j, u, v, plus, minus, zero):
        up, down = pb(u - v * j), pb(v - u * j)
        return -(term(plus, up) + term(minus, down) + term(zero, 1 - up - down))

    @F.pandas_udf("double")
    def solve(plus: pd.Series, minus: pd.Series, zero: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        plus, minus, zero, na, nb = (x.to_numpy(float) for x in (plus, minus, zero, na, nb))
        u = na / (na + nb)
        low, high = np.zeros_like(u), np.minimum(na / nb, nb / na)
        gold = (math.sqrt(5) - 1) / 2
        for _ in range(steps):
            c, d = high - gold * (high - low), low + gold * (high - low)
            left = cost(c, u, 1 - u, plus, minus, zero) < cost(d, u, 1 - u, plus, minus, zero)
            low, high = np.where(left, low, c), np.where(left, d, high)
        return pd.Series(np.round((low + high) / 2, 6))

    return counts.select("a", "b", solve("d_plus", "d_minus", "d_zero", "n_a", "n_b").alias("jaccard"))


def diagnostics(sketches: DataFrame, p: SketchParams, *keys: str) -> DataFrame:
    """(keys, low, n_capped): the least register, if all are there, and how many stand at the cap."""
    return sketches.groupBy(*keys).agg(F.when(F.count(F.lit(1)) == p.m, F.min("reg")).otherwise(0).alias("low"), F.sum(F.when(F.col("reg") > p.q, 1).otherwise(0)).alias("n_capped"))
