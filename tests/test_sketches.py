"""Accuracy against exact values, algebra of sketches, edge cases."""

import math
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from setforge.functions import hashing as H
from setforge.operators import minwise, oneperm, ordered, setsketch, similarity, weighted
from setforge.sources import sets
from setforge.streaming.windows import window_registers

# exact J of 0..1000 and 900..2000 is 0.05; of the weights below 0.118652 (and 0.2 where all are equal)
RANGES = [("a", 0, 1000), ("b", 900, 2000)]


def ranges(spark, spans=RANGES):
    out = None
    for k, (_, low, high) in enumerate(spans):
        part = spark.range(low, high).select(F.lit(k).cast("long").alias("set_id"), F.col("id").alias("item"))
        out = part if out is None else out.unionByName(part)
    return out


def pair(spark):
    return spark.createDataFrame([(0, 1)], "a long, b long")


def weights(spark, fa, fb):
    rows = [(0, i, float(fa(i))) for i in range(70)] + [(1, i, float(fb(i))) for i in range(50, 100)]
    return spark.createDataFrame(rows, "s long, i long, w double")


def jaccard(spark, long, m, value="value"):
    return similarity.signature_jaccard(long, pair(spark), m, value).first()["jaccard"]


def near(estimate, exact, m, k=4.0):
    assert abs(estimate - exact) <= k * math.sqrt(exact * (1 - exact) / m), (estimate, exact)


def test_plain_sketches_estimate_jaccard(spark):
    rows, m = ranges(spark).cache(), 256
    near(jaccard(spark, minwise.superminhash(rows, m, "xxhash64"), m), 0.05, m)
    near(jaccard(spark, minwise.superminhash2(rows, m, "xxhash64"), m), 0.05, m)
    raw = oneperm.bins(rows, m, "xxhash64")
    for scheme in ("optimal", "reverse"):
        dense = oneperm.densify(raw, m, scheme)
        near(jaccard(spark, dense.select("set_id", F.posexplode("sig").alias("slot", "value")), m), 0.05, m)


@pytest.mark.parametrize(("fa", "fb", "exact"), [(lambda i: 20, lambda i: 10, 0.2), (lambda i: 2 * i, lambda i: i**4, 0.118652), (lambda i: 2 * i, lambda i: 2 * i, 0.240404)])
def test_weighted_sketches_estimate_jp(spark, fa, fb, exact):
    rows, m = sets.weighted(weights(spark, fa, fb), "s", "i", F.col("w")).cache(), 400
    assert similarity.exact_probability_jaccard(rows, pair(spark)).first()["jp"] == pytest.approx(exact, abs=1e-5)
    near(jaccard(spark, weighted.sample(rows, m), m, "item"), exact, m)
    near(jaccard(spark, weighted.sample_points(rows, m, family="xxhash64"), m, "item"), exact, m)
    near(jaccard(spark, weighted.sample(rows, m, "sha256"), m, "item"), exact, m)


def test_jp_by_definition(spark):
    rng = np.random.default_rng(5)
    a, b = ({int(i): float(w) for i, w in zip(rng.choice(40, 25, False), rng.integers(1, 9, 25), strict=True)} for _ in "ab")
    rows = spark.createDataFrame([(k, i, w) for k, x in enumerate((a, b)) for i, w in x.items()], "set_id long, item long, weight double")
    want = sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())
    assert similarity.exact_probability_jaccard(rows, pair(spark)).first()["jp"] == pytest.approx(want, abs=1e-8)


def test_weight_scale_and_merge(spark):
    rows = sets.weighted(weights(spark, lambda i: i + 1, lambda i: i), "s", "i", F.col("w")).cache()
    get = lambda df: {(r.set_id, r.slot): r.item for r in df.collect()}
    assert get(weighted.sample(rows, 32)) == get(weighted.sample(rows.withColumn("weight", F.col("weight") * 8), 32))
    low, high = rows.where("item < 60"), rows.where("item >= 40")
    assert get(weighted.merge(weighted.sample(low, 32), weighted.sample(high, 32))) == get(weighted.sample(rows, 32))
    assert get(weighted.sample(rows.repartition(7, "item"), 32)) == get(weighted.sample(rows, 32))


def test_weights_policy(spark):
    rows = spark.createDataFrame([(1, "a", 0.0), (1, "b", 2.0), (None, "c", 1.0), (2, None, 1.0), (3, "d", None)], "s long, i string, w double")
    assert [tuple(r) for r in sets.weighted(rows, "s", "i", F.col("w")).collect()] == [(1, "b", 2.0)]
    for bad in (-1.0, float("nan"), float("inf")):
        with pytest.raises(Exception, match="finite"):
            sets.weighted(spark.createDataFrame([(1, "a", bad)], "s long, i string, w double"), "s", "i", F.col("w")).collect()


def test_setsketch(spark):
    p = setsketch.SketchParams(m=512)
    rows = ranges(spark).cache()
    regs = setsketch.registers(rows, p, family="xxhash64").cache()
    rel = setsketch.relative_std(p)
    for r in setsketch.cardinality(regs, p, "set_id").collect():
        assert abs(r.n_est / (1000, 1100)[r.set_id] - 1) < 4 * rel
    union = setsketch.merge(regs.withColumn("one", F.lit(1)), "one")
    direct = setsketch.registers(rows.withColumn("one", F.lit(1)).select("one", "item").distinct(), p, "one", family="xxhash64")
    assert sorted(map(tuple, union.collect())) == sorted(map(tuple, direct.collect()))
    assert abs(setsketch.cardinality(union, p, "one").first()["n_est"] / 2000 - 1) < 4 * rel
    near(jaccard(spark, regs, p.m, "reg"), 0.05, p.m)
    counts = setsketch.compare(regs, pair(spark), p)
    first, closed = setsketch.likelihood(counts, p).first()["jaccard"], setsketch.likelihood_b1(counts).first()["jaccard"]
    near(first, 0.05, p.m)
    assert abs(first - closed) < 2e-3
    diag = {r.set_id: (r.low, r.n_capped) for r in setsketch.diagnostics(regs, p, "set_id").collect()}
    assert diag[0][0] > 0 and diag[0][1] == 0


def test_setsketch_repeats_bounds_params(spark, tmp_path):
    p = setsketch.SketchParams(m=256)
    many = spark.range(5000).select(F.lit(0).cast("long").alias("set_id"), (F.col("id") % 200).alias("item"))
    assert abs(setsketch.cardinality(setsketch.registers(many, p), p, "set_id").first()["n_est"] / 200 - 1) < 4 * setsketch.relative_std(p)
    jac = spark.range(1, 51).select((F.col("id") / 50).alias("j"))
    low, high = setsketch.jaccard_bounds(F.col("j"), p)
    for r in jac.select("j", low.alias("low"), high.alias("high")).collect():
        assert 0 <= r.low <= r.high + 1e-9 and r.low <= r.j + 1e-9
    assert setsketch.SketchParams.from_json(p.to_json()) == p
    setsketch.write_params(spark, p, f"file://{tmp_path}/p")
    assert setsketch.read_params(spark, f"file://{tmp_path}/p") == p
    one = spark.createDataFrame([([1, 5], [3, 2])], "a array<int>, b array<int>")
    assert one.select(setsketch.merge_wide(F.col("a"), F.col("b"), p, p)).first()[0] == [3, 5]
    with pytest.raises(ValueError, match="different parameters"):
        setsketch.merge_wide(F.col("a"), F.col("b"), p, setsketch.SketchParams(m=8))


def sequence(spark, *lists):
    return spark.createDataFrame([(k, i, x) for k, s in enumerate(lists) for i, x in enumerate(s)], "set_id long, pos long, item long")


def test_ordered(spark):
    same = ordered.ordered_signature(sequence(spark, [0, 0, 1, 2, 2, 3, 4], [0, 0, 1, 2, 2, 3, 4]), 5, 2)
    assert jaccard(spark, same, 5) == 1.0
    a, b = [0, 1, 2, 3, 4, 0, 1, 2, 3, 2, 4, 5, 0, 1, 2, 3, 4, 0, 1, 2, 6, 2, 4, 5], [0, 1, 2, 6, 4, 0, 7, 1, 2, 3, 2, 4, 5]
    m = 1024  # about 2.57 of 32 slots are equal for l = 3, 0.243 for l = 5
    for n, mean in ((3, 2.57 / 32), (5, 0.243 / 32)):
        near(jaccard(spark, ordered.ordered_signature(sequence(spark, a, b), m, n, family="xxhash64"), m), mean, m)
    assert ordered.ordered_signature(sequence(spark, [1, 2]), 4, 3).count() == 0
    first, second = (ordered.ordered_signature(sequence(spark, a), 8, 3, seed=s).collect() for s in (1, 2))
    assert first != second


def test_small_sets(spark):
    one = spark.createDataFrame([(0, 7), (0, 7), (1, 7)], "set_id long, item long")
    for m in (1, 2, 16):
        assert jaccard(spark, minwise.superminhash(one, m), m) == 1.0
        dense = oneperm.densify(oneperm.bins(one, m), m, "reverse")
        assert dense.select(F.size("sig")).distinct().collect()[0][0] == m
    empty = one.limit(0)
    assert minwise.superminhash(empty, 4).count() == oneperm.densify(oneperm.bins(empty, 4), 4).count() == 0
    with pytest.raises(ValueError, match="m >= 2"):
        weighted.item_points(one, 1, 4)


def test_bins_merge(spark):
    rows = ranges(spark).cache()
    get = lambda df: sorted(map(tuple, df.select("set_id", "slot", "r", "value").collect()))
    assert get(oneperm.merge_bins(oneperm.bins(rows.where("item < 950"), 64), oneperm.bins(rows.where("item >= 930"), 64))) == get(oneperm.bins(rows, 64))


def test_equal_share(spark):
    rows = spark.createDataFrame([([1, 2, 3], [1, 5, 3]), ([], [])], "a array<int>, b array<int>")
    assert [r[0] for r in rows.select(similarity.equal_share(F.col("a"), F.col("b"))).collect()] == [2 / 3, None]


def test_samplers(spark):
    x = spark.range(200_000).select(H.truncated_exponential(H.uniform(H.key_text(F.col("id"), "t"), "xxhash64"), 0.5).alias("x"))
    mean, dev = x.agg(F.avg("x"), F.stddev("x")).first()
    assert abs(mean - 0.458505917) < 4 * dev / math.sqrt(200_000)
    orders = spark.range(24_000).select(F.concat_ws("", minwise.permutation(F.col("id"), 4, "xxhash64")).alias("p")).groupBy("p").count().collect()
    assert len(orders) == 24 and all(abs(r["count"] - 1000) < 5 * math.sqrt(1000) for r in orders)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=50))
def test_wang64_inverse(keys):
    k = np.array(keys, np.int64)
    assert (H.wang64_inverse_array(H.wang64_array(k)) == k).all()


def test_wang32_inverse(spark):
    rows = spark.range(0, 2**32, 429_497).withColumn("h", H.wang32("id"))
    assert rows.where(F.col("id") != H.wang32_inverse("h")).count() == 0
    assert rows.where((F.col("h") < 0) | (F.col("h") >= 2**32)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    p = setsketch.SketchParams(m=8)
    events.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = window_registers(spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in"), p, "ts", "user_id", "event_type", late="60 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("regs").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("regs").collect()))
    assert got and got == sorted(map(tuple, window_registers(events, p, "ts", "user_id", "event_type").collect()))
    assert os.path.exists(f"{tmp_path}/cp")


def test_store(spark, tmp_path):
    from setforge.sources import store

    rows, path = ranges(spark), f"file://{tmp_path}/sketches"
    wide = weighted.wide(minwise.superminhash2(rows, 16, "xxhash64"), "value")
    other = weighted.wide(minwise.superminhash(rows, 16, "xxhash64"), "value").select("set_id", F.transform("sig", lambda x: x.cast("bigint")).alias("sig"))
    store.write(store.described(wide, "smh2", 16, "xxhash64"), path)
    store.write(store.described(other, "smh", 16, "xxhash64", params={"b": 1}), path)
    a, b = store.read(spark, path, "smh2"), store.read(spark, path, "smh")
    assert a.count() == 2 and store.read(spark, path).count() == 4
    want = jaccard(spark, minwise.superminhash2(rows, 16, "xxhash64"), 16)
    assert store.compared(a, a, pair(spark)).first()["jaccard"] == want
    with pytest.raises(Exception, match="different ways"):
        store.compared(a, b, pair(spark)).collect()


def test_points_reach_every_slot(spark):
    items = spark.range(300).select(F.col("id").alias("set_id"), F.concat(F.lit("i"), "id").alias("item"), F.lit(1.0).alias("weight"))
    short = weighted.sample_points(items, 16, 20, "xxhash64")
    assert short.count() == 300 * 16 and short.select("set_id", "slot").distinct().count() == 300 * 16
    assert short.exceptAll(weighted.sample_points(items, 16, 600, "xxhash64")).count() == 0
