"""The fold of the map tasks against the definitions written as plain Column expressions, and how much it leaves to move."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from setforge.functions import hashing as H
from setforge.operators import fold, minwise, oneperm, setsketch, similarity, weighted
from setforge.plans import registry
from setforge.sources import sets

FAMILIES = ("md5", "sha256", "xxhash64")
M = 12


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def words(spark):
    """Weighted sets of texts: ids that are null or lie scattered, an item longer than a block of md5, an item in all sets."""
    rng = np.random.default_rng(3)
    rows = [(None if k % 9 == 0 else int(k % 9), f"{'ä' * int(n % 4)}w{n}", float(w)) for k, (n, w) in enumerate(zip(rng.integers(0, 500, 900), rng.integers(1, 9, 900), strict=True))]
    rows += [(k, item, 5.0) for k in range(1, 9) for item in ("", "all", "long" * 30)]
    made = spark.createDataFrame(rows, "set_id long, item string, weight double").dropDuplicates(["set_id", "item"])
    return made.repartition(5, F.rand(1)).cache()


@pytest.mark.parametrize("family", FAMILIES)
def test_draws_as_arrays(spark, family):
    items = [f"{'x' * (k % 60)}{k}" for k in range(400)] + ["", "é" * 40]
    df = spark.createDataFrame([(x,) for x in items] + [(None,)], "item string").coalesce(1)
    labels = [(k,) for k in range(11)] + [(7, "p"), ("b",)]
    want = df.select(fold.hashed(F.col("item"), family).alias("h"), H.item_hash(F.coalesce("item", F.lit("")), family).alias("i"), *[H.draw(F.col("item"), *x, family=family).alias(f"d{k}") for k, x in enumerate(labels)]).collect()
    hashed = [None if r.h is None else bytes(r.h) if family != "xxhash64" else r.h for r in want]
    for n in (len(want), 3):
        assert (H.draw_array(hashed[-n:], labels, family) == np.array([r[2:] for r in want[-n:]])).all()
    assert (H.item_hash_array(hashed[:-1], family) == np.array([r.i for r in want[:-1]])).all()


def by_definition(df, m, family):
    every = df.select("set_id", "item", "weight", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("slot"))
    h = -F.ln(H.uniform_draw(F.col("item"), F.col("slot"), family=family)) / F.col("weight")
    return every.groupBy("set_id", "slot").agg(F.min(F.struct(h, "item"))["item"].alias("item"))


def key(r):
    return tuple((x is None, x) for x in r)


@pytest.mark.parametrize("family", FAMILIES)
def test_sample_by_definition(words, family):
    want = sorted(by_definition(words, M, family).collect(), key=key)
    for scattered in (True, False):
        got = weighted.sample(words, M, family, scattered).select("set_id", "slot", "item")
        assert sorted(got.collect(), key=key) == want


def test_small_memo_and_steps(words, monkeypatch):
    want = sorted(map(tuple, by_definition(words, M, "md5").collect()), key=key)
    for name, n in (("ITEMS", 3), ("ROWS", 7)):
        monkeypatch.setattr(fold, name, n)
    memo = fold.Memo(lambda items: H.draw_array(items, [(k,) for k in range(M)]), M)
    assert memo.limit == 3
    best, batches = {}, words.select("set_id", fold.hashed(F.col("item"), "md5"), "weight", "item").toArrow().to_batches()
    for batch in fold.steps(batches, 7):
        assert batch.num_rows <= 7
        ids, items, w = batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(2).to_numpy()
        h = -np.log(H.uniform_array(memo(batch.column(1)))) / w[:, None]
        for k, row in enumerate(h):
            for slot, x in enumerate(row):
                best[ids[k], slot] = min(best.get((ids[k], slot), (np.inf, "")), (x, items[k]))
    assert sorted(((a, b, x[1]) for (a, b), x in best.items()), key=key) == want


def test_terms_are_sampled_without_moving_them(spark):
    """terms are counted and folded where the documents are read; slots alone are exchanged."""
    docs = spark.createDataFrame([(k, " ".join(f"W{k * n % 37}" for n in range(90))) for k in range(20)], "doc_id long, text string")
    df = weighted.sample(sets.token_weights(docs), M, scattered=False)
    assert plan(df).count("Exchange hashpartitioning") == 1
    assert rows_of(df.select("set_id", "slot", "item")) == rows_of(by_definition(sets._shuffled_weights(docs), M, "md5"))


def test_terms_of_repeated_ids(spark, monkeypatch):
    texts = [(1, "a b\tA"), (2, "b b b"), (1, "c a"), (None, "x"), (None, "x y"), (3, ""), (4, None), (5, "  z ")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = [(1, "a", 3.0), (1, "b", 1.0), (1, "c", 1.0), (2, "b", 3.0), (5, "z", 1.0), (None, "x", 2.0), (None, "y", 1.0)]
    for most in (sets.REPEATED, 1, 0):
        monkeypatch.setattr(sets, "REPEATED", most)
        assert sorted(map(tuple, sets.token_weights(docs).collect()), key=key) == sorted(want, key=key)


def slots_of(df):
    return df.select("set_id", "slot", F.col("item").alias("value"))


def test_neighbours_in_one_pass(spark, words):
    """Signatures of sets that follow each other meet without a second making; null ids and missing slots have no pair."""
    long = slots_of(weighted.sample(words.where("set_id is null or set_id not in (3, 6)"), M)).where("set_id is null or slot != set_id").cache()
    want = rows_of(similarity.signature_jaccard(long, similarity.neighbours(long), M))
    assert rows_of(similarity.neighbour_jaccard(long, M)) == want and [r[:2] for r in want] == [(1, 2), (4, 5), (7, 8)]


@pytest.mark.parametrize("name", ["pminhash_neighbours", "pmh3_neighbours", "superminhash_jaccard", "superminhash2_jaccard", "setsketch_bounds", "setsketch_mle_b1", "oph_jaccard", "oph_revjaccard"])
def test_neighbour_queries_read_once(spark, name):
    assert plan(registry.queries()[name](spark, "/root/testdata/sf0.001")).count("FileScan parquet") == 1


@pytest.mark.parametrize("family", FAMILIES)
def test_points_by_definition(spark, words, family):
    """points drawn while they matter give the slots that the table of all points gives, uneven weights included."""
    df = words.withColumn("weight", F.pow(F.col("weight"), 5)).where("set_id is not null")
    every = df.join(weighted.item_points(df, 5, 30, family), "item")
    want = rows_of(every.groupBy("set_id", "slot").agg(F.min(F.struct(F.col("c") / F.col("weight"), "item"))["item"].alias("item")))
    for scattered in (True, False):
        assert rows_of(weighted.sample_points(df, 5, 30, family, scattered).select("set_id", "slot", "item")) == want


def test_points_move_no_table_of_points(spark):
    """neither a table of points nor a join of it with the sets is exchanged."""
    text = plan(weighted.sample_points(spark.range(9).selectExpr("id % 2 set_id", "id item", "1.0D weight"), M, 192))
    assert "Join" not in text and text.count("Exchange hashpartitioning") == 2


def long_min(df, x):
    return df.groupBy("set_id", "slot").agg(F.min(x).alias("x"))


@pytest.mark.parametrize("family", FAMILIES)
def test_minwise_by_definition(words, family):
    every = words.select("set_id", "item", F.posexplode(minwise.permutation(F.col("item"), M, family)).alias("j", "slot"))
    r, j = H.uniform_draw(F.col("item"), F.col("j"), "r", family=family), F.col("j")
    want = long_min(every, r + j)
    assert sorted(minwise.superminhash(words, M, family).collect(), key=key) == sorted(want.collect(), key=key)
    want = long_min(every, F.struct(j, r, H.item_hash(F.col("item"), family).alias("hash"))).select("set_id", "slot", "x.hash")
    assert sorted(minwise.superminhash2(words, M, family).collect(), key=key) == sorted(want.collect(), key=key)


@pytest.mark.parametrize("family", FAMILIES)
def test_registers_by_definition(words, family):
    p = setsketch.SketchParams(m=40)
    every = words.select(F.struct("set_id").alias("id"), (F.col("set_id") % 2).alias("odd"), "item", F.explode(F.sequence(F.lit(0), F.lit(p.m - 1))).alias("slot"))
    x = H.exponential(H.uniform_draw(F.col("item"), F.col("slot"), "k", family=family)) / p.a
    want = every.groupBy("id", "odd", "slot").agg(F.min(x).alias("x")).select("id", "odd", "slot", setsketch.register(F.col("x"), p))
    got = setsketch.registers(words.select(F.struct("set_id").alias("id"), (F.col("set_id") % 2).alias("odd"), "item"), p, "id", "odd", family=family)
    ids = lambda df: sorted(((r[0][0], *r[1:]) for r in df.collect()), key=key)
    assert ids(got) == ids(want)


@pytest.mark.parametrize("family", FAMILIES)
def test_bins_by_definition(words, family):
    item = F.col("item")
    rows = words.select("set_id", (H.draw(item, "b", family=family) % 7).cast("int").alias("slot"), F.struct(H.uniform_draw(item, "u", family=family).alias("r"), H.item_hash(item, family).alias("value")).alias("v"))
    want = long_min(rows, "v").select("set_id", "slot", "x.r", "x.value")
    assert sorted(oneperm.bins(words, 7, family).collect(), key=key) == sorted(want.collect(), key=key)


ONCE = "superminhash_sig superminhash_f32 superminhash2_sig setsketch_regs setsketch_card setsketch_diag oph_bins oph_revjaccard"
PAIRS = "superminhash_jaccard superminhash2_jaccard setsketch_bounds setsketch_mle_b1 setsketch_mle oph_jaccard"


@pytest.mark.parametrize("name", [*ONCE.split(), *PAIRS.split(), "setsketch_merge"])
def test_items_are_not_hashed_row_by_row(spark, name):
    """F7, F10 to F20: the draws of an item come from the memo of the task, and no slots of items are exploded below it."""
    text = plan(registry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "md5(" not in text and text.count("MapInArrow") == 1


@pytest.mark.parametrize("name", "pminhash_sha pminhash_wide pminhash_map_input pminhash_merge_max pminhash_zero_weight".split())
def test_scattered_sets_are_folded_side_by_side(spark, name):
    """rows of a set come together, large sets in parts, and are folded before slots are exchanged."""
    text = plan(registry.queries()[name](spark, "/root/testdata/sf0.001"))
    assert "md5(" not in text and "sha2(" not in text and "Generate explode(sequence" not in text
    assert text.count("MapInArrow") == 1 and text.count("REBALANCE_PARTITIONS_BY_COL") == 1


def test_a_hot_set_is_split(spark):
    """of a set that is nearly the whole table no task gets all rows, and its slots are right."""
    df = spark.range(200_000).select(F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(7).alias("set_id"), F.col("id").alias("item"), F.rand(1).alias("weight"))

    def counted(batches):
        yield pa.RecordBatch.from_arrays([pa.array([sum(x.column(0).to_numpy().tolist().count(7) for x in batches)])], ["n"])

    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "100k")
    try:
        parts = [r.n for r in fold.together(df.repartition(16), "set_id").mapInArrow(counted, "n long").collect()]
        assert sum(parts) == 198_000 and max(parts) < 100_000
    finally:
        spark.conf.set(name, before)
