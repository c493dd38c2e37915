import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from setforge.llm import quality_model as M
from setforge.llm import quality_rules as Q
from setforge.llm import registry


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_rules_match_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    got = Q.op2_quality_rules(spark, f"/root/testdata/{sf}").toPandas().sort_values("doc_id").reset_index(drop=True)
    want = con.execute(registry.oracle_sql()["op2_quality_rules"]).df().sort_values("doc_id").reset_index(drop=True)
    assert (got == want[list(got.columns)]).all().all()


def plain_repeats(words):
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    return len({k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)})


def test_repeats_and_lines(spark):
    texts = ["a b c a b c a", "x x x x", "a b c d", "a b", "fa b cf fa b cf", "l1 w\n\nl1 w\n \nl1 w\nz", "a b c " * 50, "#*$ %& |<>"]
    book = {r.doc_id: r for r in Q.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        assert book[k].n_repeat_words == plain_repeats(t.split()), t
        assert book[k].n_words == len(t.split()) and book[k].word_chars == sum(map(len, t.split()))
    assert book[5].n_dup_lines == 2 and book[7].n_symbols == 8


def test_policies_and_ablations(spark):
    book = Q.ledger(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).cache()
    rows = Q.apply_policies(book, (Q.BASE, Q.STANDARD, Q.LENIENT)).collect()
    for r in rows:
        assert r.keep_base_v1 == (r.bits & Q.BASE.mask == 0) and r.keep_standard_v1 <= r.keep_lenient_v1
    for r in Q.ablations(book, Q.STANDARD).collect():
        bit = 1 << Q.RULES.index(r.rule)
        assert r.n_fail == sum(x.bits & bit > 0 for x in rows) and r.n_only == sum(x.bits == bit for x in rows)


def test_model_held_out(spark):
    sf = "/root/testdata/sf0.01"
    found = M.op5_quality_model(spark, sf)
    held = found.where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert held.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.95
    assert found.count() == 1000 and found.where("score < 0 or score > 1").count() == 0


def test_model_without_labels(spark, odd):
    labels = spark.createDataFrame([(0, None), (3, 2)], "doc_id long, quality long")
    assert {r.score for r in M.score(odd, M.train(odd, labels)).collect()} == {0.5}


def test_odd_rows(spark, odd, clash):
    labels = spark.createDataFrame([(k, k % 2) for k in range(9)] + [(3, 1), (None, 1)], "doc_id long, quality long")
    for docs in (odd, clash):
        book = Q.ledger(docs).collect()
        assert len(book) == 11 and {r.doc_id: r.n_words for r in book}[0] == 0
        scores = M.score(docs, M.train(docs, labels)).collect()
        assert len(scores) == 11 and {r.doc_id: r.score for r in scores}[0] == {r.doc_id: r.score for r in scores}[1]
    assert Q.ledger(odd.limit(0)).count() == M.score(odd.limit(0), M.train(odd.limit(0), labels)).count() == 0


def plain_ftrl(rows, p):
    """The definition: a weight minimises its gradients' sum, the pull to all its earlier values and the penalties."""
    past, w, bias_past, bias = {}, {}, [], 0.0

    def least(history, beta, l1, l2):
        def slope(v):
            pull = sum(s * (v - at) for _, s, at in history)
            return sum(g for g, _, _ in history) + pull + l1 * ((v > 0) - (v < 0)) + (beta / p.alpha + l2) * v

        low, high = -1e3, 1e3
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if slope(mid) < 0 else (low, mid)
        return (low + high) / 2

    def add(history, g, at):
        before = sum(x * x for x, _, _ in history)
        history.append((g, (math.sqrt(before + g * g) - math.sqrt(before)) / p.alpha, at))

    for _ in range(p.epochs):
        for slots, values, label in rows:
            x = sum(w.get(k, 0.0) * v for k, v in zip(slots, values, strict=True)) + bias
            g = 1 / (1 + math.exp(-x)) - label
            for k, v in zip(slots, values, strict=True):
                add(past.setdefault(k, []), g * v, w.get(k, 0.0))
                w[k] = least(past[k], p.beta, p.l1, p.l2)
            add(bias_past, g, bias)
            bias = least(bias_past, p.beta, 0.0, 0.0)
    return w, bias


def test_ftrl_by_definition():
    rnd, p = random.Random(5), M.FtrlParams(bits=5, epochs=2, l1=0.3)
    rows = []
    for _ in range(30):
        slots = sorted(rnd.sample(range(32), rnd.randint(0, 6)))
        rows.append((np.array(slots, np.int64), np.array([rnd.uniform(0.1, 4) for _ in slots]), int(5 in slots or rnd.random() < 0.3)))
    got, bias = M.fit(rows, p)
    want, want_bias = plain_ftrl([(a.tolist(), v.tolist(), y) for a, v, y in rows], p)
    assert bias == pytest.approx(want_bias, abs=1e-6)
    assert got.tolist() == pytest.approx([want.get(k, 0.0) for k in range(32)], abs=1e-6)
    assert (got != 0).sum() > 5 and (got == 0).any()
