import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from setforge.llm import langid as L


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = L.op9_language_id(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    held = found.where("held_out").join(docs, "doc_id")
    assert found.count() == docs.count()
    assert held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.99


def test_distance_by_definition():
    lists = {"aa": [1, 2, 70, 5], "bb": [5, 1]}
    model = L.Profiles.of(lists, 6)
    text = "abe aba"
    counts = dict(zip(*map(list, L.grams(L.codes(text))), strict=True))
    mine = sorted(counts, key=lambda c: (-counts[c], c))[:6]
    # a code without a rank counts as the rank after the last, top
    want = {x: sum(abs(k - (p.index(c) if c in p else 6)) for k, c in enumerate(mine)) for x, p in lists.items()}
    best = min(want, key=lambda x: (want[x], x))
    assert model.predict(text)[0] == best


def test_ties_go_to_the_first_language():
    lists = {"bb": [1, 2, 3], "aa": [1, 2, 3], "ab": [3, 2, 1]}
    assert L.Profiles.of(lists, 5).predict("a")[0] == "aa"


def test_texts_unlike_every_language_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    noise = "".join(random.Random(1).choices("bcdfghjklmnpqrstvwxz ", k=600))
    strange = ["Привет мир, как дела сегодня " * 20, noise, "こんにちは世界" * 60]
    more = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(strange)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in L.accepted(docs.unionByName(more)).select("doc_id").collect()}
    lettered = docs.where(F.col("text").rlike(r"\p{L}"))
    assert not any(k < 0 for k in kept)
    assert lettered.where(~F.col("doc_id").isin(sorted(kept))).count() == 0


def test_codes():
    assert L.codes("").size == L.codes("12 %\n").size == 0
    assert L.codes("a-B  c!").tolist() == [0, 1, 0, 2, 0, 3, 0]
    assert L.codes("!!A").tolist() == [0, 1, 0]
    assert L.codes("\U0001d4d0x").size == 4


def test_large_and_small_counts_agree():
    c = L.codes("the quick brown fox " * 6000)
    small = L.codes("the quick brown fox " * 60)
    assert L.ranked(*L.grams(c), 50).tolist() == L.ranked(*L.grams(small), 50).tolist()


def test_odd_rows(spark, odd, clash):
    for docs in (odd, clash):
        lists = L.learn(docs)
        got = L.predict(docs, lists).collect()
        assert len(got) == 11
        by = {r.doc_id: (r.lang_pred, r.score) for r in got}
        assert by[0] == by[1] == by[2] == by[4] == ("und", 0.0)
        assert all(0 <= s <= 1 for _, s in by.values())
        kept = L.accepted(docs)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} <= {3, 5, 6, 7, 8, None}
    empty = odd.limit(0)
    assert L.learn(empty) == {} and L.predict(odd, {}).where("lang_pred = 'und'").count() == 11
    assert L.accepted(empty).count() == 0


def test_accepted_learns_from_all_rows(spark):
    """Profiles and least scores of the pipeline's stage come from every row that is not held out, whatever per_lang is."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    p = L.LangParams(per_lang=20)
    own = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % p.folds != p.held_out and r.lang is not None and r.text is not None]
    rows = L.learning_rows(docs, p)
    assert sorted(map(tuple, rows.collect())) == sorted((r.lang, r.text) for r in own)
    lists, sums = L.train(rows, p), {}
    for r in own:
        sums.setdefault(r.lang, Counter()).update(dict(zip(*map(np.ndarray.tolist, L.grams(L.codes(r.text))), strict=True)))
    assert lists == {lang: sorted(c, key=lambda x: (-c[x], x))[: p.top] for lang, c in sums.items()}
    model, classes = L.Profiles.of(lists, p.top), {}
    for _, score, size in (model.judge(r.text) for r in own):
        classes.setdefault(size, []).append(score)
    want = {}
    for size, scores in classes.items():
        if size > 0 and len(scores) >= p.few:
            low = min(x for x in scores if 1000 * sum(y <= x for y in scores) >= len(scores))
            want[size] = max(p.floor, p.margin * low)
    got = L.least_scores(rows, lists, p)
    assert want and {size: got[size] for size in want} == want
    noise = "".join(random.Random(1).choices("bcdfghjklmnpqrstvwxz ", k=600))
    strange = ["Привет мир, как дела сегодня " * 20, noise, "こんにちは世界" * 60]
    more = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(strange)], "doc_id long, text string, lang string")
    assert L.accepted(docs.unionByName(more), p).where("doc_id < 0").count() == 0
