"""Every stage against a plain version on the rows that its predecessor kept."""

import re
import zlib

import numpy as np

import corpus_pipeline as P
from setforge.llm import langid, mixing, simhash, tokens
from setforge.llm.common import cut

SF = "/root/testdata/sf0.001"


def kept_languages(rows):
    return {r.doc_id for r in rows if re.search(r"[^\W\d_]", r.text or "")}


def kept_copies(rows):
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text, 5).tolist()) for r in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(least):
        for i, a in sets.items():
            for j, b in sets.items():
                if i < j and len(a & b) >= least * len(a | b):
                    x, y = sorted((find(i), find(j)))
                    parent[y] = x
        return {find(i) for i in sets}

    return join(0.8), join(0.65)


def kept_clean(rows, items):
    words = lambda t: re.sub(r"[^\w\s]", "", (t or "").lower()).split()
    grams = [{tuple(w[k : k + 8]) for k in range(max(1, len(w) - 7))} for w in (words(b.text) for b in items)]
    out = set()
    for r in rows:
        w = words(r.text)
        own = {tuple(w[k : k + 8]) for k in range(len(w) - 7)}
        if not any(len(g & own) >= min(6, len(g)) for g in grams):
            out.add(r.doc_id)
    return out


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names, items = docs.columns, spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    rows, all_rows = docs.collect(), {r.doc_id: tuple(r) for r in docs.collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        docs = cut(stage(spark, docs, SF), f"test-{k}")
        got = docs.collect()
        if k < 4:
            assert docs.columns == names and all(tuple(r) == all_rows[r.doc_id] for r in got), name
        ids = {r.doc_id for r in got}
        assert len(ids) == len(got)
        if k == 0:
            assert ids == kept_languages(rows)
        elif k == 1:
            strict, loose = kept_copies(rows)
            assert loose <= ids <= strict
        elif k == 2:
            assert ids == kept_clean(rows, items)
        elif k == 3:
            order = [r.doc_id for r in sorted(mixing.mix(before).collect(), key=lambda r: r.mix_position)]
            assert [r.doc_id for r in P.stored_order(docs).collect()] == order
        else:
            tok, start, by = tokens.load("byte_bpe_50k.json"), 0, {r.doc_id: r for r in got}
            for i in order:
                own = np.array([*tok.encode(all_rows[i][names.index("text")], add_special_tokens=False).ids, 0], "<u4")
                assert (by[i].start, by[i].n_tokens, by[i].ids_crc32) == (start, len(own), zlib.crc32(own.tobytes()))
                start += len(own)
        rows, before = got, docs
    assert sorted(map(tuple, P.run(spark, SF).collect())) == sorted(map(tuple, rows))


def test_language_stage_uses_profiles(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert langid.accepted(docs, langid.LangParams(floor=1.1)).count() == 0 and langid.accepted(docs, langs=("de",)).where("lang <> 'de'").count() < 3


def test_odd_rows(spark, odd, clash):
    for docs in (odd, clash):
        last = docs
        for _, stage in P.STAGES:
            last = cut(stage(spark, last, SF), "odd")
        assert last.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and last.count() in (4, 5)
    empty = odd.limit(0)
    for _, stage in P.STAGES:
        empty = cut(stage(spark, empty, SF), "empty")
    assert empty.count() == 0
