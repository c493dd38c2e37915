import hashlib
import random
import re

from setforge.llm import substring_dedup as D


def plain(rows, length=20):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        keep = [True] * len(words)
        for k in range(len(words) - length + 1):
            key = tuple(words[k : k + length])
            if key in seen:
                keep[k : k + length] = [False] * length
            seen.add(key)
        kept = " ".join(w for w, y in zip(words, keep, strict=True) if y)
        out[i] = (len(words), keep.count(False), hashlib.sha256(kept.encode()).hexdigest())
    return out


def run(docs, p=D.RepeatParams()):
    return {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(bytes(r.text)).hexdigest()) for r in D.remove_repeats(docs, p).collect()}


def test_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in D.op6_substring_dedup(spark, sf).collect()}
    assert got == plain([tuple(r) for r in docs.collect()])


def test_planted(spark):
    """Passages in new surroundings, periodic texts, copies inside one text, a passage that all share."""
    rng = random.Random(4)
    some = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    passages = [some(n) for n in (19, 20, 21, 55, 130)]
    rows = []
    for i in range(60):
        words = some(rng.randrange(40))
        for _ in range(rng.randrange(4)):
            words += rng.choice(passages) + some(rng.randrange(15))
        rows.append((i, "\n".join([" ".join(words), "a b " * (i % 3 * 20)])))
    for p in (D.RepeatParams(), D.RepeatParams(length=5, anchor_words=2), D.RepeatParams(length=4, anchor_words=4)):
        assert run(spark.createDataFrame(rows, "doc_id long, text string"), p) == plain(rows, p.length)


def test_odd_rows(spark, odd, clash):
    for docs in (odd, clash):
        got = D.remove_repeats(docs).collect()
        assert len(got) == 11 and sorted(r.n_words for r in got)[-1] == 60_001
        assert {r.doc_id: r.n_removed for r in got}[8] == 59_999
    text = " ".join(f"t{k}" for k in range(30))
    twice = spark.createDataFrame([(5, text), (5, text), (None, text)], "doc_id long, text string")
    assert sorted(r.n_removed for r in D.remove_repeats(twice).collect()) == [0, 30, 30]
    assert D.remove_repeats(odd.limit(0)).count() == 0
