import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from setforge.llm import mixing as M


WEIGHTS = {
    "equal": [1.0, 1.0],
    "three": [0.7, 0.2, 0.1],
    "small": [0.99, 0.0099, 0.0001],
    "half": [0.5] + [0.5 / 255] * 255,
    "thousand": [float(k) ** 0.5 for k in range(1, 1001)],
}


def deviations(weights, slots):
    """Least and greatest of blocks taken less weight's share, over all slots, in exact fractions."""
    total = sum(map(Fraction, weights))
    low = high = Fraction(0)
    for w, own in zip(weights, slots, strict=True):
        share = Fraction(w) / total
        for k, t in enumerate(own):  # furthest behind before a block is taken, furthest ahead after it
            low, high = min(low, k - share * t), max(high, k + 1 - share * (t + 1))
    return low, high


@pytest.mark.parametrize("name", WEIGHTS)
def test_less_than_one_block_from_the_weights(name):
    weights = WEIGHTS[name]
    least = sum(weights)
    blocks = [int(100_000 * w / least) + 1 for w in weights]
    slots = M.edf(M.whole_weights(weights), blocks)
    assert sorted(t for x in slots for t in x) == list(range(sum(map(len, slots))))
    assert sum(map(len, slots)) >= 90_000
    low, high = deviations(weights, slots)
    assert -1 < low and high < 1


def test_whole_weights():
    for weights in ([0.1, 0.2, 0.7], [1e-9, 1e9], [3.0, 1.0], [2.0**0.5, 3.0**0.5]):
        whole = M.whole_weights(weights)
        assert all(isinstance(w, int) and Fraction(w, whole[0]) == Fraction(x) / Fraction(weights[0]) for w, x in zip(whole, weights, strict=True))


@pytest.mark.parametrize("p", [M.MixParams(block_rows=3), M.MixParams(block_rows=1, bucket_rows=5, weights={"src0": 3, "src1": 1, "src2": 0.5})])
def test_schedule_of_documents(spark, p):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "source")
    rows = sorted(M.mix(docs, p).collect(), key=lambda r: r.mix_position)
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.collect()} and len({r.mix_position for r in rows}) == len(rows)
    order = list(dict.fromkeys((r.mix_slot, r.source, r.mix_block) for r in rows))
    assert [x[0] for x in order] == list(range(len(order)))
    sizes: dict = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + 1
    left = {s: -(-n // p.block_rows) for s, n in sizes.items()}
    weight = {s: n**0.5 if p.weights is None else p.weights.get(s, 0) for s, n in sizes.items()}
    begin, taken = 0, dict.fromkeys(left, 0)
    nxt = dict.fromkeys(left, 0)
    live = None
    for t, source, block in order:
        if live is None:  # a phase begins
            live = sorted(s for s in left if left[s] and weight[s] > 0) or sorted(s for s in left if left[s])
            w = [Fraction(weight[s] or left[s]) for s in live]
            share = dict(zip(live, [x / sum(w) for x in w], strict=True))
            begin, taken = t, dict.fromkeys(left, 0)
        assert block == nxt[source] and source in live
        nxt[source] += 1
        taken[source] += 1
        left[source] -= 1
        assert all(abs(taken[s] - (t + 1 - begin) * share[s]) < 1 for s in live)
        if not left[source]:
            live = None
    assert not any(left.values())


def test_stored_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = [r.doc_id for r in sorted(M.mix(docs).collect(), key=lambda r: r.mix_position)]
    assert [r.doc_id for r in M.in_order(docs).collect()] == want


def test_odd_rows(spark, odd, clash):
    for docs in (odd, clash):
        got = M.mix(docs).collect()
        assert len(got) == 11 and len({r.mix_position for r in got}) == 11
        assert set(M.mix(docs).columns) == {*docs.columns, "mix_block", "mix_slot", "mix_position"}
    assert M.mix(odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="weights"):
        M.MixParams(weights={"a": -1.0})


def test_more_sources_than_stand_alone(spark):
    """All rows of many sources get a place; those beyond the largest share the schedule of their pool."""
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('s', cast(pmod(id, if(id < 1500, 3, 700)) as string)) as source")
    got = M.mix(docs, M.MixParams(block_rows=4, max_sources=50)).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000)) and len({r.mix_position for r in got}) == 3000
    slots = {r.mix_slot for r in got}
    assert slots == set(range(len(slots)))
    taken = {(r.mix_slot, r.mix_block) for r in got}
    assert len(taken) == len(slots)


def ideal(weights, blocks):
    """Moments when the ideal division uses sources up, and the blocks it has then given for a weight of 1."""
    moments, given = [0.0], [0.0]
    left = sorted((b / w, w) for w, b in zip(weights, blocks, strict=True))
    rate = sum(weights)
    for v, w in left:
        moments.append(moments[-1] + (v - given[-1]) * rate)
        given.append(v)
        rate -= w
    return moments, given


def assert_follows_ideal(weights, blocks, slots):
    """At every slot each source's number of blocks is less than one away from the ideal division."""
    assert sorted(t for x in slots for t in x) == list(range(sum(blocks)))
    moments, given = ideal(weights, blocks)
    for w, b, own in zip(weights, blocks, slots, strict=True):
        at = np.array(own)
        assert len(own) == b and (np.diff(at) > 0).all()
        part = lambda t: np.minimum(w * np.interp(t, moments, given), b)  # noqa: B023, E731
        k = np.arange(b)
        assert (part(at) < k + 1 + 1e-6).all() and (part(at + 1) > k - 1e-6).all()


def test_kinds_follow_the_ideal_division():
    r = random.Random(3)
    for _ in range(200):
        n = r.randint(1, 8)
        w, b, m = [r.randint(1, r.choice([3, 50, 1000])) for _ in range(n)], [r.randint(1, r.choice([2, 60])) for _ in range(n)], [r.choice([1, 1, 2, 9]) for _ in range(n)]
        slots = {(c, i): [] for c in range(n) for i in range(m[c])}
        for c, k, i, t, length in M.turns(w, b, m):
            for x in range(length):
                assert len(slots[c, i + x]) == k
                slots[c, i + x].append(t + x)
        assert_follows_ideal([w[c] for c, _ in slots], [b[c] for c, _ in slots], list(slots.values()))


def test_every_source_of_thousands_follows_its_own_weight(spark):
    """One large source and over 2,400 of a few rows: each is held to the ideal division by itself, none in a pool."""
    docs = spark.range(9000).selectExpr("id as doc_id", "if(id < 1000, 'big', concat('s', cast(pmod(xxhash64(id), 2600) as string))) as source")
    got = M.mix(docs, M.MixParams(block_rows=4, bucket_rows=64)).collect()
    assert sorted(r.doc_id for r in got) == list(range(9000)) and len({r.mix_position for r in got}) == 9000
    sizes = Counter(r.source for r in got)
    assert len(sizes) > M.MixParams().max_sources and sizes["big"] == 1000
    place = {(r.source, r.mix_block): r.mix_slot for r in got}
    assert len(place) == len({(r.source, r.mix_block, r.mix_slot) for r in got})
    names, blocks = list(sizes), [-(-n // 4) for n in sizes.values()]
    assert_follows_ideal([n**0.5 for n in sizes.values()], blocks, [[place[s, k] for k in range(b)] for s, b in zip(names, blocks, strict=True)])
