import numpy as np
import pytest
import xxhash

from setforge.llm import simhash as S


def plain(spark_rows, radius=2):
    """component_id by comparing all pairs of fingerprints; text -> fingerprint as the contract says it."""
    ids, fps = [], []
    for i, text in spark_rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", low) if w]
        sh = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0)
        ids.append(i)
    return ids, fps, components(ids, fps, radius)


def components(ids, fps, radius):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                parent[find(a)] = find(b)
    low = {}
    for k in range(len(ids)):
        low[find(k)] = min(low.get(find(k), ids[k]), ids[k])
    return [low[find(k)] for k in range(len(ids))]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.op8_simhash(spark, "/root/testdata/sf0.001").collect()}
    ids, fps, comp = plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert got == {i: (f"{f:016x}", c) for i, f, c in zip(ids, fps, comp, strict=True)}


@pytest.mark.parametrize("block_rows", [2, 2048])
def test_links_of_random_fingerprints(spark, block_rows):
    """Chains, clusters and hot keys; with small blocks every key is refined."""
    rng = np.random.default_rng(7)
    fps = [int(x) for x in rng.integers(0, 2**63, 60)]
    for f in list(fps[:20]):
        for _ in range(4):
            f ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 4)), False))
            fps.append(f)
    fps = sorted({*fps, *(fps[0] ^ (1 << k) ^ (1 << j) for k in range(12) for j in range(k))})
    nodes = spark.createDataFrame([(k, bytearray(f.to_bytes(8, "big"))) for k, f in enumerate(fps)], "node long, fp binary")
    found = {r.node: r.component for r in S.components(S.links(nodes, S.SimHashParams(block_rows=block_rows))).collect()}
    assert [found.get(k, k) for k in range(len(fps))] == components(list(range(len(fps))), fps, 2)


def test_bit_sliced_is_hamming():
    rng = np.random.default_rng(3)
    for n, bits, radius in ((1, 64, 0), (70, 64, 2), (200, 512, 230), (64, 128, 60)):
        fps = rng.integers(0, 256, (n, bits // 8)).astype(np.uint8)
        want = np.bitwise_count(fps ^ fps[0]).sum(axis=1) <= radius
        near = S.bit_sliced(S._planes(fps), np.unpackbits(fps[0]), radius)
        assert (np.unpackbits(near.view(np.uint8), bitorder="little")[:n].astype(bool) == want).all()


def test_components_of_a_path(spark):
    edges = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in S.components(edges).collect()} == {0}
    assert S.components(edges.limit(0)).count() == 0


def test_tiles(spark):
    p = S.SimHashParams(words=5, bits=512, radius=90, repeats=False, blocks="minhash", block_rows=3)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(0, 120, 9)]
    found = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()
    assert {r.component_id for r in found} == {0}


def test_near_copies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = {r.doc_id: set(S.shingle_hashes(r.text, 5).tolist()) for r in rows}
    comp = {r.doc_id: r.component_id for r in S.near_duplicates(docs, S.NEAR_COPIES).collect()}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b:
                s = len(a & b) / len(a | b)
                assert s < 0.8 or comp[i] == comp[j]
                assert s > 0.3 or comp[i] != comp[j] or comp[i] not in (i, j)
    kept = {r.doc_id for r in S.keep_one(docs, S.NEAR_COPIES).collect()}
    assert kept == set(comp.values())


def test_odd_rows(spark, odd, clash):
    for docs in (odd, clash):
        got = S.near_duplicates(docs).collect()
        assert len(got) == 11
        comp = {r.doc_id: r.component_id for r in got}
        assert comp[0] == comp[1] == comp[2] == 0 and comp[7] == comp[6] == 6 and comp[None] is None and comp[3] == 3
        kept = S.keep_one(docs, S.NEAR_COPIES)
        assert kept.columns == docs.columns
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, k) for k in (0, 3, 4, 5, 6, 8)] + [(True, 0)]
    assert S.near_duplicates(odd.limit(0)).count() == S.keep_one(odd.limit(0)).count() == 0


def test_parameters():
    for bad in ({"bits": 65}, {"radius": 3}, {"blocks": "other"}, {"words": 0}):
        with pytest.raises(ValueError, match="."):
            S.SimHashParams(**bad)


def test_near_copies_are_exact(spark):
    """Short texts of similarity 0.8 are linked, 0.75 isn't; so in small blocks, in large ones and in tiles."""
    rows, want = [], {}
    for k in range(40):
        words = [f"w{k}x{j}" for j in range(9)]
        for n, text in ((0, words), (1, words[:8]), (2, words[:7])):  # 5, 4, 3 shingles: 0.8 and 0.75
            rows.append((10 * k + n, " ".join(text)))
            want[10 * k + n] = 10 * k + (2 if n == 2 else 0)
    base = [f"b{k}" for k in range(124)]
    for k in range(100):  # 120 shingles, one word of each text changed: 110 of 130 shared
        rows.append((1000 + k, " ".join(base[:k] + [f"y{k}"] + base[k + 1 :])))
        want[1000 + k] = 1000
    rows.append((2000, " ".join(base[:96])))  # 92 shingles: 92 of 120 at most
    want[2000] = 2000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for more in ({}, {"block_rows": 30}, {"block_shingles": 5000}):
        p = S.SimHashParams(**{**S.NEAR_COPIES.__dict__, **more})
        assert {r.doc_id: r.component_id for r in S.near_duplicates(docs, p).collect()} == want
