"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that may be within the radius meet in blocks. In a block the bit planes lie vertically (one machine word
holds one bit of 64 fingerprints); a query is XORed plane by plane and carry-save counters in the same vertical layout
hold 64 distances at once. Planes are read in groups; a block whose every distance is already over the radius is left.

Two ways make the blocks:

* ``pigeonhole`` (radius 2 or less, 64 bits): of four 16-bit quarters at least two agree, so every pair meets under one
  of six 32-bit keys. A key held by more than ``block_rows`` fingerprints is refined in the same way inside the other 32
  bits: then a block has 48 fixed bits and at most 65,536 distinct members, whatever the input. No link is lost.
* ``minhash`` (any radius): a pair of shingle similarity s meets with probability ``1-(1-s**rows)**bands``. A block over
  ``block_rows`` is cut in tiles and every pair of tiles is compared.

With ``least`` (minhash blocks of shingle sets), a pair is a link only if the Jaccard similarity of its shingle sets is
``least`` or more. Documents of equal sets are one node; blocks with the same members are compared once; the sets travel
only to the blocks. In blocks of over 64 rows the fingerprints leave out pairs beyond the radius before that; smaller
blocks are compared by sets alone.

A block emits a spanning star of each of its local components, never its pairs. Exact copies are one node.

Defined results: null text counts as empty; a text without words has fingerprint zero and is linked like any other;
rows with a doc_id in common are rows of one document each;
rows without a doc_id take part, but have no component and never name one; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setforge.llm.common import cut, discard

ONE = np.uint64(1)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


@dataclass(frozen=True)
class SimHashParams:
    """words per shingle, bits of a fingerprint (a multiple of 64), radius, whether repeats of a shingle count; least: the
    similarity of shingle sets that a link must have, 0 for links by the radius alone."""

    words: int = 3
    bits: int = 64
    radius: int = 2
    repeats: bool = True
    blocks: str = "pigeonhole"
    bands: int = 12
    rows: int = 4
    block_rows: int = 2048
    block_shingles: int = 1_000_000
    least: float = 0.0

    def __post_init__(self):
        if self.words < 1 or self.bits % 64 or self.bits < 64 or self.radius < 0:
            raise ValueError("words >= 1, bits a positive multiple of 64, radius >= 0")
        if self.blocks == "pigeonhole" and (self.bits != 64 or self.radius > 2):
            raise ValueError("pigeonhole blocks hold for 64 bits and a radius of 2 or less")
        if self.blocks not in ("pigeonhole", "minhash"):
            raise ValueError("blocks is pigeonhole or minhash")
        if self.least and (not 0 < self.least <= 1 or self.blocks != "minhash" or self.repeats):
            raise ValueError("least is a similarity of shingle sets (repeats=False) that meet in minhash blocks")


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words of the text with A-Z in lower case; fewer words: of them all."""
    from xxhash import xxh64_intdigest as digest

    toks = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes.split() splits at exactly \x20 \x09-\x0D
    if not toks:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(toks), len(toks)
    ends = np.cumsum(np.fromiter(map(len, toks), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    m = max(1, n - words + 1)
    stops = (ends[n - m :] - 1).tolist()
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[:m].tolist(), stops, strict=True)), np.uint64, m)


def mix(h: np.ndarray, k: int) -> np.ndarray:  # arrays only: numpy wraps 64-bit products of arrays silently
    """Another 64 well-mixed bits of each hash, by a multiply-xorshift finaliser with a step of its own for each k."""
    x = h + np.uint64(0x9E3779B97F4A7C15 * k % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prints_of(hashes: list[np.ndarray], bits: int) -> list[bytes]:
    """Fingerprints of several texts, as big-endian bytes: bit k of a word is 1 where over half the hashes have it.

    The first 64 bits come from the hashes themselves, further ones from hashes mixed anew. Counts of byte values, by
    text and place of the byte, give the counts of their bits.
    """
    sizes = np.array([len(h) for h in hashes])
    n, whole = len(sizes), np.concatenate([*hashes, np.empty(0, np.uint64)])
    text = np.repeat(np.arange(n) << 8, sizes)
    ones = np.empty((n, bits // 64, 8, 8), bool)
    for k in range(bits // 64):
        cols = (whole if k == 0 else mix(whole, k)).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        for j in range(8):
            table = np.bincount(text + cols[:, j], minlength=n << 8).reshape(n, 256)
            ones[:, k, 7 - j] = 2 * (table @ _BITS) > sizes[:, None]
    rows = np.packbits(ones.reshape(n, bits), axis=1).reshape(n, -1)
    return [r.tobytes() for r in rows]


def keys_of(hashes: list[np.ndarray], bands: int, rows: int) -> list[list[int]]:
    """Keys of the minhash bands of several shingle sets: signed 64-bit, the band's number mixed in."""
    full = np.array([k for k, h in enumerate(hashes) if len(h)], np.int64)
    out: list[list[int]] = [list(range(bands)) for _ in hashes]  # no shingles: alike among themselves
    if len(full):
        whole = np.concatenate([hashes[k] for k in full])
        starts = np.cumsum([0, *(len(hashes[k]) for k in full[:-1])])
        keys = np.empty((len(full), bands), np.uint64)
        for b in range(bands):
            acc = np.full(len(full), b + 1, np.uint64)
            for r in range(rows):
                k = 2 * (b * rows + r) + 3
                low = np.minimum.reduceat(whole * np.uint64((0x9E3779B97F4A7C15 * k | 1) % 2**64) + np.uint64(0xD1B54A32D192ED03 * k % 2**64), starts)
                acc = mix(acc ^ low, 1)
            keys[:, b] = acc
        for k, row in zip(full.tolist(), keys.view(np.int64).tolist(), strict=True):
            out[k] = row
    return out


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of n fingerprints given as uint8 rows: planes x ceil(n/64) words."""
    n = len(fps)
    bits = np.unpackbits(fps, axis=1)
    pad = -n % 64
    if pad:
        bits = np.vstack([bits, np.zeros((pad, bits.shape[1]), np.uint8)])
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view("<u8")


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Bits set where a vertical counter holds more than the radius: bitwise comparison from the top bit down."""
    more, same = np.zeros_like(counters[0]), np.full_like(counters[0], FULL)
    for k in range(max(len(counters), radius.bit_length()) - 1, -1, -1):
        c = counters[k] if k < len(counters) else np.zeros_like(counters[0])
        if radius >> k & 1:
            same &= c
        else:
            more |= same & c
            same &= ~c
    return more


def bit_sliced(planes: np.ndarray, query: np.ndarray, radius: int, group: int = 15) -> np.ndarray:
    """Words with a bit for each fingerprint within the radius of the query (its bits as 0/1)."""
    live = np.arange(planes.shape[1])
    near = np.zeros(planes.shape[1], np.uint64)
    counters: list[np.ndarray] = []
    work = planes
    for at in range(0, len(planes), group):
        carry_in: list[list[np.ndarray]] = [[]]
        for k in range(at, min(at + group, len(planes))):
            carry_in[0].append(~work[k] if query[k] else work[k])
        level = 0
        while level < len(carry_in):  # carry-save: three words of a weight become one, and one of the next weight
            bag = carry_in[level] + ([counters[level]] if level < len(counters) else [])
            while len(bag) > 1:
                a, b = bag.pop(), bag.pop()
                c = bag.pop() if bag else None
                half = a ^ b
                carry = a & b if c is None else (a & b) | (half & c)
                bag.append(half if c is None else half ^ c)
                if level + 1 == len(carry_in):
                    carry_in.append([])
                carry_in[level + 1].append(carry)
            if bag:
                if level < len(counters):
                    counters[level] = bag[0]
                else:
                    counters.append(bag[0])
            level += 1
        over = _over(counters, radius)
        if (keep := over != FULL).sum() <= len(live) // 2:  # abandon blocks of 64 that are all over the radius
            live = live[keep]
            if not len(live):
                return near
            work = work[:, keep]
            counters = [c[keep] for c in counters]
            over = over[keep]
    near[live] = ~over
    return near


def near_pairs(fps: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int, lanes: int = 1 << 15) -> np.ndarray:
    """Booleans: the pair (i, j) is within the radius; the pairs are the lanes of the bit planes."""
    out = []
    for at in range(0, len(i), lanes):
        a, b = i[at : at + lanes], j[at : at + lanes]
        planes = _planes(fps[a] ^ fps[b])
        near = bit_sliced(planes, np.zeros(len(planes), np.uint8), radius)
        out.append(np.unpackbits(near.view(np.uint8), bitorder="little")[: len(a)].astype(bool))
    return np.concatenate(out) if out else np.empty(0, bool)


def small_stars(fps: np.ndarray, ids: np.ndarray, offs: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Stars of many small blocks at once; block k has the rows offs[k] to offs[k+1]."""
    sizes = np.diff(offs)
    left, right = [], []
    for n in np.unique(sizes).tolist():
        i, j = np.triu_indices(n, 1)
        base = offs[:-1][sizes == n][:, None]
        left.append((base + i).ravel())
        right.append((base + j).ravel())
    i, j = np.concatenate(left), np.concatenate(right)
    near = near_pairs(fps, i, j, radius)
    i, j = i[near], j[near]
    rank = ids.copy()
    while len(i):  # every row takes the least id among its neighbours until nothing changes
        low = np.minimum(rank[i], rank[j])
        before = rank.copy()
        np.minimum.at(rank, i, low)
        np.minimum.at(rank, j, low)
        if (before == rank).all():
            break
    moved = rank != ids
    return list(zip(rank[moved].tolist(), ids[moved].tolist(), strict=True))


def block_stars(fps: np.ndarray, ids: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(smallest id, other id) of every local component of one block, by breadth-first search over near fingerprints."""
    n = len(ids)
    planes, bits = _planes(fps), np.unpackbits(fps, axis=1)
    todo = np.full(planes.shape[1], FULL)
    if n % 64:
        todo[-1] = np.uint64((1 << (n % 64)) - 1)
    stars = []
    for seed in range(n):
        if not int(todo[seed // 64]) >> (seed % 64) & 1:
            continue
        todo[seed // 64] &= ~(ONE << np.uint64(seed % 64))
        queue, members = [seed], [seed]
        while queue:
            have = np.flatnonzero(todo)  # words all of whose fingerprints are taken need no comparison
            if not len(have):
                break
            q = queue.pop()
            near = bit_sliced(planes[:, have], bits[q], radius) & todo[have]
            if near.any():
                todo[have] &= ~near
                hit = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little"))
                found = (have[hit // 64] * 64 + hit % 64).tolist()
                queue += found
                members += found
        if len(members) > 1:
            low = int(ids[members].min())
            stars += [(low, int(ids[m])) for m in members if int(ids[m]) != low]
    return stars


def exact_stars(fps: np.ndarray, ids: np.ndarray, flat: np.ndarray, offs: np.ndarray, radius: int, least: float) -> list[tuple[int, int]]:
    """As block_stars, for links of set similarity ``least`` or more; row k has the sorted hashes flat[offs[k]:offs[k+1]]."""
    n, sizes = len(ids), np.diff(offs)
    planes, bits = (_planes(fps), np.unpackbits(fps, axis=1)) if n > 64 else (None, None)
    todo = np.ones(n, bool)
    stars = []
    for seed in range(n):
        if not todo[seed]:
            continue
        todo[seed] = False
        queue, members = [seed], [seed]
        while queue:
            q = queue.pop()
            near = np.flatnonzero(todo)
            if not len(near):
                break
            if planes is not None:
                words = np.unique(near // 64)
                hit = np.flatnonzero(np.unpackbits(bit_sliced(planes[:, words], bits[q], radius).view(np.uint8), bitorder="little"))
                near = words[hit // 64] * 64 + hit % 64
                near = near[near < n]
                near = near[todo[near]]
            near = near[np.minimum(sizes[near], sizes[q]) >= least * np.maximum(sizes[near], sizes[q]) - 1e-6]
            own = flat[offs[q] : offs[q + 1]]
            for at in range(0, len(near), 256):
                some = near[at : at + 256]
                whole = np.concatenate([flat[offs[k] : offs[k + 1]] for k in some.tolist()])
                shared = own[np.minimum(np.searchsorted(own, whole), len(own) - 1)] == whole
                both = np.add.reduceat(shared.astype(np.int64), np.concatenate(([0], np.cumsum(sizes[some])[:-1])))
                found = some[both / (sizes[some] + sizes[q] - both) >= least]
                todo[found] = False
                queue += found.tolist()
                members += found.tolist()
        if len(members) > 1:
            low = int(ids[members].min())
            stars += [(low, int(ids[m])) for m in members if int(ids[m]) != low]
    return stars


def digest_of(h: np.ndarray) -> bytes:
    return hashlib.md5(h.astype("<u8", copy=False).tobytes(), usedforsecurity=False).digest()


def fingerprints(docs: DataFrame, p: SimHashParams) -> DataFrame:
    """doc_id, fp (binary), n_shingles, keys (minhash bands; empty with pigeonhole), whole (digest of the shingle set; null
    without ``least``) of every document."""

    def made(ids: list, hashes: list[np.ndarray]) -> pa.RecordBatch:
        keys = keys_of(hashes, p.bands, p.rows) if p.blocks == "minhash" else [[] for _ in hashes]
        cols = [pa.array(ids, pa.int64()), pa.array(prints_of(hashes, p.bits), pa.binary()), pa.array([len(h) for h in hashes], pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array([digest_of(h) if p.least else None for h in hashes], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "fp", "n_shingles", "keys", "whole"])

    def run(batches):
        for batch in batches:
            ids, hashes, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = shingle_hashes(t.as_py(), p.words)
                ids.append(i)
                hashes.append(h if p.repeats else np.unique(h))
                size += len(h)
                if size >= 100_000 or len(ids) >= 256:
                    yield made(ids, hashes)
                    ids, hashes, size = [], [], 0
            if ids:
                yield made(ids, hashes)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp binary, n_shingles long, keys array<long>, whole binary")


def _quarters(bits: F.Column, width: int) -> list:
    mask = (1 << width) - 1
    return [F.shiftrightunsigned(bits, width * k).bitwiseAND(F.lit(mask)) for k in range(4)]


_PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))


def _pigeonhole(nodes: DataFrame) -> DataFrame:
    q = _quarters(F.col("word"), 16)
    keys = [F.lit(t << 54).bitwiseOR(F.shiftleft(q[a], 16)).bitwiseOR(q[b]) for t, (a, b) in enumerate(_PAIRS)]
    rest = [F.shiftleft(q[c], 16).bitwiseOR(q[d]) for c, d in reversed(_PAIRS)]  # the two quarters that are not in the key
    return nodes.select("node", "fp", F.explode(F.array(*[F.struct(k.alias("key"), r.alias("rest")) for k, r in zip(keys, rest, strict=True)])).alias("k")).select("node", "fp", "k.key", "k.rest")


def _refined(hot: DataFrame) -> DataFrame:
    q = _quarters(F.col("rest"), 8)
    subs = [F.lit((t + 1) << 16).cast("long").bitwiseOR(F.shiftleft(q[a], 8)).bitwiseOR(q[b]) for t, (a, b) in enumerate(_PAIRS)]
    return hot.select("key", "node", "fp", F.explode(F.array(*subs)).alias("sub"))


def _tiles(hot: DataFrame) -> DataFrame:
    """Rows (key, t, node, ...) of blocks that are cut in t tiles: every pair of tiles becomes a block (key, sub)."""
    hot = hot.withColumn("own", F.pmod(F.xxhash64("node"), F.col("t"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t") - 1)))
    return hot.withColumn("sub", F.shiftleft(F.least("own", "other"), 31).bitwiseOR(F.greatest("own", "other"))).drop("own", "other", "t")


def _members() -> list:
    """Aggregates that tell the members of a block: their number and two hashes, whatever their order."""
    return [F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(node))").alias("s1"), F.expr("bit_xor(xxhash64(node, 1))").alias("s2")]


def _once(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of the blocks of two or more nodes, of blocks with the same members only one; n is the number of members."""
    sizes = rows.groupBy(*by).agg(*_members()).where("n > 1")
    keep = sizes.groupBy("n", "s1", "s2").agg(F.min(F.struct(*by)).alias("b")).select("n", "b.*")
    return rows.join(keep, by)


def _whole_blocks(batches, n_keys: int):
    """(rows, offsets) of whole blocks, from rows that come block by block; a block is a run of equal first n_keys columns."""
    rest = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
        if not rows.num_rows:
            continue
        new = np.zeros(rows.num_rows - 1, bool)
        for k in range(n_keys):
            key = rows.column(k).to_numpy()
            new |= key[1:] != key[:-1]
        starts = np.flatnonzero(new) + 1
        if len(starts):
            yield rows.slice(0, starts[-1]), np.concatenate(([0], starts))
            rows = rows.slice(starts[-1])
        rest = rows
    if rest is not None:
        yield rest, np.array([0, rest.num_rows])


def _fixed(column: pa.ChunkedArray) -> np.ndarray:
    """Bytes of binary values of one length, as rows."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _edges(stars: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in stars], pa.int64()) for k in (0, 1)], ["a", "b"])


def _compare(rows: DataFrame, radius: int, pairs: int = 200_000) -> DataFrame:
    """Stars (a, b) of blocks given as rows (key, sub, node, fp), every block of bounded size. Blocks come sorted, so a task holds
    one batch and one block; small blocks are compared together, up to so many pairs at once."""

    def run(batches):
        for table, offs in _whole_blocks(batches, 2):
            ids, data, sizes = table.column(2).to_numpy(), _fixed(table.column(3)), np.diff(offs)
            for k in np.flatnonzero(sizes > 64).tolist():
                yield _edges(block_stars(data[offs[k] : offs[k + 1]], ids[offs[k] : offs[k + 1]], radius))
            small = np.flatnonzero((sizes <= 64) & (sizes > 1))
            load = np.cumsum(sizes[small] * (sizes[small] - 1) // 2) // pairs
            for part in np.split(small, np.flatnonzero(np.diff(load)) + 1):
                if len(part):
                    at = np.concatenate([np.arange(offs[k], offs[k + 1]) for k in part.tolist()])
                    yield _edges(small_stars(data[at], ids[at], np.concatenate(([0], np.cumsum(sizes[part]))), radius))

    rows = rows.select("key", "sub", "node", "fp").repartition("key", "sub").sortWithinPartitions("key", "sub")
    return rows.mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, p: SimHashParams) -> DataFrame:
    """Stars (a, b) of node ids over all blocks; nodes: node long, fp binary, keys."""
    if p.blocks == "pigeonhole":
        rows = _pigeonhole(nodes.withColumn("word", F.conv(F.hex("fp"), 16, -10).cast("long")))
    else:
        rows = nodes.select("node", "fp", F.explode("keys").alias("key")).withColumn("rest", F.lit(0).cast("long"))
    rows = cut(_once(rows, ["key"]), "blocks")
    cold = rows.where(F.col("n") <= p.block_rows).withColumn("sub", F.lit(0).cast("long"))
    hot = rows.where(F.col("n") > p.block_rows)
    if p.blocks == "pigeonhole":
        hot = _once(_refined(hot), ["key", "sub"])
    else:
        hot = _tiles(hot.withColumn("t", F.ceil(F.col("n") / p.block_rows)))
    columns = ["key", "sub", "node", "fp"]
    out = cut(_compare(cold.select(*columns).unionByName(hot.select(*columns)), p.radius).distinct(), "links")
    discard(rows)
    return out


def _sets_of(texts: DataFrame, p: SimHashParams) -> DataFrame:
    """node, blocks, fp and shingles (sorted distinct hashes of 8 bytes) of rows (node, text, whole, blocks) whose set is the one
    that ``whole`` is the digest of."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                sets = [np.unique(shingle_hashes(t.as_py(), p.words)) for t in batch.column(1)]
                own = [k for k, h in enumerate(sets) if digest_of(h) == batch.column(2)[k].as_py()]
                sets, batch = [sets[k] for k in own], batch.take(pa.array(own, pa.int64()))
                cols = [batch.column(0), batch.column(3), *(pa.array(x, pa.binary()) for x in (prints_of(sets, p.bits), [h.astype("<u8", copy=False).tobytes() for h in sets]))]
                yield pa.RecordBatch.from_arrays(cols, ["node", "blocks", "fp", "shingles"])

    return texts.select("node", "text", "whole", "blocks").mapInArrow(run, "node long, blocks array<struct<key: long, sub: long>>, fp binary, shingles binary")


def exact_links(nodes: DataFrame, docs: DataFrame, p: SimHashParams, bands: range, known: DataFrame | None = None) -> DataFrame:
    """Stars (a, b) of node ids over the blocks of some bands, by links of set similarity ``least``; nodes: node, whole,
    n_shingles, keys. known: (node, component) of links found already; blocks inside one component are left out."""
    keys = F.slice("keys", bands.start + 1, len(bands))
    rows = nodes.select("node", "whole", "n_shingles", F.explode(keys).alias("key"))
    rows = rows.join(known, "node", "left").withColumn("c", F.coalesce("component", "node")) if known is not None else rows.withColumn("c", F.col("node"))
    sizes = rows.groupBy("key").agg(*_members(), F.sum("n_shingles").alias("shingles"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("n > 1 and c0 < c1")
    tiles = F.greatest(F.ceil(F.col("n") / p.block_rows), F.ceil(F.col("shingles") / p.block_shingles))
    keep = sizes.groupBy("n", "s1", "s2").agg(F.min(F.struct("key", tiles.alias("t"))).alias("b")).select("b.key", "b.t")
    rows = cut(rows.join(keep, "key").select("key", "t", "node", "whole"), "blocks")
    both = rows.where("t <= 1").drop("t").withColumn("sub", F.lit(0).cast("long")).unionByName(_tiles(rows.where("t > 1")))
    both = both.groupBy("node", "whole").agg(F.collect_list(F.struct("key", "sub")).alias("blocks"))  # a few for each band
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).join(both, "node")
    sets = _sets_of(texts, p).select(F.explode("blocks").alias("b"), "node", "fp", "shingles").select("b.key", "b.sub", "node", "fp", "shingles")

    def run(batches):
        for table, offs in _whole_blocks(batches, 2):
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                if b - a > 1:
                    rows = table.slice(a, b - a)
                    own = rows.column(4).to_pylist()
                    ends = np.concatenate(([0], np.cumsum([len(x) // 8 for x in own])))
                    yield _edges(exact_stars(_fixed(rows.column(3)), rows.column(2).to_numpy(), np.frombuffer(b"".join(own), "<u8"), ends, p.radius, p.least))

    found = sets.repartition("key", "sub").sortWithinPartitions("key", "sub").mapInArrow(run, "a long, b long")
    out = cut(found.distinct(), "links", tidy=True)
    discard(rows)
    return out


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reached.

    Every round each node points to the neighbour (or itself) of least hashed priority and edges move to the targets;
    the number of nodes falls by a constant factor in expectation, whatever the shape. Tables go to the shared folder.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    whole = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    owner = cut(whole.select("node", F.col("node").alias("rep")), "owner")
    for k in range(max_rounds):
        if edges.isEmpty():
            break
        rank = lambda c, k=k: F.xxhash64(c, F.lit(k))
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.struct(rank(F.col("b")).alias("r"), F.col("b").alias("to"))).alias("m"))
        target = cut(low.select(F.col("a").alias("at"), F.when(rank(F.col("a")) <= F.col("m.r"), F.col("a")).otherwise(F.col("m.to")).alias("to")), "target")
        moved = edges.join(target.select(F.col("at").alias("a"), F.col("to").alias("ta")), "a").join(target.select(F.col("at").alias("b"), F.col("to").alias("tb")), "b")
        new = cut(moved.where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
        up = cut(owner.join(target.withColumnRenamed("at", "rep"), "rep", "left").select("node", F.coalesce("to", "rep").alias("rep")), "owner")
        for old in (edges, owner, target):
            discard(old)
        edges, owner = new, up
    else:
        raise RuntimeError("components did not settle")
    low = owner.groupBy("rep").agg(F.min("node").alias("component"))
    return owner.join(low, "rep").select("node", "component")


def _linked(nodes: DataFrame, docs: DataFrame, p: SimHashParams) -> DataFrame:
    """(node, component) by the links of the nodes. Exact links: a quarter of the bands, which nearly all pairs meet in, then the
    others, where only blocks with several of the components found are compared."""
    if not p.least:
        return components(links(nodes, p))
    some = -(-p.bands // 4)
    first = exact_links(nodes, docs, p, range(some))
    known = cut(components(first), "known")
    second = exact_links(nodes, docs, p, range(some, p.bands), known)
    discard(known)
    return components(first.union(second))


def near_duplicates(docs: DataFrame, p: SimHashParams = SimHashParams(), hot_rows: int = 500, hot_classes: int = 100_000) -> DataFrame:
    """doc_id, fp (binary), component_id (smallest doc_id reachable, itself included), for every row of docs.

    Classes of copies of over ``hot_rows`` rows get their component by a broadcast join, so that their rows stay where they
    are; that number rises with the table, so that there are at most ``hot_classes`` of these. The others are joined by shuffle.
    """
    prints = cut(fingerprints(docs, p), "prints")
    same = ["whole"] if p.least else ["fp", "keys"]  # documents alike in all of these are one node
    more = [F.first(c).alias(c) for c in ("n_shingles", "keys")] if p.least else []
    nodes = cut(prints.groupBy(*same).agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies"), *more), "nodes")
    linked = nodes.where("node is not null")
    named = cut(nodes.select(*same, "node", "copies").join(_linked(linked, docs, p), "node", "left").select(*same, "copies", F.coalesce("component", "node").alias("component_id")), "named")
    least = max(hot_rows, prints.count() // hot_classes)
    hot, cold = named.where(F.col("copies") > least), named.where(F.col("copies") <= least)
    rows = prints.select("doc_id", "fp", *[c for c in same if c != "fp"])
    rows = rows.join(F.broadcast(hot.select(*same, F.col("component_id").alias("hot_id"), F.lit(True).alias("hot"))), same, "left")
    done = rows.where("hot").select("doc_id", "fp", F.col("hot_id").alias("component_id"))
    rest = rows.where("hot is null").join(cold, same).select("doc_id", "fp", "component_id")
    return done.unionByName(rest).select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, p: SimHashParams = SimHashParams()) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, one for each doc_id, and those without a doc_id."""
    found = cut(near_duplicates(docs, p).select("doc_id", "component_id"), "classes")
    keep = found.where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.where("doc_id is not null").join(keep, "doc_id", "left_semi").select(*docs.columns)
    if not found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        rows = rows.dropDuplicates(["doc_id"])
    return rows.unionByName(docs.where("doc_id is null"))


#: Pipeline: 5-word shingle sets, links of 0.8 by the sets themselves. The expected distance of fingerprints at 0.8 is 77 of
#: 512 bits, and 96 (standard deviation 9) for sets of 4 and 5: the radius is 7 deviations more. 24 bands: a pair of 0.8
#: meets with probability 0.999997.
NEAR_COPIES = SimHashParams(words=5, bits=512, radius=160, repeats=False, blocks="minhash", bands=24, least=0.8)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    from setforge.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents"), SimHashParams())
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
