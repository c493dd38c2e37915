"""Item hashes and uniforms as Column expressions, invertible integer hashes, and the SQL of the portable family.

A family turns an item (as text) and a label into 52 uniform bits. ``md5`` and ``sha256`` give the same bits in any SQL
engine; ``xxhash64`` takes values as they are. Arrays of draws give the bits of the Column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

try:  # CPython's own are started faster than the library's
    from _md5 import md5
    from _sha2 import sha256
except ImportError:
    from hashlib import md5, sha256

FAMILIES = ("md5", "sha256", "xxhash64")
TWO52 = float(1 << 52)


def key_text(item: Column, *labels: Column | str | int) -> Column:
    """item#label#..., the text that is hashed."""
    parts = [item.cast("string"), *[x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in labels]]
    return F.concat_ws("#", *parts)


def bits52(text: Column, family: str = "md5") -> Column:
    """52 bits (bigint, not negative) of a text."""
    if family == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(text), 12)
    if family not in FAMILIES:
        raise ValueError(f"family is one of {FAMILIES}")
    digest = F.md5(text) if family == "md5" else F.sha2(text.cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint")


def uniform(text: Column, family: str = "md5") -> Column:
    """Uniform in (0, 1], a multiple of 2**-52."""
    return (bits52(text, family).cast("double") + 1.0) / TWO52


def draw(item: Column, *labels: Column | str | int, family: str = "md5") -> Column:
    """52 bits for an item and labels; xxhash64 takes the values as they are, without making a text of them."""
    if family == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(item, *[x if isinstance(x, Column) else F.lit(x) for x in labels]), 12)
    return bits52(key_text(item, *labels), family)


def uniform_draw(item: Column, *labels: Column | str | int, family: str = "md5") -> Column:
    """The same as a uniform in (0, 1]."""
    return (draw(item, *labels, family=family).cast("double") + 1.0) / TWO52


def item_hash(item: Column, family: str = "md5") -> Column:
    """60 bits (bigint, not negative) of an item's text, alike in any SQL engine; of the item as it is with xxhash64."""
    if family == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(item), 4)
    return F.conv(F.substring(F.md5(item.cast("string")), 1, 15), 16, 10).cast("bigint")


def hash32(value: Column) -> Column:
    """32 bits of a value's text as bigint."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 8), 16, 10).cast("bigint")


def sql_bits52(text: str, family: str = "md5") -> str:
    return f"('0x' || substr({'md5' if family == 'md5' else 'sha256'}({text}), 1, 13))::BIGINT"


def sql_uniform(text: str, family: str = "md5") -> str:
    return f"(({sql_bits52(text, family)})::DOUBLE + 1.0) / 4503599627370496.0"


def sql_item_hash(item: str) -> str:
    return f"('0x' || substr(md5(({item})::VARCHAR), 1, 15))::BIGINT"


def sql_hash32(value: str) -> str:
    return f"('0x' || substr(md5(({value})::VARCHAR), 1, 8))::BIGINT"


# The same draws as arrays, for items that are met again and again: items are bytes, for xxhash64 the hashes of the items.


def draw_array(items: Sequence, labels: Sequence[tuple], family: str = "md5", drop: int = 12) -> np.ndarray:
    """``draw`` for each item (rows) and each tuple of labels (columns); ``drop``: bits left out of 64."""
    if family == "xxhash64":
        seeds = np.array(items, np.int64).view(np.uint64)
        return np.stack([(_xxhash64(seeds, x) >> np.uint64(drop)).view(np.int64) for x in labels], axis=1)
    if family not in FAMILIES:
        raise ValueError(f"family is one of {FAMILIES}")
    bare = ["#".join(map(str, x)).encode() for x in labels]  # concat_ws leaves a null item out
    tails = [b"#" + x if x else b"" for x in bare]
    longest = 55 - max(map(len, tails))
    if family == "md5" and len(items) * len(labels) >= 4096:
        short = np.array([t is not None and len(t) <= longest for t in items])
        rest = [t for t, fits in zip(items, short, strict=True) if not fits]
        out = np.empty((len(items), len(labels)), np.uint64)
        out[short] = _md5_array([t for t, fits in zip(items, short, strict=True) if fits], tuple(tails))
        out[~short] = _digests(md5, 16, rest, bare, tails)
    else:
        out = _digests(*((md5, 16) if family == "md5" else (sha256, 32)), items, bare, tails)
    return (out >> np.uint64(drop)).view(np.int64)


def _digests(make, size: int, items: Sequence, bare: list[bytes], tails: list[bytes]) -> np.ndarray:
    digests = b"".join([make(head + x).digest() for head, ends in ((b"", bare) if t is None else (t, tails) for t in items) for x in ends])
    return np.frombuffer(digests, ">u8")[:: size // 8].astype(np.uint64).reshape(len(items), len(tails))


# md5 of many texts of one block, step by step over arrays (RFC 1321).
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MD5_TURNS = [x for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for x in row * 4]
_MD5_SINES = [np.uint32(int(abs(math.sin(k + 1)) * 2**32)) for k in range(64)]


@lru_cache(maxsize=4096)
def _md5_ends(length: int, tails: tuple[bytes, ...]) -> np.ndarray:
    """What follows a text of a length in its block, with zeros in the text's place: (tails, 16) words."""
    blocks = [(bytes(length) + x + b"\x80").ljust(56, b"\0") + (8 * (length + len(x))).to_bytes(8, "little") for x in tails]
    return np.frombuffer(b"".join(blocks), "<u4").reshape(len(tails), 16)


def _md5_array(items: list[bytes], tails: tuple[bytes, ...]) -> np.ndarray:
    """The first 64 bits of md5(item + tail), where item and tail have 55 bytes at most."""
    heads = np.frombuffer(b"".join([t.ljust(64, b"\0") for t in items]), "<u4").reshape(len(items), 16)
    sizes, kind = np.unique(np.fromiter(map(len, items), np.int64, len(items)), return_inverse=True)
    ends = np.array([_md5_ends(int(n), tails) for n in sizes], np.uint32).reshape(len(sizes), len(tails), 16)
    out, step = np.empty((len(items), len(tails)), np.uint64), max(1, (1 << 14) // len(tails))
    for at in range(0, len(items), step):
        words = heads[at : at + step, None, :] | ends[kind[at : at + step]]
        a, b = _md5_block(np.ascontiguousarray(words.reshape(-1, 16).T))
        out[at : at + step] = (a.byteswap().astype(np.uint64) << np.uint64(32) | b.byteswap()).reshape(-1, len(tails))
    return out


def _md5_block(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in _MD5_START)
    f, g = np.empty_like(a), np.empty_like(a)
    for k in range(64):
        if k < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            at = k
        elif k < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            at = (5 * k + 1) % 16
        elif k < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            at = (3 * k + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            at = 7 * k % 16
        f += a
        f += _MD5_SINES[k]
        f += words[at]
        np.right_shift(f, np.uint32(32 - _MD5_TURNS[k]), out=g)
        f <<= np.uint32(_MD5_TURNS[k])
        f |= g
        f += b
        a, b, c, d, f = d, f, b, c, a
    return a + np.uint32(_MD5_START[0]), b + np.uint32(_MD5_START[1])


FULL = (1 << 64) - 1
_XX = [np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _xxhash64(seeds: np.ndarray, labels: tuple) -> np.ndarray:
    """Spark's xxhash64 of further labels, ints and texts of under 4 bytes, after values whose hashes are the seeds."""
    p1, p2, p3, _, p5 = _XX
    h = seeds
    for x in labels:
        if isinstance(x, str):
            text = x.encode()
            if len(text) > 3:
                raise ValueError("labels of under 4 bytes")
            h = h + p5 + np.uint64(len(text))
            for byte in text:
                h = _rotated(h ^ np.uint64(byte * int(p5) & FULL), 11) * p1
        else:
            h = _rotated((h + p5 + np.uint64(4)) ^ np.uint64((x & 0xFFFFFFFF) * int(p1) & FULL), 23) * p2 + p3
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        h = h ^ (h >> np.uint64(32))
    return h


def uniform_array(bits: np.ndarray) -> np.ndarray:
    return (bits.astype(float) + 1.0) / TWO52


def item_hash_array(items: Sequence, family: str = "md5") -> np.ndarray:
    return draw_array(items, [()], "xxhash64" if family == "xxhash64" else "md5", drop=4)[:, 0]


def exponential(u: Column) -> Column:
    """Standard exponential of a uniform."""
    return -F.ln(u)


def truncated_exponential(u: Column, rate: float) -> Column:
    """Exponential of a rate, conditioned on [0, 1), by the inverse of its distribution function."""
    if not rate > 0:
        raise ValueError("rate > 0")
    return -F.ln(1.0 - (1.0 - u) * (1.0 - float(np.exp(-rate)))) / rate


# Thomas Wang's invertible integer hashes: published steps of shifts, exclusive ors and odd multiples. The inverse of a
# multiple is the multiple by the inverse modulo 2**n; that of x ^ (x >> s) folds x >> s, x >> 2s, ... into x.


def _unshift(x: np.ndarray, s: int, bits: int) -> np.ndarray:
    out = x.copy()
    for k in range(s, bits, s):
        out ^= x >> np.uint64(k)
    return out


def _odd(c: int, bits: int) -> np.uint64:
    return np.uint64(pow(c, -1, 1 << bits))


def wang64_array(key: np.ndarray) -> np.ndarray:
    k = key.astype(np.int64).view(np.uint64)
    k = k * np.uint64((1 << 21) - 1) - np.uint64(1)  # ~k + (k << 21)
    for s, c in ((24, 265), (14, 21), (28, (1 << 31) + 1)):
        k = (k ^ (k >> np.uint64(s))) * np.uint64(c)
    return k.view(np.int64)


def wang64_inverse_array(key: np.ndarray) -> np.ndarray:
    k = key.astype(np.int64).view(np.uint64)
    for s, c in ((28, (1 << 31) + 1), (14, 21), (24, 265)):
        k = _unshift(k * _odd(c, 64), s, 64)
    return ((k + np.uint64(1)) * _odd((1 << 21) - 1, 64)).view(np.int64)


@F.pandas_udf(LongType())
def wang64(key: pd.Series) -> pd.Series:
    """64-bit hash of a bigint, as the bigint of the same bits."""
    return pd.Series(wang64_array(key.to_numpy()))


@F.pandas_udf(LongType())
def wang64_inverse(key: pd.Series) -> pd.Series:
    return pd.Series(wang64_inverse_array(key.to_numpy()))


def wang32_steps(xor, shift, x: str = "x") -> list[str]:
    """The steps of the 32-bit hash as SQL over x in 0 .. 2**32-1; xor and shift write an exclusive or and a right shift."""
    m = "4294967295"
    return [
        f"({x} + ({m} - (({x} * 32768) & {m}))) & {m}",
        xor(x, shift(x, 10)),
        f"({x} * 9) & {m}",
        xor(x, shift(x, 6)),
        f"({x} + ({m} - (({x} * 2048) & {m}))) & {m}",
        xor(x, shift(x, 16)),
    ]


def wang32_inverse_steps(xor, shift, x: str = "x") -> list[str]:
    """The steps back; multipliers over 2**31 are taken less 2**32, so that products stay within 63 bits."""
    full = 1 << 32

    def times(c: int, v: str) -> str:
        c %= full
        return f"({v} * ({c - full if c >= 1 << 31 else c})) & {full - 1}"

    def fold(s: int) -> str:
        out = x
        for k in range(s, 32, s):
            out = xor(out, shift(x, k))
        return out

    def unshift(s: int) -> str:  # x + ~(x << s) is x * (1 - 2**s) - 1
        return times(pow(1 - (1 << s), -1, full), f"(({x} + 1) & {full - 1})")

    return [fold(16), unshift(11), fold(6), times(pow(9, -1, full), x), fold(10), unshift(15)]


def _spark_xor(a: str, b: str) -> str:
    return f"({a} ^ {b})"


def _spark_shift(a: str, n: int) -> str:
    return f"shiftright({a}, {n})"


def _duck_xor(a: str, b: str) -> str:
    return f"xor({a}, {b})"


def _duck_shift(a: str, n: int) -> str:
    return f"({a} >> {n})"


def _nested(column: str, steps: list[str]) -> Column:
    """Each step over a value that is computed once: the argument of a lambda."""
    text = f"cast({column} as bigint)"
    for step in steps:
        text = f"element_at(transform(array({text}), x -> {step}), 1)"
    return F.expr(text)


def wang32(column: str) -> Column:
    """32-bit hash of a bigint column in 0 .. 2**32-1."""
    return _nested(column, wang32_steps(_spark_xor, _spark_shift))


def wang32_inverse(column: str) -> Column:
    return _nested(column, wang32_inverse_steps(_spark_xor, _spark_shift))


def sql_steps(source: str, column: str, steps: list[str]) -> str:
    """A DuckDB query of (key, x) that applies the steps to a column, one subquery a step."""
    text = f"SELECT {column} AS key, {column} AS x FROM {source}"
    for step in steps:
        text = f"SELECT key, {step} AS x FROM ({text})"
    return text


def sql_wang32(source: str, column: str) -> str:
    return sql_steps(source, f"{column}::BIGINT", wang32_steps(_duck_xor, _duck_shift))


def sql_wang32_inverse(source: str, column: str) -> str:
    return sql_steps(source, f"{column}::BIGINT", wang32_inverse_steps(_duck_xor, _duck_shift))


def _wide(x: str) -> str:
    """A step over unsigned 128-bit values, modulo 2**64."""
    return f"({x}) % 18446744073709551616::UHUGEINT"


def sql_wang64(source: str, column: str, inverse: bool = False) -> str:
    """A DuckDB query of (key, x) for the 64-bit hash or its inverse, x as signed bigint."""
    full, u = 1 << 64, lambda n: f"{n % (1 << 64)}::UHUGEINT"
    mul = lambda c: _wide(f"x * {u(c)}")
    shift = lambda s: f"(x // {u(1 << s)})"

    def fold(s: int) -> str:
        out = "x"
        for k in range(s, 64, s):
            out = f"xor({out}, (x // {u(1 << k)}))"
        return out

    rounds = ((24, 265), (14, 21), (28, (1 << 31) + 1))
    if inverse:
        steps = [y for s, c in reversed(rounds) for y in (mul(pow(c, -1, full)), fold(s))]
        steps += [_wide(f"x + {u(1)}"), mul(pow((1 << 21) - 1, -1, full))]
    else:
        steps = [_wide(f"x * {u((1 << 21) - 1)} + {u(-1)}")] + [y for s, c in rounds for y in (f"xor(x, {shift(s)})", mul(c))]
    start = f"(CASE WHEN {column} < 0 THEN {column}::HUGEINT + 18446744073709551616::HUGEINT ELSE {column}::HUGEINT END)::UHUGEINT"
    text = f"SELECT {column}::BIGINT AS key, {start} AS x FROM {source}"
    for step in steps:
        text = f"SELECT key, {step} AS x FROM ({text})"
    return f"SELECT key, (CASE WHEN x >= 9223372036854775808::UHUGEINT THEN x::HUGEINT - 18446744073709551616::HUGEINT ELSE x::HUGEINT END)::BIGINT AS x FROM ({text})"
