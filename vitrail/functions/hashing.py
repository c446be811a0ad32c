"""Stable 64-bit FNV-1a hashes. Unsigned arithmetic wraps, which Spark SQL doesn't, so they are Arrow functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of FNV-1a.
OFFSET, PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1


#: Bytes that are hashed as arrays at once, and the least that are.
_CHUNK, _FEW = 1 << 16, 512
with np.errstate(over="ignore"):
    _POWERS = np.multiply.accumulate(np.full(_CHUNK, PRIME, np.uint64))[::-1].copy()


def fnv1a(data: bytes, start: int = OFFSET) -> int:
    """The hash of bytes, as arrays where there are many.

    A byte changes the low byte of the hash only, and the low byte goes its own way: bit by bit from the lowest, each is a running exclusive or of what the lower ones give.
    Knowing all low bytes, each step adds a known number before it multiplies, and the hash is a sum of powers of the prime.
    """
    h, done = start, 0
    while len(data) - done >= _FEW:
        b = np.frombuffer(data, np.uint8, min(_CHUNK, len(data) - done), done)
        done += len(b)
        x = np.zeros(len(b), np.uint8)  # the low byte of each hash with its input byte, as far as its bits are known
        for k in range(8):
            own = b >> np.uint8(k) & np.uint8(1)
            carried = (x * np.uint8(PRIME & 255)) >> np.uint8(k) & np.uint8(1)
            bit = np.empty(len(b), np.uint8)
            bit[0] = h >> k & 1
            np.bitwise_xor.accumulate((own ^ carried)[:-1], out=bit[1:])
            bit[1:] ^= bit[0]
            x |= (bit ^ own) << np.uint8(k)
        added = (x.astype(np.int64) - (x ^ b)).astype(np.uint64)
        powers = _POWERS[_CHUNK - len(b) :]
        h = (int((added * powers).sum(dtype=np.uint64)) + h * int(powers[0])) & MASK
    for c in data[done:]:
        h = ((h ^ c) * PRIME) & MASK
    return h


def signed(h: int) -> int:
    """The same 64 bits as a signed number, as tables hold them."""
    return h - (1 << 64) if h >> 63 else h


@F.pandas_udf(T.LongType())
def fnv1a_binary(data: pd.Series) -> pd.Series:
    """Null for null. Short texts of equal length are hashed together, byte by byte."""
    out = np.full(len(data), None, object)
    lengths = data.map(lambda b: -1 if b is None else len(b)).to_numpy()
    for n in np.unique(lengths[lengths >= 0]):
        at = np.flatnonzero(lengths == n)
        if n >= _FEW or len(at) < 4:
            out[at] = [signed(fnv1a(bytes(data.iloc[k]))) for k in at]
            continue
        h = np.full(len(at), OFFSET, np.uint64)
        if n:
            block = np.frombuffer(b"".join(bytes(data.iloc[k]) for k in at), np.uint8).reshape(len(at), n)
            for k in range(n):
                h = (h ^ block[:, k].astype(np.uint64)) * np.uint64(PRIME)
        out[at] = h.view(np.int64)
    return pd.Series(out, dtype="Int64")


def face_id(path: Column, detector: Column, version: Column, revision: Column, schema_version: Column, ordinal: Column) -> Column:
    """A stable name of a face: the hash of its image (slashes and case folded), detector revision and place."""
    from vitrail.functions.text import key_forward

    joined = F.concat_ws("\0", key_forward(path), detector, version, revision, schema_version.cast("string"), ordinal.cast("string"))
    return F.concat(F.lit("face-"), F.lpad(F.lower(F.hex(fnv1a_binary(F.encode(joined, "UTF-8")))), 16, "0"))


def preview_key(relative_path: Column, size: Column, modified_seconds: Column, modified_nanos: Column) -> Column:
    """The cache key of a preview: the hash of the path in its library and the state of its file."""
    joined = F.concat_ws("\0", relative_path, size.cast("string"), modified_seconds.cast("string"), modified_nanos.cast("string"))
    return F.lpad(F.lower(F.hex(fnv1a_binary(F.encode(joined, "UTF-8")))), 16, "0")


#: Sums of hashes are taken modulo this, the largest prime below 2**63.
MODULUS = 9223372036854775783


def table_signature(df, id_column: str, value_column: str):
    """(n_rows, mixed, mixed_again) of a table: equal for equal rows in any order, and different for rows that are repeated another number of times."""
    h = F.xxhash64(id_column, value_column)
    total = lambda c: F.coalesce(F.sum(c.cast("decimal(20,0)")) % F.lit(MODULUS).cast("decimal(20,0)"), F.lit(0)).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), total(h).alias("mixed"), total(F.xxhash64(h)).alias("mixed_again"))
