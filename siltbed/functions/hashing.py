"""Hashes that Spark lacks, as Arrow batches of Python: only for columns that show a hash."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of FNV-1a.
OFFSET_32, PRIME_32 = 0x811C9DC5, 0x01000193
OFFSET_64, PRIME_64 = 0xCBF29CE484222325, 0x100000001B3
#: The reversed polynomial of CRC-32C.
CASTAGNOLI = 0x82F63B78


def fnv1a(data: bytes, bits: int = 64) -> int:
    value, prime = (OFFSET_64, PRIME_64) if bits == 64 else (OFFSET_32, PRIME_32)
    mask = (1 << bits) - 1
    for byte in data:
        value = ((value ^ byte) * prime) & mask
    return value


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (CASTAGNOLI if n & 1 else 0)
        out.append(n)
    return out


_TABLE = _crc_table()


def crc32c(data: bytes) -> int:
    value = 0xFFFFFFFF
    for byte in data:
        value = (value >> 8) ^ _TABLE[(value ^ byte) & 255]
    return value ^ 0xFFFFFFFF


@F.pandas_udf(T.DecimalType(20, 0))
def fnv1a_64(names: pd.Series) -> pd.Series:
    from decimal import Decimal

    return names.map(lambda x: None if x is None else Decimal(fnv1a(x.encode())))


@F.pandas_udf(T.LongType())
def fnv1a_32(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else fnv1a(x.encode(), 32)).astype("Int64")


@F.pandas_udf(T.LongType())
def crc32c_of(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else crc32c(x.encode())).astype("Int64")


def fingerprint(data: bytes) -> int:
    """32 bits spread evenly over a name, so that fingerprints sort about as the names do; short names fill the high bits."""
    n_bits = 8 * len(data)
    value = int.from_bytes(data, "big")
    # Bit i counts from the name's first; the fingerprint takes every step-th from there.
    step = max(n_bits // 32, 1)
    picked = [(value >> (n_bits - 1 - i)) & 1 for i in range(0, n_bits, step)][:32]
    return sum(bit << (31 - i) for i, bit in enumerate(picked))


@F.pandas_udf(T.DecimalType(20, 0))
def name_hash(names: pd.Series) -> pd.Series:
    """The fingerprint above the 32-bit hash of a name."""
    from decimal import Decimal

    return names.map(lambda x: None if x is None else Decimal(fingerprint(x.encode()) << 32 | fnv1a(x.encode(), 32)))
