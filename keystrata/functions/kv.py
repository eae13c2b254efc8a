"""Sizes, size classes and routes of key-value pairs, as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

# Fixed values of the data model.
MAX_KEY = 255
MAX_KV = 16_384
META = 8  # bytes of metadata beside key and value
SEPARATED = 12  # bytes beside the key when the value lies in a log
LSN = 8
BIG_SUM = 1024
BIG_RATIO = 0.02
MEDIUM_RATIO = 0.2
SEGMENT = 2 * 1024 * 1024
LEVELS = 8
MEDIUM_INPLACE_LEVEL = 3
MAX_LSN = (1 << 63) - 1  # of values that a compaction appends to the medium log
SMALLEST_KEY = b"\x00"


def size_class(key_size: Column, value_size: Column, op: Column | None = None) -> Column:
    """SMALL, MEDIUM or BIG by the ratio of the two sizes and their sum; deletes are SMALL."""
    ratio = F.least(key_size, value_size).cast("double") / F.nullif(F.greatest(key_size, value_size), F.lit(0)).cast("double")
    big = (key_size + value_size > BIG_SUM) | (ratio < BIG_RATIO)
    found = F.when(big, "BIG").when(ratio <= MEDIUM_RATIO, "MEDIUM").otherwise("SMALL")
    return found if op is None else F.when(op == "delete", "SMALL").otherwise(found)


def kv_size(key_size: Column, value_size: Column, op: Column | None = None) -> Column:
    """Bytes in place; a tombstone's value counts nothing."""
    value = value_size if op is None else F.when(op == "delete", 0).otherwise(value_size)
    return (key_size + value + META).cast("long")


def separated_size(key_size: Column) -> Column:
    return (key_size + SEPARATED).cast("long")


def log_footprint(key_size: Column, value_size: Column) -> Column:
    return (key_size + value_size + META + LSN).cast("long")


def log_of(size_class: Column, level: Column | None = None) -> Column:
    """The log that takes a pair: small ones and medium ones in level 0 go to the recovery log."""
    medium = F.lit("L0_RECOVERY") if level is None else F.when(level >= 1, "MEDIUM").otherwise("L0_RECOVERY")
    return F.when(size_class == "BIG", "BIG").when(size_class == "MEDIUM", medium).otherwise("L0_RECOVERY")


def placement(size_class: Column, level: Column, inplace_level: int = MEDIUM_INPLACE_LEVEL) -> Column:
    """Category of a pair on a level: medium values move to a log on level 1 and back in place on `inplace_level`."""
    medium = F.when((level >= 1) & (level < inplace_level), "MEDIUM_INLOG").otherwise("MEDIUM_INPLACE")
    return F.when(size_class == "BIG", "BIG_INLOG").when(size_class == "MEDIUM", medium).otherwise("SMALL_INPLACE")


def kv_category(key_size: Column, value_size: Column, op: Column) -> tuple[Column, Column]:
    """(class, error): operations other than put and delete are an error and count as BIG."""
    known = F.coalesce(op.isin("put", "delete"), F.lit(False))
    return F.when(known, size_class(key_size, value_size, op)).otherwise("BIG"), F.when(~known, "unknown operation")


def _little(number: Column, size: int) -> Column:
    """A whole number as `size` little-endian bytes in hexadecimal."""
    digits = F.lpad(F.hex(number.cast("long")), 2 * size, "0")
    return F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))))


def serialized(key: Column, value: Column, size_class: Column, op: Column | None = None) -> Column:
    """A pair as bytes: 2 of metadata (bit 1: tombstone; bits 2 and 3: class), 2 of the key's size, 4 of the value's, key, value; numbers little-endian."""
    kind = F.when(size_class == "SMALL", 0).when(size_class == "MEDIUM", 1).otherwise(3)
    tombstone = F.lit(0) if op is None else F.when(op == "delete", 2).otherwise(0)
    key, value = key.cast("binary"), F.coalesce(value.cast("binary"), F.lit(b""))
    head = F.concat(_little(kind * 4 + tombstone, 2), _little(F.octet_length(key), 2), _little(F.octet_length(value), 4))
    return F.concat(F.unhex(head), key, value)


def deserialized(data: Column) -> tuple[Column, Column]:
    """Key and value of a serialized pair, as bytes."""

    def number(start: int, size: int) -> Column:
        digits = F.hex(F.substring(data, start, size))
        return F.conv(F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size)))), 16, 10).cast("int")

    key_size = number(3, 2)
    return F.substring(data, F.lit(META + 1), key_size), F.substring(data, F.lit(META + 1) + key_size, number(5, 4))


def put_error(key_size: Column, value_size: Column) -> Column:
    """Why a put is refused; null when it is accepted."""
    return (
        F.when(key_size > MAX_KEY, f"key size > {MAX_KEY}")
        .when(key_size == 0, "key size is zero")
        .when(key_size + value_size + META > MAX_KV, f"KV size > {MAX_KV}")
    )


def segment_of(offset: Column, size: int = SEGMENT) -> Column:
    return (offset - offset % size).cast("long")


def level_capacity(level: Column, level0: int = 1 << 20, growth: int = 4) -> Column:
    """Bytes a level holds; the last level has no bound (null)."""
    return F.when(level < LEVELS - 1, (F.lit(level0) * F.pow(F.lit(growth), level)).cast("long"))


def shard(key: Column, shards: int) -> Column:
    """A deterministic shard of a key, the same in any engine: four hexadecimal digits of md5 modulo the count."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 4), 16, 10).cast("long") % shards).cast("long")


@F.pandas_udf(DecimalType(20, 0))
def fnv1a(values: pd.Series) -> pd.Series:
    """64-bit FNV-1a over the eight little-endian bytes of a long, unsigned; Spark's BIGINT cannot wrap."""
    from decimal import Decimal

    left = values.to_numpy(np.int64).view(np.uint64)
    out = np.full(len(left), 0xCBF29CE484222325, np.uint64)
    with np.errstate(over="ignore"):
        for shift in range(0, 64, 8):
            out = (out ^ ((left >> np.uint64(shift)) & np.uint64(0xFF))) * np.uint64(0x100000001B3)
    return pd.Series([Decimal(int(x)) for x in out])
