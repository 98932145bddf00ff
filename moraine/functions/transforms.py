"""Partition transforms as Spark columns, and for single values.

Null gives null everywhere. Times are counted from 1970-01-01 UTC and rounded down, whatever the
session's time zone.
"""

from __future__ import annotations

import datetime as dt
import struct
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..format.types import Primitive, Transform
from ..format.values import days, micros, scaled, time_micros, twos_complement, unscaled
from .murmur import hash_binary, hash_decimals, hash_longs, hash_one

DAY_US, HOUR_US = 86_400_000_000, 3_600_000_000


def floor_div(c: Column, d: int) -> Column:
    """Whole-number division rounding down, exact over all of bigint."""
    return F.call_function("div", c - F.pmod(c, F.lit(d).cast("bigint")), F.lit(d).cast("bigint"))


def micros_of(c: Column, source: Primitive) -> Column:
    """Microseconds since 1970 of a timestamp column with or without zone."""
    if source.name == "timestamptz":
        return F.unix_micros(c)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def _date(c: Column, source: Primitive) -> Column:
    return c if source.name == "date" else F.date_from_unix_date(floor_div(micros_of(c, source), DAY_US).cast("int"))


@F.arrow_udf(T.IntegerType())
def _hash_long(v: pa.Array) -> pa.Array:
    return pa.array(hash_longs(v.fill_null(0).to_numpy(zero_copy_only=False)), pa.int32(), mask=v.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.IntegerType())
def _hash_binary(v: pa.Array) -> pa.Array:
    return pa.array(hash_binary(v), pa.int32(), mask=v.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(T.IntegerType())
def _hash_decimal(v: pa.Array) -> pa.Array:
    return pa.array(hash_decimals(v), pa.int32(), mask=v.is_null().to_numpy(zero_copy_only=False))


def _truncator(width: int, scale: int):
    @F.arrow_udf(T.DecimalType(38, scale))
    def run(v: pa.Array) -> pa.Array:
        unscaled_ = [None if x is None else unscaled(x, scale) for x in v.to_pylist()]
        return pa.array([None if n is None else scaled(n - n % width, scale) for n in unscaled_], pa.decimal128(38, scale))

    return run


def hash_column(c: Column, source: Primitive) -> Column:
    """The 32-bit hash that ``bucket`` is made from."""
    if source.is_decimal:
        return _hash_decimal(c)
    if source.name in ("int", "long"):
        return _hash_long(c.cast("bigint"))
    if source.name == "date":
        return _hash_long(F.unix_date(c).cast("bigint"))
    if source.name in ("timestamp", "timestamptz"):
        return _hash_long(micros_of(c, source))
    if source.name == "time":
        return _hash_long(F.call_function("time_diff", F.lit("MICROSECOND"), F.expr("TIME'00:00:00'"), c))
    return _hash_binary(c.cast("binary"))


def transform_column(t: Transform, c: Column, source: Primitive) -> Column:
    t.result(source)
    if t.name == "identity":
        return c
    if t.name == "void":
        return F.lit(None).cast("int")
    if t.name == "year":
        return (F.year(_date(c, source)) - 1970).cast("int")
    if t.name == "month":
        d = _date(c, source)
        return (12 * (F.year(d) - 1970) + F.month(d) - 1).cast("int")
    if t.name == "day":
        return F.unix_date(c) if source.name == "date" else floor_div(micros_of(c, source), DAY_US).cast("int")
    if t.name == "hour":
        return floor_div(micros_of(c, source), HOUR_US).cast("int")
    if t.name == "bucket":
        return F.pmod(hash_column(c, source).bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(t.width)).cast("int")
    if source.name == "string":
        return F.substring(c, 1, t.width)
    if source.is_decimal:
        p, s = source.decimal
        if p == 38:  # a difference of two such values would lose its last digit
            return _truncator(t.width, s)(c)
        digits = max(len(str(t.width)), s)
        width = F.lit(str(scaled(t.width, s))).cast(f"decimal({digits},{s})")
        return (c - F.pmod(c, width)).cast(f"decimal({p},{s})")
    kind = "int" if source.name == "int" else "bigint"
    return (c - F.pmod(c, F.lit(t.width).cast(kind))).cast(kind)


def transform_value(t: Transform, v, source: Primitive):
    """The transform of one value, for planning."""
    t.result(source)
    if v is None or t.name == "void":
        return None
    if t.name == "identity":
        return v
    if t.name == "bucket":
        if source.is_decimal:
            raw = twos_complement(unscaled(Decimal(v), source.decimal[1]))
        elif source.name == "string":
            raw = v.encode()
        elif source.name == "uuid":
            raw = v.bytes if hasattr(v, "bytes") else bytes(v)
        elif source.name == "binary" or source.fixed_length is not None:
            raw = bytes(v)
        else:
            number = {"date": days, "time": time_micros, "timestamp": micros, "timestamptz": micros}.get(source.name, int)(v)
            raw = struct.pack("<q", number)
        return (hash_one(raw) & 0x7FFFFFFF) % t.width
    if t.name == "truncate":
        if source.name == "string":
            return v[: t.width]
        if source.is_decimal:
            n = unscaled(Decimal(v), source.decimal[1])
            return scaled(n - n % t.width, source.decimal[1])
        return v - v % t.width
    if t.name == "hour":
        return micros(v) // HOUR_US
    d = v if source.name == "date" else dt.date(1970, 1, 1) + dt.timedelta(days=micros(v) // DAY_US)
    return {"year": d.year - 1970, "month": 12 * (d.year - 1970) + d.month - 1, "day": days(d)}[t.name]
