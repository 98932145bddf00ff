"""Single values: JSON form, binary form (bounds), and the form they take in Avro tuples."""

from __future__ import annotations

import datetime as dt
import struct
import uuid
from decimal import Context, Decimal

from ..core.errors import InvalidData
from .types import ListOf, MapOf, Primitive, Struct, Type

EPOCH = dt.date(1970, 1, 1)
_NAIVE = dt.datetime(1970, 1, 1)
_UTC = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
_US = dt.timedelta(microseconds=1)


def days(d: dt.date) -> int:
    return (d - EPOCH).days


def micros(t: dt.datetime) -> int:
    return (t - (_UTC if t.tzinfo else _NAIVE)) // _US


def time_micros(t: dt.time) -> int:
    return ((t.hour * 60 + t.minute) * 60 + t.second) * 1_000_000 + t.microsecond


def from_micros(us: int, zoned: bool) -> dt.datetime:
    return (_UTC if zoned else _NAIVE) + us * _US


def micros_time(us: int) -> dt.time:
    return (dt.datetime.min + us * _US).time()


_EXACT = Context(prec=100)  # the default context would round the longest decimals


def unscaled(d: Decimal, scale: int) -> int:
    return int(_EXACT.scaleb(d, scale).to_integral_exact(context=_EXACT))


def scaled(n: int, scale: int) -> Decimal:
    return _EXACT.scaleb(Decimal(n), -scale)


def twos_complement(n: int) -> bytes:
    """The shortest big-endian form with a sign."""
    return n.to_bytes((n + (n < 0)).bit_length() // 8 + 1, "big", signed=True)


def decimal_width(precision: int) -> int:
    """Bytes that hold any unscaled value of the precision."""
    return len(twos_complement(10**precision - 1))


def value_to_json(t: Type, v):
    if v is None:
        return None
    if isinstance(t, Struct):
        return {str(f.id): value_to_json(f.type, v.get(f.name)) for f in t.fields}
    if isinstance(t, ListOf):
        return [value_to_json(t.element, x) for x in v]
    if isinstance(t, MapOf):
        return {"keys": [value_to_json(t.key, k) for k in v], "values": [value_to_json(t.value, x) for x in v.values()]}
    if t.is_decimal or t.name == "uuid":
        return str(v)
    if t.name == "date":
        return v.isoformat()
    if t.name == "time":
        return v.isoformat("microseconds")
    if t.name == "timestamp":
        return v.isoformat("T", "microseconds")
    if t.name == "timestamptz":
        return v.astimezone(dt.timezone.utc).isoformat("T", "microseconds")
    if t.name == "binary" or t.fixed_length is not None:
        return v.hex()
    return v


def value_from_json(t: Type, j):
    if j is None:
        return None
    try:
        if isinstance(t, Struct):
            return {f.name: value_from_json(f.type, j.get(str(f.id))) for f in t.fields}
        if isinstance(t, ListOf):
            return [value_from_json(t.element, x) for x in j]
        if isinstance(t, MapOf):
            return {value_from_json(t.key, k): value_from_json(t.value, x) for k, x in zip(j["keys"], j["values"], strict=True)}
        if t.is_decimal:
            return Decimal(j)
        if t.name == "uuid":
            return uuid.UUID(j)
        if t.name == "date":
            return dt.date.fromisoformat(j)
        if t.name == "time":
            return dt.time.fromisoformat(j)
        if t.name == "timestamp":
            return dt.datetime.fromisoformat(j)
        if t.name == "timestamptz":
            return dt.datetime.fromisoformat(j).astimezone(dt.timezone.utc)
        if t.name == "binary" or t.fixed_length is not None:
            value = bytes.fromhex(j)
            if t.fixed_length is not None and len(value) != t.fixed_length:
                raise InvalidData("wrong length of a fixed value", value=j)
            return value
        if t.name in ("float", "double"):
            return float(j)
        if t.name in ("int", "long") and (isinstance(j, bool) or int(j) != j):
            raise InvalidData("not a whole number", value=j)
        if t.name == "boolean" and not isinstance(j, bool) or t.name == "string" and not isinstance(j, str):
            raise InvalidData("value does not fit the type", type=t.name, value=j)
        return j
    except (ValueError, TypeError, KeyError, AttributeError) as e:
        raise InvalidData("value does not fit the type", e, type=str(t), value=j) from e


def to_avro_value(t: Primitive, v):
    """A partition value as the Avro codec writes it."""
    if v is None:
        return None
    if t.is_decimal:
        p, s = t.decimal
        return unscaled(Decimal(v), s).to_bytes(decimal_width(p), "big", signed=True)
    if t.name == "date":
        return days(v)
    if t.name == "time":
        return time_micros(v)
    if t.name in ("timestamp", "timestamptz"):
        return micros(v)
    if t.name == "uuid":
        return v.bytes if isinstance(v, uuid.UUID) else bytes(v)
    if t.name == "binary" or t.fixed_length is not None:
        return bytes(v)
    return v


def from_avro_value(t: Primitive, v):
    if v is None:
        return None
    if t.is_decimal:
        return scaled(int.from_bytes(v, "big", signed=True), t.decimal[1])
    if t.name == "date":
        return EPOCH + dt.timedelta(days=v)
    if t.name == "time":
        return micros_time(v)
    if t.name in ("timestamp", "timestamptz"):
        return from_micros(v, t.name == "timestamptz")
    if t.name == "uuid":
        return uuid.UUID(bytes=v) if isinstance(v, bytes) else uuid.UUID(v)
    return v


def to_bytes(t: Primitive, v) -> bytes | None:
    """Binary single value, as bounds store it."""
    if v is None:
        return None
    if t.is_decimal:
        return twos_complement(unscaled(Decimal(v), t.decimal[1]))
    if t.name == "string":
        return v.encode()
    if t.name == "boolean":
        return b"\x01" if v else b"\x00"
    if t.name in ("float", "double"):
        return struct.pack("<f" if t.name == "float" else "<d", v)
    raw = to_avro_value(t, v)
    if isinstance(raw, bytes):
        return raw
    return struct.pack("<i" if t.name in ("int", "date") else "<q", raw)


def from_bytes(t: Primitive, b: bytes | None):
    if b is None:
        return None
    if t.is_decimal:
        return scaled(int.from_bytes(b, "big", signed=True), t.decimal[1])
    if t.name == "string":
        return b.decode(errors="replace")
    if t.name == "boolean":
        return b != b"\x00"
    if t.name in ("float", "double"):
        return struct.unpack("<f" if len(b) == 4 else "<d", b)[0]
    if t.name in ("int", "long", "date", "time", "timestamp", "timestamptz"):
        return from_avro_value(t, struct.unpack("<i" if len(b) == 4 else "<q", b)[0])
    return from_avro_value(t, b)
