"""Typed schemas with stable field ids, partition specs and sort orders, and their JSON."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import types as T

from ..core.errors import InvalidData, TypeUnsupported

FIELD_ID = "parquet.field.id"
PRIMITIVES = ("boolean", "int", "long", "float", "double", "date", "time", "timestamp", "timestamptz", "string", "uuid", "binary")
_DECIMAL = re.compile(r"decimal\(\s*(\d+)\s*,\s*(\d+)\s*\)$")
_FIXED = re.compile(r"fixed\[\s*(\d+)\s*\]$")


@dataclass(frozen=True)
class Primitive:
    name: str

    def __post_init__(self):
        name = self.name.strip()
        if m := _DECIMAL.match(name):
            p, s = int(m[1]), int(m[2])
            if not 1 <= p <= 38 or s > p:
                raise TypeUnsupported("decimal out of range", type=name)
            name = f"decimal({p},{s})"
        elif m := _FIXED.match(name):
            name = f"fixed[{int(m[1])}]"
        elif name not in PRIMITIVES:
            raise TypeUnsupported("unknown type", type=name)
        object.__setattr__(self, "name", name)

    @property
    def is_decimal(self) -> bool:
        return self.name.startswith("decimal")

    @property
    def decimal(self) -> tuple[int, int]:
        m = _DECIMAL.match(self.name)
        return int(m[1]), int(m[2])

    @property
    def fixed_length(self) -> int | None:
        m = _FIXED.match(self.name)
        return int(m[1]) if m else None

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Field:
    id: int
    name: str
    type: Type
    required: bool = False
    doc: str | None = None
    initial_default: object = None
    write_default: object = None


@dataclass(frozen=True)
class Struct:
    fields: tuple[Field, ...]

    def by_id(self, field_id: int) -> Field | None:
        return next((f for f in self.fields if f.id == field_id), None)

    def by_name(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)


@dataclass(frozen=True)
class ListOf:
    element_id: int
    element: Type
    element_required: bool = False


@dataclass(frozen=True)
class MapOf:
    key_id: int
    key: Type
    value_id: int
    value: Type
    value_required: bool = False


Type = Primitive | Struct | ListOf | MapOf


def type_from_json(j) -> Type:
    if isinstance(j, str):
        return Primitive(j)
    kind = j.get("type")
    if kind == "struct":
        return Struct(tuple(field_from_json(f) for f in j["fields"]))
    if kind == "list":
        return ListOf(j["element-id"], type_from_json(j["element"]), j.get("element-required", False))
    if kind == "map":
        return MapOf(j["key-id"], type_from_json(j["key"]), j["value-id"], type_from_json(j["value"]), j.get("value-required", False))
    raise TypeUnsupported("unknown nested type", type=kind)


def type_to_json(t: Type):
    if isinstance(t, Primitive):
        return t.name
    if isinstance(t, Struct):
        return {"type": "struct", "fields": [field_to_json(f) for f in t.fields]}
    if isinstance(t, ListOf):
        return {"type": "list", "element-id": t.element_id, "element": type_to_json(t.element), "element-required": t.element_required}
    return {
        "type": "map", "key-id": t.key_id, "key": type_to_json(t.key),
        "value-id": t.value_id, "value": type_to_json(t.value), "value-required": t.value_required,
    }


def field_from_json(j: dict) -> Field:
    from .values import value_from_json

    t = type_from_json(j["type"])
    default = lambda k: value_from_json(t, j[k]) if j.get(k) is not None else None
    return Field(j["id"], j["name"], t, j.get("required", False), j.get("doc"), default("initial-default"), default("write-default"))


def field_to_json(f: Field) -> dict:
    from .values import value_to_json

    out = {"id": f.id, "name": f.name, "required": f.required, "type": type_to_json(f.type)}
    if f.doc is not None:
        out["doc"] = f.doc
    for key, value in (("initial-default", f.initial_default), ("write-default", f.write_default)):
        if value is not None:
            out[key] = value_to_json(f.type, value)
    return out


@dataclass(frozen=True)
class Schema:
    schema_id: int
    struct: Struct
    identifier_ids: tuple[int, ...] = ()

    @staticmethod
    def from_json(j: dict) -> Schema:
        return Schema(j.get("schema-id", 0), Struct(tuple(field_from_json(f) for f in j["fields"])), tuple(j.get("identifier-field-ids") or ()))

    def to_json(self) -> dict:
        out = {"type": "struct", "schema-id": self.schema_id, "fields": [field_to_json(f) for f in self.struct.fields]}
        if self.identifier_ids:
            out["identifier-field-ids"] = list(self.identifier_ids)
        return out

    @property
    def fields(self) -> tuple[Field, ...]:
        return self.struct.fields

    @cached_property
    def paths(self) -> dict[int, tuple[str, ...]]:
        """Field id to name path, down through structs, elements, keys and values."""
        out: dict[int, tuple[str, ...]] = {}

        def walk(t: Type, path: tuple[str, ...]) -> None:
            if isinstance(t, Struct):
                for f in t.fields:
                    out[f.id] = (*path, f.name)
                    walk(f.type, out[f.id])
            elif isinstance(t, ListOf):
                out[t.element_id] = (*path, "element")
                walk(t.element, out[t.element_id])
            elif isinstance(t, MapOf):
                out[t.key_id], out[t.value_id] = (*path, "key"), (*path, "value")
                walk(t.key, out[t.key_id])
                walk(t.value, out[t.value_id])

        walk(self.struct, ())
        return out

    @property
    def highest_id(self) -> int:
        return max(self.paths, default=0)

    def find(self, field_id: int) -> Field:
        """A field by id, at the top or inside structs."""
        todo = list(self.fields)
        while todo:
            f = todo.pop()
            if f.id == field_id:
                return f
            if isinstance(f.type, Struct):
                todo.extend(f.type.fields)
        raise InvalidData("no such field", field_id=field_id)

    def column_path(self, field_id: int) -> str:
        self.find(field_id)
        return ".".join(f"`{p}`" for p in self.paths[field_id])

    def to_spark(self, only: list[str] | None = None) -> T.StructType:
        fields = self.fields if only is None else [self.struct.by_name(n) for n in only]
        return T.StructType([_spark_field(f) for f in fields])

    def to_arrow(self):
        import pyarrow as pa

        return pa.schema([arrow_field(f) for f in self.fields])


def _spark_field(f: Field) -> T.StructField:
    return T.StructField(f.name, to_spark(f.type), not f.required, {FIELD_ID: f.id})


def to_spark(t: Type) -> T.DataType:
    if isinstance(t, Struct):
        return T.StructType([_spark_field(f) for f in t.fields])
    if isinstance(t, ListOf):
        return T.ArrayType(to_spark(t.element), not t.element_required)
    if isinstance(t, MapOf):
        return T.MapType(to_spark(t.key), to_spark(t.value), not t.value_required)
    if t.is_decimal:
        return T.DecimalType(*t.decimal)
    if t.fixed_length is not None:
        return T.BinaryType()
    simple = {
        "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(),
        "date": T.DateType(), "timestamp": T.TimestampNTZType(), "timestamptz": T.TimestampType(), "string": T.StringType(),
        "uuid": T.BinaryType(), "binary": T.BinaryType(),
    }
    if t.name == "time":
        if not hasattr(T, "TimeType"):
            raise TypeUnsupported("time needs a Spark with TimeType")
        return T.TimeType(6)
    return simple[t.name]


def from_spark(schema: T.StructType, schema_id: int = 0, start: int = 1, identifiers: list[str] = ()) -> Schema:
    """A schema with fresh ids; the ids of one level come before those of the next."""
    counter = iter(range(start, 1 << 30))

    def convert(t: T.DataType) -> Type:
        if isinstance(t, T.StructType):
            ids = [next(counter) for _ in t.fields]
            return Struct(tuple(Field(i, f.name, convert(f.dataType), not f.nullable, f.metadata.get("comment")) for i, f in zip(ids, t.fields)))
        if isinstance(t, T.ArrayType):
            return ListOf(next(counter), convert(t.elementType), not t.containsNull)
        if isinstance(t, T.MapType):
            k, v = next(counter), next(counter)
            return MapOf(k, convert(t.keyType), v, convert(t.valueType), not t.valueContainsNull)
        if isinstance(t, T.DecimalType):
            return Primitive(f"decimal({t.precision},{t.scale})")
        names = {
            "boolean": "boolean", "byte": "int", "short": "int", "integer": "int", "long": "long", "float": "float", "double": "double",
            "date": "date", "timestamp": "timestamptz", "timestamp_ntz": "timestamp", "string": "string", "binary": "binary", "time": "time",
        }
        name = t.typeName().split("(")[0]
        if name not in names:
            raise TypeUnsupported("no table type for this Spark type", type=t.simpleString())
        return Primitive(names[name])

    struct = convert(schema)
    ids = tuple(struct.by_name(n).id for n in identifiers)
    return Schema(schema_id, struct, ids)


def arrow_field(f: Field):
    import pyarrow as pa

    return pa.field(f.name, to_arrow(f.type), not f.required, {"PARQUET:field_id": str(f.id)})


def to_arrow(t: Type):
    import pyarrow as pa

    if isinstance(t, Struct):
        return pa.struct([arrow_field(f) for f in t.fields])
    tagged = lambda name, i, u, required: pa.field(name, to_arrow(u), not required, {"PARQUET:field_id": str(i)})
    if isinstance(t, ListOf):
        return pa.list_(tagged("element", t.element_id, t.element, t.element_required))
    if isinstance(t, MapOf):
        return pa.map_(tagged("key", t.key_id, t.key, True), tagged("value", t.value_id, t.value, t.value_required))
    if t.is_decimal:
        return pa.decimal128(*t.decimal)
    if t.fixed_length is not None:
        return pa.binary(t.fixed_length) if t.fixed_length < 2**31 else pa.large_binary()
    return {
        "boolean": pa.bool_(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "date": pa.date32(),
        "time": pa.time64("us"), "timestamp": pa.timestamp("us"), "timestamptz": pa.timestamp("us", "+00:00"), "string": pa.string(),
        "uuid": pa.binary(16), "binary": pa.binary(),
    }[t.name]


def from_arrow(t) -> Type:
    """The table type of an Arrow type; fields need ids in their metadata."""
    import pyarrow as pa

    def field_id(f) -> int:
        meta = f.metadata or {}
        for key in (b"PARQUET:field_id", b"column_id"):
            if key in meta:
                return int(meta[key])
        raise InvalidData("Arrow field without an id", field=f.name)

    if pa.types.is_struct(t):
        return Struct(tuple(Field(field_id(f), f.name, from_arrow(f.type), not f.nullable) for f in t))
    if pa.types.is_map(t):
        return MapOf(field_id(t.key_field), from_arrow(t.key_type), field_id(t.item_field), from_arrow(t.item_type), not t.item_field.nullable)
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return ListOf(field_id(t.value_field), from_arrow(t.value_type), not t.value_field.nullable)
    if pa.types.is_decimal(t):
        return Primitive(f"decimal({t.precision},{t.scale})")
    if pa.types.is_fixed_size_binary(t):
        return Primitive(f"fixed[{t.byte_width}]")
    if pa.types.is_timestamp(t) and t.unit == "us":
        return Primitive("timestamptz" if t.tz else "timestamp")
    if pa.types.is_time64(t) and t.unit == "us":
        return Primitive("time")
    for check, name in (
        (pa.types.is_boolean, "boolean"), (pa.types.is_int32, "int"), (pa.types.is_int64, "long"), (pa.types.is_float32, "float"),
        (pa.types.is_float64, "double"), (pa.types.is_date32, "date"), (pa.types.is_string, "string"), (pa.types.is_large_string, "string"),
        (pa.types.is_binary, "binary"), (pa.types.is_large_binary, "binary"),
    ):
        if check(t):
            return Primitive(name)
    raise TypeUnsupported("no table type for this Arrow type", type=str(t))


# ---------------------------------------------------------------- transforms, specs, sort orders

_PARAMETER = re.compile(r"(bucket|truncate)\[(\d+)\]$")
_TIME_UNITS = ("year", "month", "day", "hour")


@dataclass(frozen=True)
class Transform:
    name: str
    width: int | None = None

    @staticmethod
    def parse(text: str) -> Transform:
        if m := _PARAMETER.match(text):
            if int(m[2]) <= 0:
                raise InvalidData("transform width must be positive", transform=text)
            return Transform(m[1], int(m[2]))
        if text in ("identity", "void", *_TIME_UNITS):
            return Transform(text)
        raise InvalidData("unknown transform", transform=text)

    def __str__(self) -> str:
        return self.name if self.width is None else f"{self.name}[{self.width}]"

    def result(self, source: Type) -> Primitive:
        """The transform's type; an error where it is not defined for the source."""
        if not isinstance(source, Primitive):
            raise InvalidData("transforms take primitive values", transform=str(self))
        name = source.name
        allowed = {
            "identity": True, "void": True,
            "year": name in ("date", "timestamp", "timestamptz"), "month": name in ("date", "timestamp", "timestamptz"),
            "day": name in ("date", "timestamp", "timestamptz"), "hour": name in ("timestamp", "timestamptz"),
            "bucket": source.is_decimal or source.fixed_length is not None
            or name in ("int", "long", "date", "time", "timestamp", "timestamptz", "string", "uuid", "binary"),
            "truncate": source.is_decimal or name in ("int", "long", "string"),
        }[self.name]
        if not allowed:
            raise InvalidData("transform not defined for type", transform=str(self), type=name)
        return source if self.name in ("identity", "truncate") else Primitive("int")


@dataclass(frozen=True)
class PartitionField:
    source_id: int
    field_id: int
    name: str
    transform: Transform


@dataclass(frozen=True)
class PartitionSpec:
    spec_id: int = 0
    fields: tuple[PartitionField, ...] = ()

    @staticmethod
    def from_json(j: dict) -> PartitionSpec:
        return PartitionSpec(j["spec-id"], tuple(
            PartitionField(f["source-id"], f.get("field-id", 1000 + i), f["name"], Transform.parse(f["transform"])) for i, f in enumerate(j["fields"])
        ))

    def to_json(self) -> dict:
        return {"spec-id": self.spec_id, "fields": [
            {"source-id": f.source_id, "field-id": f.field_id, "name": f.name, "transform": str(f.transform)} for f in self.fields
        ]}

    @property
    def unpartitioned(self) -> bool:
        return all(f.transform.name == "void" for f in self.fields)

    def struct(self, schema: Schema) -> Struct:
        """The partition type: one optional field per partition field."""
        return Struct(tuple(Field(f.field_id, f.name, f.transform.result(schema.find(f.source_id).type)) for f in self.fields))

    @staticmethod
    def build(schema: Schema, fields: list[tuple[str, str] | str], spec_id: int = 0) -> PartitionSpec:
        """From names like ``"city"`` or pairs like ``("ts", "day")``."""
        out = []
        for i, item in enumerate(fields):
            column, text = (item, "identity") if isinstance(item, str) else item
            source = schema.struct.by_name(column)
            if source is None:
                raise InvalidData("no such column", column=column)
            transform = Transform.parse(text)
            transform.result(source.type)
            name = column if transform.name == "identity" else f"{column}_{transform.name if transform.name != 'truncate' else 'trunc'}"
            out.append(PartitionField(source.id, 1000 + i, name, transform))
        return PartitionSpec(spec_id, tuple(out))


@dataclass(frozen=True)
class SortField:
    source_id: int
    transform: Transform
    ascending: bool = True
    nulls_first: bool = True


@dataclass(frozen=True)
class SortOrder:
    order_id: int = 0
    fields: tuple[SortField, ...] = field(default_factory=tuple)

    @staticmethod
    def from_json(j: dict) -> SortOrder:
        return SortOrder(j["order-id"], tuple(
            SortField(f["source-id"], Transform.parse(f["transform"]), f["direction"] == "asc", f["null-order"] == "nulls-first") for f in j["fields"]
        ))

    def to_json(self) -> dict:
        return {"order-id": self.order_id, "fields": [
            {"transform": str(f.transform), "source-id": f.source_id, "direction": "asc" if f.ascending else "desc",
             "null-order": "nulls-first" if f.nulls_first else "nulls-last"} for f in self.fields
        ]}


def evolve(schema: Schema, next_id: int, add=(), drop=(), rename=None, widen=None, make_optional=()) -> Schema:
    """A schema with columns added (name, type, default), dropped, renamed, widened or made optional.

    Ids of columns that stay do not change and ids of dropped ones are never used again.
    """
    rename, widen = rename or {}, widen or {}
    for name in (*drop, *rename, *widen, *make_optional):
        if schema.struct.by_name(name) is None:
            raise InvalidData("no such column", column=name)
    out = []
    for f in schema.fields:
        if f.name in drop:
            continue
        t = f.type
        if f.name in widen:
            t = Primitive(widen[f.name])
            if not promotable(f.type, t):
                raise InvalidData("type cannot be widened so", column=f.name, old=str(f.type), new=str(t))
        out.append(replace(f, name=rename.get(f.name, f.name), type=t, required=f.required and f.name not in make_optional))
    for name, t, *default in add:
        out.append(Field(next_id, name, Primitive(t) if isinstance(t, str) else t, False, None, *(default * 2)))
        next_id += 1
    names = [f.name for f in out]
    if len(set(names)) != len(names):
        raise InvalidData("column names clash", names=names)
    return Schema(schema.schema_id + 1, Struct(tuple(out)), tuple(i for i in schema.identifier_ids if any(f.id == i for f in out)))


def promotable(old: Type, new: Type) -> bool:
    if old == new:
        return True
    if not (isinstance(old, Primitive) and isinstance(new, Primitive)):
        return False
    if old.is_decimal and new.is_decimal:
        return old.decimal[1] == new.decimal[1] and old.decimal[0] <= new.decimal[0]
    return (old.name, new.name) in (("int", "long"), ("float", "double"))


def nested_fields(t: Type) -> Iterator[Field]:
    if isinstance(t, Struct):
        for f in t.fields:
            yield f
            yield from nested_fields(f.type)
    elif isinstance(t, ListOf):
        yield from nested_fields(t.element)
    elif isinstance(t, MapOf):
        yield from nested_fields(t.key)
        yield from nested_fields(t.value)
