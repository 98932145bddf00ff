"""Deeply nested semi-structured records as related flat tables.

A document becomes rows of *relations*: the root is ``$``, every array of a document is a relation
of its own, named by its path. Objects inside objects stay in their row under dotted names. Each
row carries its surrogate key, its parent's key, the array's path in the parent row, and its
ordinal in the array; values of the parent that children need can be carried along, which saves a
join. The merged schema lists what any document had at each place.

A value is text with one letter before it that tells its JSON type (``KINDS``), so a string of digits
never becomes a number, and no number loses a digit.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.session import cut_table

ROOT = "$"
#: Letter before a value, and what it means. ``long`` numbers up to 2^53 are told from larger ones, because
#: only they fit into a double; an ``exact`` number fits neither 64 bits nor a double.
KINDS = {"b": "boolean", "l": "long", "L": "large long", "i": "integer of 38 digits", "d": "double", "e": "exact", "s": "string"}
_FLAT = "doc_key string, relation string, row_key string, parent_key string, array_path string, ordinal int, vals map<string,string>, carried map<string,string>"
_FLAT_ARROW = pa.schema([
    ("doc_key", pa.string()), ("relation", pa.string()), ("row_key", pa.string()), ("parent_key", pa.string()),
    ("array_path", pa.string()), ("ordinal", pa.int32()), ("vals", pa.map_(pa.string(), pa.string())), ("carried", pa.map_(pa.string(), pa.string())),
])


def _name(prefix: str, key: str) -> str:
    key = key.replace("\\", "\\\\").replace(".", "\\.")
    return f"{prefix}.{key}" if prefix else key


def exact_number(text: str):
    """A JSON number with a point or exponent: a float if that is the same number, else a decimal."""
    number = float(text)
    return number if Decimal(repr(number)) == Decimal(text) else Decimal(text)


def parse(text: str):
    return json.loads(text, parse_float=exact_number)


def _scalar(value) -> str | None:
    """A value's letter and text."""
    if value is None:
        return None
    if isinstance(value, str):
        return "s" + value
    if isinstance(value, bool):
        return "btrue" if value else "bfalse"
    if isinstance(value, int):
        size = abs(value)
        letter = "l" if size <= 2**53 else "L" if -(2**63) <= value < 2**63 else "i" if size < 10**38 else "e"
        return f"{letter}{value}"
    return f"e{value}" if isinstance(value, Decimal) else f"d{json.dumps(value)}"


def plain(c: Column) -> Column:
    """A value's text without its letter."""
    return F.substring(c, 2, (1 << 31) - 1)


def explode_document(doc_key: str, document, carry: re.Pattern | None = None) -> list[tuple]:
    """All rows of one parsed document; any depth, without recursion limits."""
    rows: list[tuple] = []
    todo = [(ROOT, ROOT, None, None, 0, document, None)]
    while todo:
        relation, row_key, parent_key, array_path, ordinal, value, carried = todo.pop()
        vals: list[tuple[str, str | None]] = []
        arrays: list[tuple[str, list]] = []
        inner = [("", value)]
        while inner:
            path, item = inner.pop()
            if isinstance(item, dict):
                inner.extend((_name(path, k), v) for k, v in item.items())
            elif isinstance(item, list):
                arrays.append((path, item))
            else:
                vals.append((path, _scalar(item)))
        rows.append((doc_key, relation, row_key, parent_key, array_path, ordinal, vals, carried))
        down = [x for x in vals if carry.search(x[0])] if carry and arrays else None
        for path, items in arrays:
            todo.extend((f"{relation}/{path}", f"{row_key}/{path}[{i}]", row_key, path, i, v, down) for i, v in enumerate(items))
    return rows


def flatten(docs: DataFrame, key: str, document: str, carry: str | None = None) -> DataFrame:
    """Rows of all relations of all documents, see the module's text.

    Null documents give no row; text that is no JSON gives one root row whose only value, named
    ``$error``, is the text. An empty array or object gives no child row. A scalar array element's
    value is named by the empty string. ``carry`` is a pattern for names of values that a row hands
    down to its children, as their ``carried``.
    """
    pattern = re.compile(carry) if carry else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            step = 256  # documents may be large: bound the rows built at once
            for lo in range(0, batch.num_rows, step):
                rows: list[tuple] = []
                for k, t in zip(keys[lo : lo + step].to_pylist(), texts[lo : lo + step].to_pylist()):
                    if t is None:
                        continue
                    try:
                        rows += explode_document(k, parse(t), pattern)
                    except ValueError:
                        rows.append((k, ROOT, ROOT, None, None, 0, [("$error", "s" + t)], None))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, f.type) for c, f in zip(zip(*rows), _FLAT_ARROW)], schema=_FLAT_ARROW
                    )

    return docs.select(F.col(key).cast("string").alias("doc_key"), F.col(document).alias("doc")).mapInArrow(run, _FLAT)


def merged_schema(flat: DataFrame) -> DataFrame:
    """(relation, name, kinds, cells): every place of any document, which types of value were found
    there (names of ``KINDS``, in alphabetical order), and how many values; null values tell no type.

    Its size follows the number of different places, not that of documents.
    """
    names = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    cells = flat.select("relation", F.explode("vals").alias("name", "v"))
    return (
        cells.groupBy("relation", "name", F.left("v", F.lit(1)).alias("kind"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("relation", "name")
        .agg(F.array_sort(F.collect_set(names[F.col("kind")])).alias("kinds"), F.sum("n").alias("cells"))
    )


def column_type(kinds: set[str]) -> str:
    """The narrowest type that holds all values of the kinds without loss; a string where there is none."""
    if kinds == {"boolean"}:
        return "boolean"
    if kinds and kinds <= {"long", "large long"}:
        return "bigint"
    if kinds and kinds <= {"long", "large long", "integer of 38 digits"}:
        return "decimal(38,0)"
    if kinds and kinds <= {"long", "double"}:
        return "double"
    return "string"


def relation_table(flat: DataFrame, relation: str, schema: DataFrame | None = None) -> DataFrame:
    """One relation as a flat, typed table: keys, ordinal, then a column per place of the merged schema.

    A column has the narrowest type that holds every value found in it (``column_type``); strings stay
    strings, whatever they look like, and values of mixed types stay texts. The rows of the merged
    schema for one relation, its columns, are collected.
    """
    schema = merged_schema(flat) if schema is None else schema
    cols: list[Column] = []
    for name, kinds in sorted((r["name"], set(r["kinds"])) for r in schema.where(F.col("relation") == relation).collect()):
        cols.append(plain(F.col("vals")[name]).cast(column_type(kinds)).alias(name or "value"))
    return flat.where(F.col("relation") == relation).select("doc_key", "row_key", "parent_key", "ordinal", *cols)


def _column_types(kinds: Column) -> Column:
    """``column_type`` of a column of sets of kinds."""
    within = lambda *known: F.size(F.array_except(kinds, F.array(*map(F.lit, known)))) == 0
    integers = ("long", "large long")
    return (
        F.when(F.size(kinds) == 0, "string")
        .when(within("boolean"), "boolean")
        .when(within(*integers), "bigint")
        .when(within(*integers, "integer of 38 digits"), "decimal(38,0)")
        .when(within("long", "double"), "double")
        .otherwise("string")
    )


def typed_cells(flat: DataFrame, schema: DataFrame | None = None) -> DataFrame:
    """(doc_key, relation, row_key, parent_key, ordinal, name, type, value): the tables of all relations, a row per cell.

    ``name`` is the place in the row as the merged schema has it, empty for scalar elements, ``type`` the type of that
    column in ``relation_table`` and ``value`` the value's text. A JSON null is a cell without value, an absent
    member is none, and a row that has no cell gives one row without a name. One pass, however many relations and columns.
    """
    schema = merged_schema(flat) if schema is None else schema
    types = schema.select("relation", "name", _column_types(F.col("kinds")).alias("type"))
    keys = ("doc_key", "relation", "row_key", "parent_key", "ordinal")
    cells = flat.select(*keys, F.explode_outer("vals").alias("name", "v"))
    return cells.join(types, ["relation", "name"], "left").select(*keys, "name", "type", plain(F.col("v")).alias("value"))


def table_schemas(metadata: DataFrame) -> DataFrame:
    """(table_uuid, schema_id, schema_json): each schema of each lake table once.

    A schema-id means the same in all documents of a table, so of differently written copies the
    greatest text is taken. Documents or schemas without an id give no row.
    """
    each = metadata.select("table_uuid", F.explode(F.from_json("schemas_json", "array<string>")).alias("schema_json"))
    sid = F.get_json_object("schema_json", "$.schema-id").cast("int")
    return (
        each.select("table_uuid", sid.alias("schema_id"), "schema_json")
        .where(F.col("schema_id").isNotNull())
        .groupBy("table_uuid", "schema_id")
        .agg(F.max("schema_json").alias("schema_json"))
    )


def _id_name(place: Column) -> Column:
    """Name of the value that holds the field id belonging to a type at ``place`` of a field row."""
    return F.when(place == "type", F.lit("id")).otherwise(F.regexp_replace(place, r"\.(element|key|value)$", ".$1-id"))


def schema_fields(schemas: DataFrame) -> DataFrame:
    """(table_uuid, schema_id, field_id, parent_field_id, name, kind), one row per field, element,
    key and value of every schema, at any depth.

    ``kind`` is struct, list or map for nested types, otherwise the primitive type without spaces;
    the parent at the top is -1. Struct fields are rows of the array relations of ``flatten``; elements,
    keys and values are values of the row of the field that encloses them, at the places that
    the merged schema of all documents lists for the relation.
    """
    return schema_rows(schemas).where(F.col("field_id").isNotNull())


SEPARATOR = "\u0001"


def flat_schemas(schemas: DataFrame) -> DataFrame:
    """Rows of all relations of the schemas, keyed by table and schema id; ids are handed down."""
    key = F.concat_ws(SEPARATOR, "table_uuid", F.col("schema_id").cast("string"))
    return flatten(schemas.select(key.alias("k"), "schema_json"), "k", "schema_json", carry=r"(^|-)id$")


def schema_rows(schemas: DataFrame) -> DataFrame:
    """``schema_fields`` and, for each schema, one more row without a field id."""
    fields = F.col("array_path").isNull() | F.col("array_path").rlike(r"(^|\.)fields$")
    flat = cut_table(flat_schemas(schemas).where(fields).select("doc_key", "relation", "array_path", "vals", "carried"))
    v = F.col("vals")
    pattern = r"^(type(?:\.(?:element|key|value))*)\.(element|key|value)-id$"
    # Where elements, keys and values are, by relation: a merged schema is as small as the structure is.
    places = merged_schema(flat).where(F.col("name").rlike(pattern)).groupBy("relation").agg(F.collect_list("name").alias("places"))

    def kind_at(place: Column) -> Column:
        return F.regexp_replace(F.coalesce(plain(v[place]), plain(v[F.concat(place, F.lit(".type"))])), r"\s", "")

    def found(field_id: Column, parent: Column, name: Column, kind: Column) -> Column:
        return F.struct(field_id.cast("int").alias("field_id"), F.coalesce(parent.cast("int"), F.lit(-1)).alias("parent_field_id"), name.alias("name"), kind.alias("kind"))

    above = F.regexp_replace("array_path", r"\.?fields$", "")
    root = F.col("array_path").isNull()
    own = found(F.when(~root, plain(v["id"])), F.when(above != "", plain(F.col("carried")[_id_name(above)])), plain(v["name"]), kind_at(F.lit("type")))

    def part_of(place: Column) -> Column:
        owner, part = F.regexp_extract(place, pattern, 1), F.regexp_extract(place, pattern, 2)
        return found(plain(v[place]), plain(v[_id_name(owner)]), part, kind_at(F.concat_ws(".", owner, part)))

    here = F.filter(F.coalesce("places", F.array().cast("array<string>")), lambda place: v[place].isNotNull())
    each = F.explode(F.concat(F.array(own), F.transform(here, part_of)))
    parts = F.split("doc_key", SEPARATOR)
    return (
        flat.join(places, "relation", "left")
        .select(parts[0].alias("table_uuid"), parts[1].cast("int").alias("schema_id"), root.alias("root"), each.alias("f"))
        .where("root or f.field_id is not null")
        .select("table_uuid", "schema_id", "f.field_id", "f.parent_field_id", "f.name", "f.kind")
    )
