"""Schemas that drift between files: tagged-union inference.

All schemas of a table are fused by field id into one union schema. A field keeps every type it
ever had as a *branch* with a tag; records are read under the current schema, values of other
branches are converted where the conversion loses nothing and kept in their typed branch where it
would. Which alternatives appear and disappear from schema to schema is the list of changes.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from decimal import Context, Decimal, InvalidOperation

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..core.session import cut_table
from .nested import parse, schema_rows, table_schemas


def schema_steps(present: DataFrame) -> DataFrame:
    """(table_uuid, schema_id, pos, after): each schema's place in its table's order of ids, from 0, and
    the next id; ``present`` has the distinct (table_uuid, schema_id)."""
    w = W.partitionBy("table_uuid").orderBy("schema_id")
    return present.select("table_uuid", "schema_id", (F.row_number().over(w) - 1).alias("pos"), F.lead("schema_id").over(w).alias("after"))


def fuse_schemas(fields: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """(table_uuid, field_id, branches): the union schema of each table.

    ``branches`` has one entry (tag, kind, names, schema_ids, uses) per type the field ever had, ordered by
    first appearance; a field with one branch never conflicted. ``uses`` tells of each schema with
    the branch (pos, schema_id, after, name), see ``schema_steps``.
    """
    if steps is None:
        steps = schema_steps(fields.select("table_uuid", "schema_id").distinct())
    use = F.struct("pos", "schema_id", "after", "name")
    alternatives = fields.join(steps, ["table_uuid", "schema_id"]).groupBy("table_uuid", "field_id", "kind").agg(F.array_sort(F.collect_set(use)).alias("uses"))
    entry = F.struct(F.col("uses")[0]["schema_id"].alias("since"), "kind", "uses")
    listed = alternatives.groupBy("table_uuid", "field_id").agg(F.array_sort(F.collect_list(entry)).alias("b"))
    tagged = F.transform("b", lambda x, i: F.struct(
        i.alias("tag"), x["kind"].alias("kind"), F.array_sort(F.array_distinct(x["uses"]["name"])).alias("names"),
        F.array_distinct(x["uses"]["schema_id"]).alias("schema_ids"), x["uses"].alias("uses"),
    ))
    return listed.select("table_uuid", "field_id", tagged.alias("branches"))


def branch_changes(fused: DataFrame) -> DataFrame:
    """(table_uuid, schema_id, field_id, change): which alternatives appear and disappear in a union schema.

    The uses of all branches of a field are put into the order of the schemas. A field that is absent
    before a use is added there, one absent after it removed from the next schema on; where two uses
    follow each other, another name is a rename and another branch a retype. Of several fields with one
    id in one schema the last by name and type counts.
    """
    flat = F.flatten(F.transform("branches", lambda b: F.transform(b["uses"], lambda u: F.struct(
        u["pos"].alias("pos"), u["name"].alias("name"), b["tag"].alias("tag"), u["schema_id"].alias("schema_id"), u["after"].alias("after"),
    ))))
    ordered = fused.select("table_uuid", "field_id", F.array_sort(flat).alias("u"))
    once = ordered.withColumn("u", F.filter("u", lambda x, i: ~F.get("u", i + 1)["pos"].eqNullSafe(x["pos"])))

    def at(use, i):
        before, next_ = F.get("u", i - 1), F.get("u", i + 1)
        follows = F.coalesce(before["pos"] + 1 == use["pos"], F.lit(False))
        change = lambda what, schema: F.struct(schema.alias("schema_id"), F.lit(what).alias("change"))
        return F.array_compact(F.array(
            F.when((use["pos"] > 0) & ~follows, change("added", use["schema_id"])),
            F.when(use["after"].isNotNull() & ~F.coalesce(next_["pos"] == use["pos"] + 1, F.lit(False)), change("removed", use["after"])),
            F.when(follows & ~before["name"].eqNullSafe(use["name"]), change("renamed", use["schema_id"])),
            F.when(follows & (before["tag"] != use["tag"]), change("retyped", use["schema_id"])),
        ))

    each = once.select("table_uuid", "field_id", F.explode(F.flatten(F.transform("u", at))).alias("c"))
    return each.select("table_uuid", "c.schema_id", "field_id", "c.change")


def schema_changes(rows: DataFrame) -> DataFrame:
    """(table_uuid, schema_id, field_id, change): added, removed, renamed and retyped fields.

    ``rows`` as ``schema_rows`` gives them; they are fused into one union schema per table, whose
    branches tell the changes. Each schema is compared with the one with the next lower
    id present for its table; the lowest has no changes. Names are compared exactly; a nested type
    only by struct, list or map. A field renamed and retyped at once gives two rows.
    """
    rows = cut_table(rows)  # needed for the order of the schemas and for their fields
    steps = schema_steps(rows.where("field_id is null").select("table_uuid", "schema_id").distinct())
    return branch_changes(fuse_schemas(rows.where("field_id is not null"), steps))


def lake_schema_changes(metadata: DataFrame) -> DataFrame:
    return schema_changes(schema_rows(table_schemas(metadata)))


# ---------------------------------------------------------------- records under one schema


_EXACT = Context(prec=100)


def _kind(t) -> str:
    return t.replace(" ", "") if isinstance(t, str) else t["type"]


def convert_scalar(value, source: str, target: str):
    """(converted, True), or (None, False) if ``target`` cannot hold the value without loss."""
    if value is None or source == target:
        return value, True
    text = value if isinstance(value, str) else str(value) if isinstance(value, Decimal) else json.dumps(value)
    try:
        if target == "string":
            return text, True
        if target in ("int", "long"):
            number = Decimal(text)
            bits = 31 if target == "int" else 63
            if number == number.to_integral_value() and -(2**bits) <= number < 2**bits:
                return int(number), True
        elif target in ("float", "double"):
            number = float(text)
            if not math.isfinite(number):
                return (number, True) if source in ("float", "double") else (None, False)
            if target == "float":
                with np.errstate(over="ignore"):
                    number = float(str(np.float32(number)))  # the shortest text of the 32-bit number
            if math.isfinite(number) and Decimal(repr(number)) == Decimal(text):
                return number, True
        elif target.startswith("decimal"):
            precision, scale = map(int, target[8:-1].split(","))
            number = Decimal(text)
            fitted = number.quantize(Decimal(1).scaleb(-scale), context=_EXACT) if number.is_finite() else None
            if fitted == number and fitted.adjusted() < precision - scale:
                return str(fitted), True
        elif target == "boolean" and text in ("true", "false"):
            return text == "true", True
        elif target == "timestamp" and source == "date":
            return f"{text}T00:00:00", True
        elif target == "timestamptz" and source in ("date", "timestamp"):
            return (f"{text}T00:00:00" if source == "date" else text) + "+00:00", True
        elif target == "timestamp" and source == "timestamptz" and text.endswith(("+00:00", "Z")):
            return text.removesuffix("Z").removesuffix("+00:00"), True
        elif target == "date" and source.startswith("timestamp") and "T00:00:00" in text and not text[19:].strip("0.+:Z"):
            return text[:10], True
    except (InvalidOperation, ValueError, OverflowError):
        pass
    return None, False


def _member(name: str) -> str:
    """A name that no schema has, as part of a place; quoted if it could be read as an id."""
    return json.dumps(name, ensure_ascii=False) if name[:1] == '"' or name[:1].isdigit() else name


def _entry(key: str) -> str:
    """A map's key in brackets; quoted if it could end them."""
    unclear = key[:1] == '"' or "]" in key
    return f"[{json.dumps(key, ensure_ascii=False) if unclear else key}]"


def dump(value) -> str:
    """JSON text; decimals, which are numbers that no float holds, in full."""
    try:
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    except TypeError:
        pass
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(v)}" for k, v in value.items()) + "}"
    return "[" + ",".join(map(dump, value)) + "]" if isinstance(value, list) else str(value)


def convert(value, source, target, path: str, spill: dict, within: str = ""):
    """``value`` of type ``source`` as type ``target``; what does not fit goes to ``spill``.

    Fields are matched by id, so renames follow; fields the target lacks spill under their id, members
    that the schema lacks under their name. Spill keys are the place and the tag of the branch, e.g.
    ``12:decimal(9,2)``. Each list and map around a value adds the element's index or the entry's key to
    its place, e.g. ``3[0].8[k].12:int``, so every value has a key of its own. ``within`` is that
    part of the place. A map's entry whose key the target cannot hold, or holds already, spills.
    """
    if value is None:
        return None
    s, t = _kind(source), _kind(target)
    if isinstance(source, str) or isinstance(target, str) or s != t:
        if isinstance(source, str) and isinstance(target, str):
            out, fits = convert_scalar(value, s, t)
            if fits:
                return out
        spill[f"{path}:{s}"] = value
        return None
    if s == "struct":
        if not isinstance(value, dict):
            spill[f"{path}:json"] = value
            return None
        now = {f["id"]: f for f in target["fields"]}
        old = {f["name"]: f for f in source["fields"]}
        got = {}
        for name, item in value.items():
            f = old.get(name)
            if f is None:
                spill[f"{path}.{_member(name)}:json" if path else f"{_member(name)}:json"] = item
            elif f["id"] not in now:
                if item is not None:
                    spill[f"{within}{f['id']}:{_kind(f['type'])}"] = item
            else:
                got[f["id"]] = convert(item, f["type"], now[f["id"]]["type"], f"{within}{f['id']}", spill, within)
        return {f["name"]: got[f["id"]] if f["id"] in got else f.get("initial-default") for f in target["fields"]}
    if not isinstance(value, list if s == "list" else dict):
        spill[f"{path}:json"] = value
        return None
    if s == "list":
        places = [f"{within}{target['element-id']}[{i}]" for i in range(len(value))]
        return [convert(x, source["element"], target["element"], place, spill, f"{place}.") for x, place in zip(value, places)]
    got = {}
    for k, x in value.items():
        place, fits, key = f"{within}{target['value-id']}{_entry(k)}", True, k
        if isinstance(source["key"], str):
            key, fits = convert_scalar(k, _kind(source["key"]), _kind(target["key"]))
        if not fits or str(key) in got:
            spill[f"{place}:{_kind(source['value'])}"] = x
        else:
            got[str(key)] = convert(x, source["value"], target["value"], place, spill, f"{place}.")
    return got


def current_schemas(metadata: DataFrame) -> DataFrame:
    """(table_uuid, schema_id): the current schema by each table's latest document."""
    latest = F.max_by("current_schema_id", F.struct("last_updated_ms", "metadata_file"))
    return metadata.groupBy("table_uuid").agg(latest.alias("schema_id"))


def snapshot_schemas(snapshots: DataFrame, block: int = 4096) -> DataFrame:
    """(table_uuid, snapshot_id, sid): each snapshot's schema id; where it is null, that of the last
    snapshot before it, by sequence number, that has one. Null if there is none.

    The last value before is carried in two levels, over blocks of sequence numbers and within a
    block, so that one table with very many snapshots is not one task.
    """
    once = snapshots.groupBy("table_uuid", "snapshot_id").agg(F.max("sequence_number").alias("seq"), F.max("schema_id").alias("own"))
    once = once.withColumn("block", F.floor(F.coalesce("seq", F.lit(0)) / block))
    before = W.partitionBy("table_uuid").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        once.groupBy("table_uuid", "block")
        .agg(F.max_by(F.when(F.col("own").isNotNull(), F.col("own")), F.when(F.col("own").isNotNull(), F.col("seq"))).alias("last_own"))
        .select("table_uuid", "block", F.last("last_own", ignorenulls=True).over(before).alias("carry"))
    )
    within = W.partitionBy("table_uuid", "block").orderBy("seq", "snapshot_id").rowsBetween(W.unboundedPreceding, 0)
    here = once.withColumn("here", F.last("own", ignorenulls=True).over(within))
    return here.join(carried, ["table_uuid", "block"]).select("table_uuid", "snapshot_id", F.coalesce("here", "carry").alias("sid"))


def _without_defaults(t):
    """A type in which no field has an initial default, at any depth."""
    if isinstance(t, dict):
        return {k: _without_defaults(v) for k, v in t.items() if k != "initial-default"}
    return [_without_defaults(x) for x in t] if isinstance(t, list) else t


def unified_records(records: DataFrame, metadata: DataFrame, entries: DataFrame, snapshots: DataFrame, fill: bool = True) -> DataFrame:
    """(table_uuid, file_path, row_pos, payload, branches): all records under their table's current schema.

    ``payload`` is JSON by the current names, in the current order, absent members null or, with
    ``fill``, at their initial default. ``branches`` maps place and type to values that the current type cannot
    hold, or whose field is gone; null where there is none. A record without a schema id takes its
    file's snapshot's (see ``snapshot_schemas``), else the current one. A record counts once if it is
    repeated in all its columns; records that differ in any, also at one position, are all kept. A record whose payload is
    null or no JSON object, or whose schema is unknown, keeps its text in branch ``$raw``.
    """
    schemas = table_schemas(metadata)
    cur = current_schemas(metadata)
    target = cur.join(schemas, ["table_uuid", "schema_id"], "left").select("table_uuid", F.col("schema_id").alias("cur_id"), F.col("schema_json").alias("target"))
    by_file = (
        entries.where("file_path is not null")
        .select("table_uuid", "file_path", F.coalesce("snapshot_id", "added_snapshot_id").alias("snapshot_id"), (F.col("status") == 1).alias("adds"))
        .join(snapshot_schemas(snapshots), ["table_uuid", "snapshot_id"])
        .groupBy("table_uuid", "file_path")
        .agg(F.max_by("sid", F.struct("adds", "sid")).alias("file_schema"))
    )
    once = records.select("table_uuid", "file_path", "row_pos", F.col("schema_id").cast("bigint").alias("schema_id"), "payload").dropDuplicates()
    plans = schemas.join(target, "table_uuid").select("table_uuid", F.col("schema_id").cast("bigint").alias("schema_id"), F.col("schema_json").alias("source"), "target")
    sure = once.join(by_file, ["table_uuid", "file_path"], "left").join(cur.select("table_uuid", F.col("schema_id").alias("cur_id")), "table_uuid", "left")
    sure = sure.select("table_uuid", "file_path", "row_pos", F.coalesce("schema_id", "file_schema", "cur_id").cast("bigint").alias("schema_id"), "payload")
    ready = sure.join(plans, ["table_uuid", "schema_id"], "left").select("table_uuid", "file_path", "row_pos", "payload", "source", "target")
    schema = "table_uuid string, file_path string, row_pos bigint, payload string, branches map<string,string>"
    arrow = pa.schema([("table_uuid", pa.string()), ("file_path", pa.string()), ("row_pos", pa.int64()), ("payload", pa.string()), ("branches", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, object] = {}

        def schema_of(text):
            if text not in parsed:
                if len(parsed) > 2000:
                    parsed.clear()
                parsed[text] = json.loads(text) if fill else _without_defaults(json.loads(text))
            return parsed[text]

        for batch in batches:
            out, odd = [], []
            for text, source, target_ in zip(*(batch.column(c).to_pylist() for c in ("payload", "source", "target"))):
                spill: dict = {}
                try:
                    value = parse(text) if text is not None else None
                except ValueError:
                    value = None
                if not isinstance(value, dict) or source is None or target_ is None:
                    out.append(None)
                    odd.append(None if text is None else [("$raw", text)])
                    continue
                s, t = ({"type": "struct", "fields": schema_of(x)["fields"]} for x in (source, target_))
                out.append(dump(convert(value, s, t, "", spill)))
                odd.append([(k, v if isinstance(v, str) else dump(v)) for k, v in spill.items()] or None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("table_uuid"), batch.column("file_path"), batch.column("row_pos").cast(pa.int64()), pa.array(out, pa.string()), pa.array(odd, arrow.field("branches").type)],
                schema=arrow,
            )

    return ready.mapInArrow(run, schema)
