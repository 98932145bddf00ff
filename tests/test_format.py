"""Types, values, transforms, Avro and manifests: known vectors and round trips."""

import datetime as dt
import json
import struct
import uuid
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from moraine.core.config import TableConfig
from moraine.core.errors import FeatureUnsupported, InvalidData, TypeUnsupported
from moraine.format import avro
from moraine.format.manifest import DataFile, Entry, ManifestFile, decode_list, decode_manifest, describe, encode_list, encode_manifest, inherit
from moraine.format.metadata import Snapshot, TableMetadata, check_requirements, new_metadata, summarize
from moraine.format.types import Field, ListOf, MapOf, PartitionSpec, Primitive, Schema, SortField, SortOrder, Struct, Transform, evolve, from_arrow, type_from_json, type_to_json
from moraine.format.values import from_avro_value, from_bytes, to_avro_value, to_bytes, twos_complement, value_from_json, value_to_json
from moraine.functions.murmur import hash_binary, hash_decimals, hash_longs, hash_one
from moraine.functions.transforms import transform_value
from moraine.operators.scan import Predicate, may_match_bounds, may_match_partition

P = Primitive


def test_published_hash_vectors():
    assert hash_longs(np.array([34, 17486, -7])).tolist() == [2017239379, -653330422, -1703207563]
    assert hash_longs(np.array([81068000000])).tolist() == [-662762989]  # 22:31:08
    ts = dt.datetime(2017, 11, 16, 22, 31, 8)
    assert hash_longs(np.array([(ts - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)])).tolist() == [-2047944441]
    raw = pa.array([b"iceberg", bytes([0, 1, 2, 3]), uuid.UUID("f79c3e09-677c-4bbd-a479-3f349cb785e7").bytes, b""], pa.binary())
    assert hash_binary(raw).tolist() == [1210000089, -188683207, 1488055340, 0]
    assert hash_decimals(pa.array([Decimal("14.20")], pa.decimal128(9, 2))).tolist() == [-500754589]


@given(st.lists(st.integers(-(10**18), 10**18), min_size=1, max_size=20))
def test_decimal_hash_takes_the_shortest_form(numbers):
    array = pa.array([Decimal(n) for n in numbers], pa.decimal128(38, 0))
    assert hash_decimals(array).tolist() == [hash_one(twos_complement(n)) for n in numbers]
    assert all(int.from_bytes(twos_complement(n), "big", signed=True) == n for n in numbers)


@given(st.lists(st.binary(max_size=40), min_size=1, max_size=20), st.integers(0, 3))
def test_binary_hash_of_slices(values, skip):
    array = pa.array([b"x"] * skip + values, pa.binary()).slice(skip)
    assert hash_binary(array).tolist() == [hash_one(v) for v in values]


@pytest.mark.parametrize(
    ("transform", "kind", "value", "want"),
    [
        ("truncate[10]", "int", 1, 0), ("truncate[10]", "long", -1, -10), ("truncate[50]", "decimal(20,2)", Decimal("10.65"), Decimal("10.50")),
        ("truncate[50]", "decimal(20,2)", Decimal("-10.65"), Decimal("-11.00")), ("truncate[3]", "string", "iceberg", "ice"), ("truncate[5]", "string", "ab", "ab"),
        ("truncate[2]", "string", "äöü", "äö"), ("day", "timestamp", dt.datetime(1969, 12, 31, 23), -1), ("hour", "timestamp", dt.datetime(1969, 12, 31, 23), -1),
        ("day", "timestamp", dt.datetime(2022, 11, 1, 23, 30), 19297), ("year", "date", dt.date(1969, 1, 1), -1), ("month", "date", dt.date(1969, 12, 1), -1),
        ("void", "long", 5, None), ("identity", "string", "x", "x"), ("bucket[16]", "long", None, None), ("bucket[100]", "long", 34, 79),
    ],
)
def test_single_value_transforms(transform, kind, value, want):
    assert transform_value(Transform.parse(transform), value, P(kind)) == want


def test_transform_text_and_legality():
    for text in ("identity", "void", "year", "month", "day", "hour", "bucket[7]", "truncate[9]"):
        assert str(Transform.parse(text)) == text
    for text in ("bucket", "bucket[0]", "other", "truncate[-1]"):
        with pytest.raises(InvalidData):
            Transform.parse(text)
    for text, kind in (("hour", "date"), ("year", "int"), ("truncate[2]", "date"), ("bucket[2]", "double")):
        with pytest.raises(InvalidData):
            Transform.parse(text).result(P(kind))
    with pytest.raises(InvalidData):
        Transform.parse("identity").result(Struct(()))


NESTED = Schema(3, Struct((
    Field(1, "id", P("long"), True, "the key"), Field(2, "price", P("decimal(9, 2)"), initial_default=Decimal("1.50")),
    Field(3, "tags", ListOf(4, P("string"), True)), Field(5, "more", MapOf(6, P("int"), 7, Struct((Field(8, "when", P("timestamptz")), Field(9, "raw", P("fixed[4]")))))),
    Field(10, "day", P("date")), Field(11, "u", P("uuid")), Field(12, "m", MapOf(13, P("string"), 14, P("double"), True)),
)), (1,))


def test_schema_json_round_trip_and_lookup():
    again = Schema.from_json(json.loads(json.dumps(NESTED.to_json())))
    assert again == NESTED
    assert NESTED.paths[8] == ("more", "value", "when") and NESTED.highest_id == 14
    assert NESTED.find(2).type == P("decimal(9,2)")
    with pytest.raises(InvalidData):
        NESTED.find(99)
    with pytest.raises(TypeUnsupported):
        type_from_json("varchar")
    with pytest.raises(TypeUnsupported):
        P("decimal(39,2)")
    assert type_to_json(type_from_json("fixed[ 3 ]")) == "fixed[3]"


def test_arrow_round_trip():
    struct_ = pa.struct(list(NESTED.to_arrow()))
    back = from_arrow(struct_)
    assert back.by_id(3).type == ListOf(4, P("string"), True)
    assert back.by_id(5).type.value.by_id(8).type == P("timestamptz")
    assert back.by_id(11).type == P("fixed[16]")  # Arrow has no uuid
    with pytest.raises(TypeUnsupported):
        from_arrow(pa.int8())


def test_schema_evolution_keeps_ids():
    out = evolve(NESTED, 15, add=[("new", "int", 4)], drop=["u"], rename={"day": "date"}, widen={"price": "decimal(12,2)"})
    assert [f.id for f in out.fields] == [1, 2, 3, 5, 10, 12, 15] and out.struct.by_id(10).name == "date"
    for bad in ({"drop": ["nope"]}, {"widen": {"price": "decimal(12,3)"}}, {"rename": {"day": "id"}}):
        with pytest.raises(InvalidData):
            evolve(NESTED, 15, **bad)


VALUES = [
    (P("boolean"), True), (P("int"), -5), (P("long"), 1 << 40), (P("double"), 1.5), (P("date"), dt.date(1969, 5, 1)), (P("time"), dt.time(1, 2, 3, 4)),
    (P("timestamp"), dt.datetime(2020, 1, 2, 3, 4, 5, 6)), (P("timestamptz"), dt.datetime(1960, 1, 2, tzinfo=dt.timezone.utc)), (P("string"), "ä'\\"),
    (P("uuid"), uuid.UUID(int=5)), (P("binary"), b"\x00\xff"), (P("fixed[2]"), b"ab"), (P("decimal(38,10)"), Decimal("-123.0000000001")), (P("decimal(38,19)"), Decimal("-" + "1" * 19 + "." + "7" * 19)),
]


@pytest.mark.parametrize(("kind", "value"), VALUES)
def test_single_values_round_trip(kind, value):
    assert value_from_json(kind, json.loads(json.dumps(value_to_json(kind, value)))) == value
    assert from_avro_value(kind, to_avro_value(kind, value)) == value
    assert from_bytes(kind, to_bytes(kind, value)) == value
    assert value_to_json(kind, None) is None and from_avro_value(kind, None) is None and to_bytes(kind, None) is None


def test_nested_values_and_bad_values():
    t = Struct((Field(1, "a", ListOf(2, P("int"))), Field(3, "b", MapOf(4, P("date"), 5, P("string")))))
    v = {"a": [1, None], "b": {dt.date(2020, 1, 1): "x"}}
    assert value_to_json(t, v) == {"1": [1, None], "3": {"keys": ["2020-01-01"], "values": ["x"]}}
    assert value_from_json(t, value_to_json(t, v)) == v
    for kind, bad in (("int", "x"), ("boolean", 1), ("date", "2020-13-01"), ("fixed[2]", "aabbcc"), ("long", 1.5), ("uuid", "no")):
        with pytest.raises(InvalidData):
            value_from_json(P(kind), bad)


SPEC = PartitionSpec.build(NESTED, [("id", "bucket[4]"), ("price", "identity"), ("day", "month")], 2)


def test_manifest_round_trip():
    file = DataFile("s3://b/t/data/a b.parquet", 10, 100, partition={"id_bucket": 3, "price": Decimal("1.25"), "day_month": None}, column_sizes={1: 5},
                    value_counts={1: 10}, null_counts={1: 0}, lower_bounds={1: struct.pack("<q", 1)}, split_offsets=(4,), spec_id=2)
    entries = [Entry(1, file, 7), Entry(0, file, 6, 3, 3), Entry(2, file, 7, 3, 3)]
    body = encode_manifest(NESTED, SPEC, entries, False)
    info, back = decode_manifest(body)
    assert info["schema"] == NESTED and info["spec"] == SPEC and info["content"] == "data" and back == entries
    m = describe("p", len(body), 2, False, 7, 9, entries)
    assert (m.added_files, m.existing_files, m.deleted_files, m.min_sequence) == (1, 1, 1, 3)
    full = inherit(back, m)
    assert [e.sequence for e in full] == [9, 3, 3]
    assert decode_list(encode_list([m], 7, None, 9)) == [m]
    text = file.to_json(SPEC.struct(NESTED))
    assert DataFile.from_json(text, SPEC.struct(NESTED)) == file
    with pytest.raises(InvalidData):
        inherit([Entry(0, file, 7)], ManifestFile("p", 1, 0, 0, 5, 5, 7))


@given(st.lists(st.fixed_dictionaries({"a": st.none() | st.integers(-(2**62), 2**62), "b": st.text(max_size=5), "c": st.lists(st.integers(-9, 9), max_size=3), "d": st.dictionaries(st.text(max_size=3), st.binary(max_size=3), max_size=2)}), max_size=8), st.sampled_from(["null", "deflate"]))
def test_avro_container_round_trip(rows, codec):
    schema = {"type": "record", "name": "r", "fields": [
        {"name": "a", "type": ["null", "long"]}, {"name": "b", "type": "string"}, {"name": "c", "type": {"type": "array", "items": "int"}},
        {"name": "d", "type": {"type": "map", "values": "bytes"}}]}
    meta, back = avro.load(avro.dump(schema, rows, {"k": "v"}, codec, block_rows=3))
    assert back == rows and meta["k"] == "v"


def test_avro_refuses_what_is_no_container():
    with pytest.raises(InvalidData):
        avro.load(b"nope")
    with pytest.raises(FeatureUnsupported):
        avro.dump("long", [1], codec="snap")


def test_avro_schema_of_types_agrees_with_the_jvm(spark):
    text = json.dumps(avro.type_schema(NESTED.struct))
    parsed = spark.sparkContext._jvm.org.apache.avro.Schema.Parser().parse(text)
    assert parsed.getField("id").getObjectProp("field-id") == 1
    assert "adjust-to-utc" in text and '"logicalType": "map"' in text


def test_metadata_updates_and_requirements():
    m = new_metadata("/t/", NESTED, SPEC)
    assert TableMetadata(json.loads(json.dumps(m.to_json()))).to_json() == m.to_json()
    s = lambda i, seq, parent=None: {"action": "add-snapshot", "snapshot": Snapshot(i, seq, 1000 + i, "l", parent).to_json()}
    one = m.updated([s(1, 1), {"action": "set-snapshot-ref", "ref-name": "main", "snapshot-id": 1, "type": "branch"}])
    assert one.current_snapshot_id == 1 and one.last_sequence == 1 and m.current_snapshot_id is None
    tagged = one.updated([{"action": "set-snapshot-ref", "ref-name": "t", "snapshot-id": 1, "type": "tag", "max-ref-age-ms": 5}])
    assert tagged.refs["t"] == {"snapshot-id": 1, "type": "tag", "max-ref-age-ms": 5}
    for bad in (s(1, 2), s(2, 1, 1), {"action": "set-snapshot-ref", "ref-name": "x", "snapshot-id": 9}, {"action": "set-current-schema", "schema-id": 77}, {"action": "set-default-spec", "spec-id": 77}, {"action": "remove-snapshots", "snapshot-ids": [1]}, {"action": "assign-uuid", "uuid": "other"}, {"action": "upgrade-format-version", "format-version": 1}):
        with pytest.raises(InvalidData):
            one.updated([bad])
    with pytest.raises(FeatureUnsupported):
        one.updated([{"action": "dance"}])
    props = one.updated([{"action": "set-properties", "updates": {"a": "1", "b": "2"}}, {"action": "remove-properties", "removals": ["a"]}, {"action": "set-location", "location": "/u"}])
    assert props.properties == {"b": "2"} and props.location == "/u"
    order = SortOrder(4, (SortField(1, Transform("identity"), False, False),))
    sorted_ = one.updated([{"action": "add-sort-order", "sort-order": order.to_json()}, {"action": "set-default-sort-order", "sort-order-id": -1}])
    assert sorted_.sort_order == order
    good = [
        {"type": "assert-table-uuid", "uuid": one.uuid}, {"type": "assert-ref-snapshot-id", "ref": "main", "snapshot-id": 1}, {"type": "assert-ref-snapshot-id", "ref": "no", "snapshot-id": None},
        {"type": "assert-last-assigned-field-id", "last-assigned-field-id": 14}, {"type": "assert-current-schema-id", "current-schema-id": 3},
        {"type": "assert-last-assigned-partition-id", "last-assigned-partition-id": 1002}, {"type": "assert-default-spec-id", "default-spec-id": 2}, {"type": "assert-default-sort-order-id", "default-sort-order-id": 0},
    ]
    check_requirements(one, good)
    from moraine.core.errors import CommitConflict

    for r in good[:2] + good[3:]:
        key = next(k for k in r if k not in ("type", "ref"))
        with pytest.raises(CommitConflict):
            check_requirements(one, [{**r, key: "other"}])
    with pytest.raises(CommitConflict):
        check_requirements(one, [{"type": "assert-create"}])
    check_requirements(None, [{"type": "assert-create"}])


def test_old_metadata_documents_are_read():
    doc = {"format-version": 1, "table-uuid": "u", "location": "/t", "last-updated-ms": 5, "last-column-id": 1, "schema": NESTED.to_json(), "partition-spec": [], "current-snapshot-id": -1}
    m = TableMetadata(doc)
    assert m.schema == NESTED and m.current_snapshot_id is None and m.spec.unpartitioned
    with pytest.raises(FeatureUnsupported):
        TableMetadata({**doc, "format-version": 3})


def test_summary_chain():
    file = lambda content: DataFile("p", 10, 100, content)
    a = summarize([file(0)], [], None)
    b = summarize([file(1), file(2)], [], a)
    c = summarize([file(0), file(1), file(2)], [], b)
    assert (a["operation"], b["operation"], c["operation"]) == ("append", "delete", "overwrite")
    want = {"total-data-files": "2", "total-delete-files": "4", "total-records": "20", "total-position-deletes": "20", "total-equality-deletes": "20", "total-files-size": "600"}
    assert {k: c[k] for k in want} == want
    assert summarize([file(0)], [file(0)], c, replaces=True)["operation"] == "replace"


def test_config_options():
    c = TableConfig.parse({"iceberg.table.parquet_writer.compression": "zstd", "iceberg.table.datafile.rows_per_file": "7", "other": "x", "iceberg.table.parquet_writer.enable_bloom_filter": "TRUE"})
    assert (c.compression, c.rows_per_file, c.bloom_filter) == ("zstd", 7, True)
    assert c.writer_options(["a"])["maxRecordsPerFile"] == "7"
    for bad in ({"iceberg.table.nope": "1"}, {"iceberg.table.datafile.rows_per_file": "x"}, {"iceberg.table.parquet_writer.compression": "zip"}, {"iceberg.table.datafile.rows_per_file": "-1"}):
        with pytest.raises(InvalidData):
            TableConfig.parse(bad)


@given(st.integers(-50, 50), st.sampled_from(["=", "<", "<=", ">", ">=", "in"]), st.lists(st.none() | st.integers(-50, 50), min_size=1, max_size=6), st.sampled_from(["identity", "truncate[7]", "bucket[3]"]))
def test_pruning_never_loses_a_row(value, op, rows, transform):
    schema = Schema(0, Struct((Field(1, "x", P("long")),)))
    spec = PartitionSpec.build(schema, [("x", transform)])
    p = Predicate("x", op, [value] if op == "in" else value)
    known = [r for r in rows if r is not None]
    hit = {"=": lambda r: r == value, "in": lambda r: r == value, "<": lambda r: r < value, "<=": lambda r: r <= value, ">": lambda r: r > value, ">=": lambda r: r >= value}[op]
    for r in rows:
        if r is not None and hit(r):
            assert may_match_partition(p, schema, spec, {spec.fields[0].name: transform_value(spec.fields[0].transform, r, P("long"))})
    pack = lambda n: struct.pack("<q", n)
    file = DataFile("f", len(rows), 1, value_counts={1: len(rows)}, null_counts={1: len(rows) - len(known)}, lower_bounds={1: pack(min(known))} if known else {}, upper_bounds={1: pack(max(known))} if known else {})
    if any(map(hit, known)):
        assert may_match_bounds(p, schema, file)
    if not known:
        assert not may_match_bounds(p, schema, file)
