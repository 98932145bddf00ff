"""Tables end to end: catalogs, scans, writers, row-level changes, commits, streams."""

import datetime as dt
import json
import random
import threading
import uuid
from decimal import Decimal
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moraine.core.config import TableConfig
from moraine.core.errors import AlreadyExists, CommitConflict, FeatureUnsupported, InvalidData, NotFound
from moraine.core.storage import Storage
from moraine.format.metadata import check_requirements, new_metadata
from moraine.format.types import PartitionSpec, Transform, from_spark
from moraine.functions.paths import canonical_path, canonical_path_text
from moraine.functions.transforms import hash_column, transform_column
from moraine.format.types import Primitive
from moraine.operators.write import FileWriter, footer
from moraine.sources.catalog import MeteredCatalog, RestCatalog, StorageCatalog, TableIdentifier, load_catalog, load_table_by_path
from moraine.sources.table import Table
from moraine.streaming.sink import TableSink

SHAPE = "id long not null, v_int int, v_double double, v_varchar string, v_bool boolean, v_date date, v_timestamp timestamp, v_decimal decimal(36,10), v_ts_ntz timestamp_ntz, l array<int>, s struct<a:int,b:string>"


def sample(spark, n=5):
    rows = [(i, i if i != 3 else None, i * 1.1, f"{i}-ä-{i}", i % 2 == 0, dt.date(2022, 11, i), dt.datetime(2022, 11, i, 23, 30, 2, 123456), Decimal(f"389.{i}1111"), dt.datetime(1969, 12, 31, 23, i), [i, None], (i, None)) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, SHAPE)


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.fixture
def catalog(spark, tmp_path):
    return StorageCatalog(spark, str(tmp_path / "warehouse with space"))


def make(catalog, df, parts=(), name="db.t"):
    schema = from_spark(df.schema)
    return catalog.create_table(name, schema, PartitionSpec.build(schema, list(parts)))


LAYOUTS = [
    [], ["v_int", "v_varchar", "v_bool", "v_date", "v_timestamp", "v_decimal", "v_ts_ntz", "v_double"],
    [("v_date", "year"), ("v_timestamp", "month"), ("v_ts_ntz", "day")], [("v_timestamp", "hour"), ("v_ts_ntz", "hour")],
    [("v_int", "bucket[10]"), ("id", "bucket[20]"), ("v_varchar", "bucket[50]"), ("v_date", "bucket[70]"), ("v_timestamp", "bucket[80]"), ("v_decimal", "bucket[90]"), ("v_ts_ntz", "bucket[100]")],
    [("v_int", "truncate[10]"), ("id", "truncate[30]"), ("v_varchar", "truncate[5]"), ("v_decimal", "truncate[40]")], [("v_bool", "void")],
]


@pytest.mark.parametrize("parts", LAYOUTS)
def test_append_and_scan_all_layouts(spark, catalog, parts):
    df = sample(spark)
    table = make(catalog, df, parts)
    assert table.to_df().count() == 0 and table.to_df().columns == df.columns  # no snapshot yet
    table.append(df)
    table = catalog.load_table("db.t")
    assert rows_of(table.to_df()) == rows_of(df)
    assert sum(f.record_count for f in table.data_files()) == 5
    if parts:
        assert table.partitions_df().agg(F.sum("record_count")).first()[0] == 5
        f = table.data_files()[0]
        assert rows_of(table.new_scan().with_partition_value(f.partition).to_df()).__len__() >= f.record_count


def test_transform_columns_match_single_values(spark):
    from moraine.functions.transforms import transform_value

    df = sample(spark).unionByName(spark.createDataFrame([(9,) + (None,) * 10], SHAPE))
    cases = [(c, t, k) for c, k in (("id", "long"), ("v_int", "int"), ("v_varchar", "string"), ("v_date", "date"), ("v_timestamp", "timestamptz"), ("v_decimal", "decimal(36,10)"), ("v_ts_ntz", "timestamp"))
             for t in ("identity", "void", "bucket[13]", "truncate[3]", "year", "month", "day", "hour")]
    legal = []
    for c, t, k in cases:
        try:
            Transform.parse(t).result(Primitive(k))
            legal.append((c, Transform.parse(t), Primitive(k)))
        except InvalidData:
            pass
    got = df.select("*", *(transform_column(t, F.col(c), k).alias(f"x{i}") for i, (c, t, k) in enumerate(legal))).collect()
    for row in got:
        for i, (c, t, k) in enumerate(legal):
            v = row[c]
            if k.name == "timestamptz" and v is not None:
                v = v.replace(tzinfo=dt.timezone.utc) if t.name != "identity" else v
            assert row[f"x{i}"] == transform_value(t, v, k), (c, t)
    wide = spark.createDataFrame([(Decimal("-" + "1" * 19 + "." + "1" * 19),), (None,)], "d decimal(38,19)")
    t, k = Transform.parse("truncate[7]"), Primitive("decimal(38,19)")
    assert [tuple(r) for r in wide.select("d", transform_column(t, F.col("d"), k)).collect()] == [(r.d, transform_value(t, r.d, k)) for r in wide.collect()]
    assert df.where("id = 9").select(hash_column(F.col("v_varchar"), Primitive("string"))).first()[0] is None


def test_catalog_operations(spark, catalog, tmp_path):
    df = sample(spark)
    table = make(catalog, df)
    with pytest.raises(AlreadyExists):
        make(catalog, df)
    assert catalog.list_tables("db") == [TableIdentifier("db.t")] and catalog.list_tables("none") == []
    assert catalog.table_exists("db.t") and not catalog.table_exists("db.u")
    catalog.rename_table("db.t", "db.u")
    assert catalog.load_table("db.u").location.endswith("db/u")
    with pytest.raises(NotFound):
        catalog.load_table("db.t")
    assert load_table_by_path(spark, catalog.location("db.u")).metadata.uuid == table.metadata.uuid
    catalog.drop_table("db.u", purge=True)
    assert not catalog.table_exists("db.u")
    with pytest.raises(NotFound):
        catalog.drop_table("db.u")
    for bad in ("", [], "a..b"):
        with pytest.raises(InvalidData):
            TableIdentifier(bad)


def test_metadata_versions_are_numeric_and_the_hint_may_lag(spark, catalog):
    table = make(catalog, sample(spark))
    for i in range(11):
        table.set_properties(n=str(i))
    folder = catalog.location("db.t") + "/metadata"
    storage = Storage(spark)
    for hint in (b" 3 \n", b"junk", None):
        if hint is None:
            storage.delete(folder + "/version-hint.text")
        else:
            storage.replace(folder + "/version-hint.text", hint)
        loaded = catalog.load_table("db.t")
        assert loaded.version == 12 and loaded.metadata.properties["n"] == "10"
    assert len(loaded.metadata.metadata_log) == 11


def test_load_catalog_and_options(spark, tmp_path):
    options = {"iceberg.catalog.type": "storage", "iceberg.catalog.name": "x", "iceberg.catalog.x.warehouse": str(tmp_path), "iceberg.table.datafile.rows_per_file": "2"}
    catalog = load_catalog(spark, options)
    table = make(catalog, sample(spark))
    table.append(sample(spark).coalesce(1))
    assert sorted(f.record_count for f in table.data_files()) == [1, 2, 2]  # the options reach the table, also after a commit
    for bad in ({}, {**options, "iceberg.catalog.type": "other"}, {k: v for k, v in options.items() if "warehouse" not in k}):
        with pytest.raises((InvalidData, FeatureUnsupported)):
            load_catalog(spark, bad)


def test_metered_catalog_counts(spark, catalog):
    metered = MeteredCatalog(catalog)
    df = sample(spark)
    schema = from_spark(df.schema)
    table = metered.create_table("db.t", schema)
    table.append(df)
    with pytest.raises(NotFound):
        metered.load_table("db.none")
    assert metered.counts["create_table"] == 1 and metered.counts["update_table"] == 1 and metered.failures["load_table"] == 1
    assert len(metered.seconds["load_table"]) == 1


def test_projection_time_travel_resume_and_errors(spark, catalog):
    df = spark.range(10).toDF("id").withColumn("x", F.col("id") * 2)
    table = make(catalog, df)
    table.append(df.where("id < 4").coalesce(1).sortWithinPartitions("id"))
    table.append(df.where("id >= 4").coalesce(1).sortWithinPartitions("id"))
    assert table.new_scan().select("x").to_df().columns == ["x"]
    assert table.new_scan().with_snapshot_id(1).to_df().count() == 4
    files = [e.file for e in table.new_scan().plan()[0]]
    newest = next(f for f in files if f.record_count == 6)
    position = files.index(newest)
    rest = sum(f.record_count for f in files[position:])
    assert table.new_scan().start_from("file://" + newest.path, 2).to_df().count() == rest - 2
    for bad in (lambda: table.new_scan().select("nope").to_df(), lambda: table.new_scan().with_snapshot_id(77), lambda: table.new_scan().start_from("/x").to_df(), lambda: table.new_scan().with_ref("x"), lambda: table.new_scan().where("id", "~", 1)):
        with pytest.raises(InvalidData):
            bad()


def test_predicates_prune_files_and_filter_rows(spark, catalog):
    df = spark.range(100).toDF("id").withColumn("x", F.when(F.col("id") < 90, F.col("id")))
    table = make(catalog, df, [("id", "truncate[10]")])
    table.append(df)
    scan = table.new_scan().where("id", ">=", 25).where("id", "<", 31)
    assert len(scan.plan()[0]) == 2 and scan.to_df().count() == 6
    nulls = table.new_scan().select("id").where("x", "is null")
    assert len(nulls.plan()[0]) == 1 and nulls.to_df().count() == 10 and nulls.to_df().columns == ["id"]
    assert table.new_scan().where("id", "in", [3, 99, 200]).to_df().count() == 2


def test_required_columns_and_missing_columns(spark, catalog):
    df = sample(spark)
    table = make(catalog, df)
    bad = spark.createDataFrame([(None,)], "id long")
    with pytest.raises(InvalidData):
        table.append(bad)
    with pytest.raises(InvalidData):
        table.append(df.drop("id"))
    assert table.current_snapshot() is None
    table.append(df.select("id", F.lit(1).alias("extra")))  # extra columns go, missing ones are null
    assert table.to_df().where("v_int is null").count() == 5


def test_empty_append_and_rows_per_file(spark, catalog):
    df = spark.range(10).toDF("id")
    table = make(catalog, df)
    table.append(df.where("id < 0"))
    assert table.data_files() == [] and table.to_df().count() == 0
    writer = table.new_writer(3, TableConfig(rows_per_file=4))
    files = writer.data(df.coalesce(1))
    assert sorted(f.record_count for f in files) == [2, 4, 4]
    assert all(f.path.split("/")[-1].startswith("00003-") for f in files)
    assert footer(files[0].path).value_counts == {1: files[0].record_count}


def test_precomputed_partition(spark, catalog):
    df = spark.createDataFrame([(k, k) for k in (1, 2, 3, 4, 1)], "id long, v long")
    table = make(catalog, df, ["id"])
    table.append(df.withColumn("p", F.struct("id")), partition_col="p")
    assert rows_of(table.to_df()) == rows_of(df) and len({str(f.partition) for f in table.data_files()}) == 4
    with pytest.raises(InvalidData):
        table.append(df.withColumn("p", F.struct("v")), partition_col="p")


def changes(spark, events):
    return spark.createDataFrame([(*e[1], e[0], i) for i, e in enumerate(events)], "id long, key long, value long, op int, seq long")


DELTA = "id long, key long, value long"


def test_delta_documented_cases(spark, catalog):
    empty = spark.createDataFrame([], DELTA)
    t1 = make(catalog, empty, ["id"], "s1.t1")
    ins = lambda *rows: [(1, r) for r in rows]
    dele = lambda *rows: [(2, r) for r in rows]
    t1.apply_changes(changes(spark, ins((1, 1, 1), (1, 2, 4), (1, 3, 5), (1, 2, 2), (1, 3, 3), (1, 4, 4))), "op", "seq", ["id", "key"])
    assert sorted(tuple(r) for r in t1.to_df().collect()) == [(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 4)]
    t2 = make(catalog, empty, ["id"], "s1.t2")
    t2.apply_changes(changes(spark, ins((1, 1, 1), (1, 2, 2), (1, 4, 4))), "op", "seq", ["id", "key"])
    report = t2.apply_changes(changes(spark, ins((1, 3, 3), (1, 5, 5)) + dele((1, 5, 5), (1, 4, 4))), "op", "seq", ["id", "key"])
    assert sorted(tuple(r) for r in t2.to_df().collect()) == [(1, 1, 1), (1, 2, 2), (1, 3, 3)]
    assert (report.rows, report.positions, report.keys) == (2, 1, 1)
    t3 = make(catalog, empty, [], "s1.t3")
    with pytest.raises(InvalidData):
        t3.apply_changes(changes(spark, [(3, (1, 1, 1))]), "op", "seq", ["id"])
    with pytest.raises(InvalidData):
        t3.apply_changes(changes(spark, ins((1, 1, 1), (1, 1, 2))).withColumn("seq", F.lit(1).cast("long")), "op", "seq", ["id", "key"])


def replay(calls, keys):
    """The documented rules on a Python dict: what each call writes, and what survives."""
    rows = []  # (call number, row)
    for n, events in enumerate(calls):
        mine, fresh, gone = {}, [], set()
        for op, row in events:
            k = tuple(row[i] for i in keys)
            if k in mine:
                fresh[mine.pop(k)] = None
            elif op == 2:
                gone.add(k)
            if op == 1:
                mine[k] = len(fresh)
                fresh.append(row)
        rows = [r for r in rows if tuple(r[i] for i in keys) not in gone] + [r for r in fresh if r is not None]
    return sorted(map(str, rows))


@pytest.mark.parametrize("parts,later", [([], []), (["id"], []), (["id"], [[("key", "bucket[2]")], ["id", "key"]])])
def test_random_delta_streams_equal_a_replay(spark, catalog, parts, later):
    rng = random.Random(5)
    value = lambda: rng.choice([1, 2, None])
    calls = [[(rng.choice([1, 1, 2]), (value(), rng.choice([1, 2, 3, None]), rng.randrange(100))) for _ in range(40)] for _ in range(3)]
    table = make(catalog, spark.createDataFrame([], DELTA), parts)
    for n, events in enumerate(calls):
        if n and later:
            table.update_spec(later[n - 1])
        table.apply_changes(changes(spark, events), "op", "seq", ["id", "key"])
    want = replay(calls, (0, 1))
    assert sorted(str(tuple(r)) for r in table.to_df().collect()) == want
    assert sorted(str(r[0]) for r in table.new_scan().select("value").to_df().collect()) == sorted(w.strip("()").split(", ")[2] for w in want)
    table.compact()
    assert table.delete_files() == [] and sorted(str(tuple(r)) for r in table.to_df().collect()) == want


def test_deletes_reach_only_older_rows(spark, catalog):
    df = spark.createDataFrame([(1, None), (2, 5), (None, 5)], "id long, v long")
    table = make(catalog, df)
    table.append(df)
    table.delete_where_equal(spark.createDataFrame([(None,), (7,)], "id long"), ["id"])
    table.append(df)
    assert sorted(str(r[0]) for r in table.to_df().collect()) == ["1", "1", "2", "2", "None"]
    path = next(f.path for f in table.data_files())
    before = table.to_df().count()
    table.delete_positions(spark.createDataFrame([("file://" + path, 0), (path, 0)], "file_path string, pos long"))
    assert table.to_df().count() in (before - 1, before)  # the row may have been dead already
    with pytest.raises(InvalidData):
        table.delete_positions(spark.createDataFrame([("/x", 0)], "file_path string, pos long"))


def test_position_delete_files_are_sorted_and_keep_duplicates(spark, catalog):
    table = make(catalog, spark.range(1).toDF("id"))
    given_ = [("f1", 3), ("f1", 2), ("f1", 2), ("f2", 10), ("f3", 30), ("f1", 1), ("f2", 20)]
    files = table.new_writer().position_deletes(spark.createDataFrame(given_, "file_path string, pos long"))
    rows = [tuple(r) for f in files for r in spark.read.parquet(f.path).collect()]
    assert rows == sorted(given_) and len(files) == 1 and files[0].content == 1


def test_equality_delete_files_hold_the_keys(spark, catalog):
    df = spark.createDataFrame([(1, 2, 3)], "a long, b long, c long")
    table = make(catalog, df)
    (f,) = table.new_writer().equality_deletes(df, [2, 3])
    assert spark.read.parquet(f.path).columns == ["b", "c"] and f.equality_ids == (2, 3) and f.content == 2
    with pytest.raises(InvalidData):
        table.new_writer().equality_deletes(df, [])


def test_concurrent_commits(spark, catalog):
    df = spark.range(3).toDF("id")
    a = make(catalog, df)
    b = catalog.load_table("db.t")
    a.append(df)
    b.append(df)  # an append is built again on the new state
    assert b.to_df().count() == 6 and a.refresh().to_df().count() == 6
    stale = catalog.load_table("db.t")
    a.append(df)
    with pytest.raises(CommitConflict):
        stale.overwrite(df)
    assert a.refresh().to_df().count() == 9
    with pytest.raises(InvalidData):
        a.new_transaction().remove_files("/not/there").commit()


def test_evolution_refs_rollback_and_expiry(spark, catalog):
    df = spark.createDataFrame([(1, "a")], "id int, name string")
    table = make(catalog, df)
    table.append(df)
    table.update_schema(rename={"name": "id2"}, add=[("name", "string", "old"), ("day", "date", dt.date(2020, 1, 1))], widen={"id": "long"})
    assert [tuple(r) for r in table.to_df().collect()] == [(1, "a", "old", dt.date(2020, 1, 1))]
    table.append(spark.createDataFrame([(2, "b", None, None)], "id long, id2 string, name string, day date"))
    assert sorted(tuple(map(str, r)) for r in table.to_df().collect()) == [("1", "a", "old", "2020-01-01"), ("2", "b", "None", "None")]
    assert table.new_scan().with_snapshot_id(1).to_df().columns == ["id", "name"]
    table.set_ref("keep", 1, "tag", max_ref_age_ms=5)
    assert table.metadata.refs["keep"]["max-ref-age-ms"] == 5
    table.append(spark.createDataFrame([(3, "c")], "id long, id2 string"))
    assert table.expire_snapshots(1 << 60) == [2] and set(table.metadata.snapshots) == {1, 3}
    with pytest.raises(InvalidData):
        table.rollback_to(99)
    assert table.to_df().count() == 3
    with pytest.raises(InvalidData):
        make(catalog, df, ["id"], "db.p").update_schema(drop=["id"])
    table.update_sort_order([("id", True)])
    table.append(spark.createDataFrame([(9, "z"), (4, "y")], "id long, id2 string"), sort=True)
    assert any(f.sort_order_id == 1 for f in table.data_files())


def test_table_handle(spark, catalog):
    df = sample(spark)
    table = make(catalog, df, [("v_date", "month")])
    with pytest.raises(InvalidData):
        table.data_files()
    table.append(df)
    path = table.data_files()[0].path
    assert table.absolute_path(table.relative_path("file://" + path)) == path
    with pytest.raises(InvalidData):
        table.relative_path("/elsewhere/x")
    assert table.partition_type().fields[0].name == "v_date_month" and table.arrow_schema().names == df.columns
    old, new = new_metadata("/a", table.schema), table.metadata
    old.last_updated_ms = 5
    assert Table.from_versions(spark, None, [old, new]).metadata is new
    assert Table.from_versions(spark, None, [old, new], current=5).metadata is old
    with pytest.raises(InvalidData):
        Table.from_versions(spark, None, [])
    with pytest.raises(InvalidData):
        FileWriter(spark, "/a", table.schema, table.spec, {"write.data.path": "/b"}, TableConfig())


def test_stream_batches_are_committed_once(spark, catalog):
    df = spark.range(3).toDF("id")
    table = make(catalog, df)
    sink = TableSink(table, "q")
    sink(df, 0)
    sink(df, 0)  # a repeated batch
    TableSink(catalog.load_table("db.t"), "q")(df, 1)
    TableSink(catalog.load_table("db.t"), "other")(df, 0)
    assert table.refresh().to_df().count() == 9


class Stub(BaseHTTPRequestHandler):
    tables: dict = {}

    def log_message(self, *a):
        pass

    def answer(self, code, body=None):
        data = json.dumps(body or {}).encode()
        self.send_response(code)
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):
        if self.path.startswith("/v1/config"):
            return self.answer(200, {"defaults": {"a": "server", "b": "server"}, "overrides": {"prefix": "p"}})
        if self.path == "/v1/p/namespaces/n1%1Fn2/tables":
            return self.answer(200, {"identifiers": [{"namespace": ["n1", "n2"], "name": n} for n in self.tables]})
        m = self.tables.get(self.path.rsplit("/", 1)[1])
        if m is None or "n1%1Fn2" not in self.path:
            return self.answer(404)
        self.answer(200, {"metadata-location": "x", "metadata": m.to_json()})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path.endswith("/tables"):
            from moraine.format.types import Schema

            m = new_metadata(self.server.root + "/" + body["name"], Schema.from_json(body["schema"]), PartitionSpec.from_json(body["partition-spec"]))
            self.tables[body["name"]] = m
        else:
            name = self.path.rsplit("/", 1)[1]
            m = self.tables[name]
            try:
                check_requirements(m, body["requirements"])
            except CommitConflict:
                return self.answer(409)
            m = self.tables[name] = m.updated(body["updates"])
        self.answer(200, {"metadata-location": "x", "metadata": m.to_json()})


def test_rest_catalog(spark, tmp_path):
    server = HTTPServer(("127.0.0.1", 0), Stub)
    server.root = str(tmp_path)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        catalog = load_catalog(spark, {"iceberg.catalog.type": "rest", "iceberg.catalog.name": "r", "iceberg.catalog.r.uri": f"http://127.0.0.1:{server.server_port}/", "iceberg.catalog.r.a": "user"})
        assert isinstance(catalog, RestCatalog) and catalog.settings["a"] == "user" and catalog.settings["b"] == "server"
        df = sample(spark)
        table = catalog.create_table(["n1", "n2", "t"], from_spark(df.schema))
        stale = catalog.load_table(["n1", "n2", "t"])
        table.append(df)
        assert rows_of(catalog.load_table(["n1", "n2", "t"]).to_df()) == rows_of(df)
        with pytest.raises(CommitConflict):
            stale.new_transaction().append_data_file(*table.data_files()).commit(retries=0)
        assert catalog.list_tables(("n1", "n2")) == [TableIdentifier("n1.n2.t")]
        with pytest.raises(NotFound):
            catalog.list_tables("other")
        assert not catalog.table_exists(["n1", "n2", "no"])
    finally:
        server.shutdown()


def test_canonical_paths(spark):
    given_ = ["s3a://b/x//y/./z", "s3n://b/x%20y+z", "S3://b///a", "s3://b/./a/", "/a//b/./c", "s3://b%2Dc/d", "s3://b/%zz", "", None, "gs://b/a/.", "s3://b/a.b/.c"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(given_)], "i int, p string")
    got = {r.i: r.c for r in df.select("i", canonical_path(F.col("p")).alias("c")).collect()}
    assert got == {i: canonical_path_text(p) for i, p in enumerate(given_)}
    assert got[0] == "s3://b/x/y/z" and got[1] == "s3://b/x y+z"
    assert T.StringType() == df.schema["p"].dataType


def test_uuid_fixed_and_time_columns(spark, catalog):
    import uuid

    from moraine.format.types import Field, Schema, Struct

    schema = Schema(0, Struct((Field(1, "id", Primitive("long"), True), Field(2, "u", Primitive("uuid")), Field(3, "f", Primitive("fixed[4]")), Field(4, "b", Primitive("binary")))))
    table = catalog.create_table("d.t", schema, PartitionSpec.build(schema, ["u", ("f", "bucket[4]"), "b"]))
    u = uuid.UUID("f79c3e09-677c-4bbd-a479-3f349cb785e7")
    table.append(spark.createDataFrame([(1, str(u), bytearray(b"abcd"), bytearray(b"x")), (2, None, None, None)], "id long, u string, f binary, b binary"))
    first = next(f for f in table.data_files() if f.partition["u"] is not None)
    assert first.partition["u"] == u and first.partition["b"] == b"x"
    assert [bytes(r.u) for r in table.new_scan().with_partition_value(first.partition).to_df().collect()] == [u.bytes]
    assert {None if r.partition.u is None else bytes(r.partition.u) for r in table.partitions_df().collect()} == {None, u.bytes}
    spark.conf.set("spark.sql.timeType.enabled", "true")
    try:
        timed = Schema(0, Struct((Field(1, "id", Primitive("long")), Field(2, "t", Primitive("time")))))
        table = catalog.create_table("d.u", timed, PartitionSpec.build(timed, [("t", "bucket[8]")]))
        table.append(spark.sql("SELECT 1L AS id, TIME'22:31:08' AS t UNION ALL SELECT 2L, NULL"))
        assert sorted((str(r.t), r.id) for r in table.to_df().collect()) == [("22:31:08", 1), ("None", 2)]
        assert {f.partition["t_bucket"] for f in table.data_files()} == {None, 3}
    finally:
        spark.conf.unset("spark.sql.timeType.enabled")


def test_manifests_are_pruned_and_many_entries_are_decoded_by_executors(spark, catalog, monkeypatch):
    from moraine.sources import table as table_module

    df = spark.range(100).toDF("id").withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")))
    table = make(catalog, df, [("day", "month")])
    for month in range(1, 5):
        table.append(df.where(F.month("day") == month))
    scan = table.new_scan().where("day", ">=", dt.date(2020, 3, 5))
    read = []
    original = table.storage.read
    monkeypatch.setattr(table.storage, "read", lambda uri: read.append(uri) or original(uri))
    assert scan.to_df().count() == df.where("day >= '2020-03-05'").count()
    assert sum("-m" in r.rsplit("/", 1)[1] for r in read) == 2
    here = table.entries()
    monkeypatch.setattr(table_module, "DECODE_HERE", 0)
    assert table.entries() == here and len(here) == 4


def test_filters_after_names_were_swapped(spark, catalog):
    """A pushed filter must not prune by the column that had the name when the file was written."""
    df = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") + 100_000).alias("b"), F.col("id").alias("k"))
    table = make(catalog, df)
    table.append(df)
    for step in ({"a": "c"}, {"b": "a"}, {"c": "b"}):
        table.update_schema(rename=step)
    now = table.to_df()
    assert now.where("a > 100500").count() == 499 and now.where("b < 10").count() == 10
    assert table.new_scan().where("a", ">", 100_500).to_df().count() == 499
    table.delete_where_equal(spark.createDataFrame([(100_001,)], "a long"), ["a"])
    assert table.to_df().where("b < 10").count() == 9
    plan = now.where("k < 5")._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(k,5)" in plan and "__field_1" in plan  # other columns' filters still go down
    table.update_schema(drop=["a"])
    table.update_schema(add=[("a", "string")])
    assert table.to_df().where("a = 'x'").count() == 0 and table.to_df().where("a is null").count() == 999


def test_equality_deletes_without_partition_columns_reach_all_partitions(spark, catalog):
    df = spark.range(20).withColumn("p", F.col("id") % 3).withColumn("must", F.lit(1))
    assert not df.schema["must"].nullable  # becomes a required column
    table = make(catalog, df, ["p"])
    table.append(df)
    table.delete_where_equal(spark.createDataFrame([(4,), (5,), (99,)], "id long"), ["id"])
    assert sorted(r.id for r in table.to_df().collect()) == [i for i in range(20) if i not in (4, 5)]
    table.delete_where_equal(df.where("id in (6, 7)").select("id", "p"), ["id"])
    table.append(df.where("id = 4"))
    assert sorted(r.id for r in table.to_df().collect()) == [i for i in range(20) if i not in (5, 6, 7)]
    assert table.metadata.default_spec_id == 0 and table.spec.fields
    table.compact()
    assert table.delete_files() == [] and table.to_df().count() == 17


def test_deletes_after_a_spec_change(spark, catalog):
    df = spark.range(12).select("id", (F.col("id") % 3).alias("k"), F.lit("old").alias("v"))
    table = make(catalog, df, ["k"])
    table.append(df)
    table.update_spec([("id", "bucket[4]")])
    gone = spark.createDataFrame([(1, 1, "x", 2, 1), (2, 2, "x", 2, 2)], "id long, k long, v string, op int, seq long")
    table.apply_changes(gone, "op", "seq", ["id"])
    table.delete_where_equal(spark.createDataFrame([(3,)], "id long"), ["id"])
    table.apply_changes(spark.createDataFrame([(4, None, "new", 1, 1)], "id long, k long, v string, op int, seq long"), "op", "seq", ["id"], upsert=True)
    found = sorted((r.id, r.v) for r in table.to_df().collect())
    assert found == [(0, "old"), (4, "new")] + [(i, "old") for i in range(5, 12)]
    table.compact()
    assert table.delete_files() == [] and sorted((r.id, r.v) for r in table.to_df().collect()) == found


def test_partition_of_a_delete_after_a_spec_change(spark, catalog):
    """The partition does not follow from the keys: rows of older specs are marked where the current partition is the same."""
    df = spark.createDataFrame([(1, "a", 10), (1, "b", 20), (2, "a", 30)], "id long, p string, v long")
    table = make(catalog, df, [("v", "bucket[2]")])
    table.append(df)
    table.update_spec(["p"])
    report = table.apply_changes(spark.createDataFrame([(1, "b", None, 2, 1)], "id long, p string, v long, op int, seq long"), "op", "seq", ["id"])
    assert sorted(tuple(r) for r in table.to_df().collect()) == [(1, "a", 10), (2, "a", 30)] and report.positions == 1
    table.delete_where_equal(spark.createDataFrame([(1, "a"), (2, "b")], "id long, p string"), ["id"])
    assert [tuple(r) for r in table.to_df().collect()] == [(2, "a", 30)]


TEXTS = st.lists(st.tuples(*[st.one_of(st.none(), st.text(alphabet="ab\x1f\x00:-0123", max_size=4))] * 2), min_size=1, max_size=12)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=TEXTS)
def test_partition_tuples_stay_apart(spark, catalog, rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate([("a\x1fb", "c"), ("a", "b\x1fc"), (None, ""), ("", None), *rows])], "p string, q string, i long")
    table = make(catalog, df, ["p", "q"], f"db.t{uuid.uuid4().hex}")
    table.append(df)
    want = {}
    for r in df.collect():
        want[r.p, r.q] = want.get((r.p, r.q), 0) + 1
    got = {}
    for f in table.data_files():
        got[f.partition["p"], f.partition["q"]] = got.get((f.partition["p"], f.partition["q"]), 0) + f.record_count
    assert got == want
    assert table.new_scan().with_partition_value({"p": "a\x1fb", "q": "c"}).to_df().count() == want["a\x1fb", "c"]


def test_files_are_rolled_at_the_target_size(spark, catalog):
    df = spark.range(200_000).select("id", F.xxhash64("id").alias("h"), F.md5(F.col("id").cast("string")).alias("t"))
    table = make(catalog, df)
    table.config = TableConfig(target_file_size=1_000_000)
    for _ in range(2):  # by a probe, then by what the table holds
        table.append(df.coalesce(1))
    sizes = sorted(f.size for f in table.data_files())
    assert len(sizes) > 10 and sizes[-1] < 1_300_000 and sizes[2] > 600_000
    one = table.new_writer().single(df)
    assert one.record_count == 200_000 and one.size > 5_000_000 and table.new_writer().single(df.where("id < 0")) is None


def test_compaction_rewrites_what_deletes_reach(spark, catalog):
    df = spark.range(40_000).select("id", (F.col("id") % 4).alias("k"), F.md5(F.col("id").cast("string")).alias("t"))
    table = make(catalog, df, ["k"])
    table.append(df)
    assert len(table.data_files()) == 4
    before = {f.path for f in table.data_files()}
    table.delete_where_equal(spark.createDataFrame([(2, 2)], "id long, k long"), ["id"])
    table.compact(small_bytes=1)
    assert len({f.path for f in table.data_files()} - before) == 1 and table.delete_files() == [] and table.to_df().count() == 39_999
    scan = table.new_scan()
    table.delete_where_equal(spark.createDataFrame([(50_000,)], "id long"), ["id"])  # outside all bounds
    assert scan.reached([e for e in table.live_entries() if e.file.content == 0], [e for e in table.live_entries() if e.file.content]) == set()
    for n in range(6):
        more = spark.range(100_000 + n * 2000, 102_000 + n * 2000)
        table.append(more.select("id", (F.col("id") % 4).alias("k"), F.md5(F.col("id").cast("string")).alias("t")))
    table.compact(small_bytes=1 << 20, target_bytes=300_000)
    sizes = sorted(f.size for f in table.data_files())
    assert table.to_df().count() == 39_999 + 12_000 and table.delete_files() == []
    assert all(90_000 < s < 600_000 for s in sizes) and len(sizes) <= 12


def test_writer_options_are_applied_or_refused(spark, catalog):
    df = spark.range(5000).select("id", F.md5(F.col("id").cast("string")).alias("t"))
    table = make(catalog, df)
    write = lambda **k: table.new_writer(config=TableConfig(**k)).data(df.coalesce(1))[0]
    low, high = write(compression="gzip", compression_level=1), write(compression="gzip", compression_level=9)
    assert low.size > high.size and write(write_batch_size=50, data_page_size=1000).record_count == 5000
    for refused in ({"created_by": "me"}, {"compression": "snappy", "compression_level": 3}):
        with pytest.raises(FeatureUnsupported):
            write(**refused)


def test_picked_merged_and_expired(spark, catalog):
    df = spark.range(8).select("id", (F.col("id") % 2).alias("k"))
    table = make(catalog, df, ["k"])
    table.set_properties(**{"commit.manifest.min-count-to-merge": "3"})
    for _ in range(5):
        table.append(df)
    assert len(table.manifests()) < 5 and table.to_df().count() == 40 and len(table.data_files()) == 10
    table.set_ref("side", 5, "branch")
    table.append(df, branch="side")
    table.cherry_pick(6)
    assert table.to_df().count() == 48
    for again in (6, 5):
        with pytest.raises(InvalidData):
            table.cherry_pick(again)
    table.overwrite(df)
    with pytest.raises(InvalidData):
        table.cherry_pick(table.metadata.current_snapshot_id)
    files = lambda: {n for n, _ in table.storage.listing(table.location + "/data")}
    before = files()
    table.expire_snapshots(1 << 62)
    assert files() == before
    table.append(df)
    ids = table.expire_snapshots(1 << 62, remove_files=True)
    assert ids and table.to_df().count() == 16 and table.new_scan().with_ref("side").to_df().count() == 48


def test_removed_files_are_looked_for_where_they_can_be(spark, catalog):
    df = spark.createDataFrame([(i, i % 3 if i % 4 else None) for i in range(12)], "id long, k long")
    table = make(catalog, df, ["k"])
    for k in (0, 1, 2, None):
        table.append(df.where(F.col("k").eqNullSafe(F.lit(k))))
    gone = [f for f in table.data_files() if f.partition["k"] in (1, None)]
    tx = table.new_transaction().remove(*gone)
    check = tx._may_hold(table.metadata)
    assert sorted(check(m) for m in table.manifests()) == [False, False, True, True]
    tx.commit()
    assert {r.k for r in table.to_df().collect()} == {0, 2}
    with pytest.raises(InvalidData):
        table.new_transaction().remove(*gone).commit()
