"""Queries on catalogs, metadata, files and single values: what an operation did, beside what SQL expects."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.config import TableConfig
from ..core.errors import LakeError
from ..core.session import scratch_path
from ..format.manifest import DataFile
from ..format.metadata import check_requirements
from ..format.types import PartitionSpec, Primitive, Transform, from_spark
from ..format.values import value_from_json, value_to_json
from ..functions.transforms import hash_column, transform_column, transform_value
from ..sources.catalog import MeteredCatalog, StorageCatalog, load_catalog, load_table_by_path
from .lake import build
from .lake_sql import murmur
from .pipeline import load


def _refused(action: Callable[[], object]) -> str:
    try:
        action()
        return "done"
    except LakeError as e:
        return e.kind


def _steps(spark: SparkSession, rows: list[tuple[str, object]]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "step string, outcome string")


def catalog_tables(spark: SparkSession, d: str) -> DataFrame:
    """Create, list, load, rename, register and drop tables of a storage catalog made from options."""
    root = scratch_path(spark, "warehouse")
    nation = load(spark, d, "nation")
    catalog = load_catalog(spark, {"iceberg.catalog.type": "storage", "iceberg.catalog.name": "c", "iceberg.catalog.c.warehouse": root, "iceberg.table.datafile.rows_per_file": "10"})
    schema = from_spark(nation.schema)
    catalog.create_table("db.a", schema).append(nation)
    catalog.create_table("db.b", schema)
    rows: list[tuple[str, object]] = [
        ("create again", _refused(lambda: catalog.create_table("db.a", schema))), ("tables", ",".join(map(str, catalog.list_tables("db")))), ("rows of a", catalog.load_table("db.a").to_df().count()),
        ("files of a", len(catalog.load_table("db.a").data_files())), ("rows of b", catalog.load_table("db.b").to_df().count()), ("load c", _refused(lambda: catalog.load_table("db.c"))),
        ("a exists", catalog.table_exists("db.a")), ("c exists", catalog.table_exists("db.c")), ("rows of a by path", load_table_by_path(spark, f"{root}/db/a").to_df().count()),
        ("rename a", _refused(lambda: catalog.rename_table("db.a", "db.z"))),
    ]
    catalog.rename_table("db.b", "db.c")
    catalog.register_table("db.d", catalog.load_table("db.a").metadata_path)
    rows += [("tables then", ",".join(map(str, catalog.list_tables("db")))), ("rows of d", catalog.load_table("db.d").to_df().count())]
    catalog.drop_table("db.c", purge=True)
    rows += [("tables at last", ",".join(map(str, catalog.list_tables("db")))), ("drop again", _refused(lambda: catalog.drop_table("db.c")))]
    return _steps(spark, rows)


def catalog_metered(spark: SparkSession, d: str) -> DataFrame:
    """Calls and failures that a metered catalog counts."""
    catalog = MeteredCatalog(StorageCatalog(spark, scratch_path(spark, "warehouse")))
    region = load(spark, d, "region")
    table = catalog.create_table("db.r", from_spark(region.schema))
    table.append(region)
    table.append(region)
    _refused(lambda: catalog.load_table("db.none"))
    return _steps(spark, [(f"{what} {n}", c) for n, counts in (("calls", catalog.counts), ("failures", catalog.failures)) for what, c in counts.items() if c])


def catalog_requirements(spark: SparkSession, d: str) -> DataFrame:
    """Each requirement of a commit, as it is and as it is not."""
    table = build(spark, load(spark, d, "region"))
    m = table.metadata
    held = [
        {"type": "assert-table-uuid", "uuid": m.uuid}, {"type": "assert-ref-snapshot-id", "ref": "main", "snapshot-id": 1}, {"type": "assert-last-assigned-field-id", "last-assigned-field-id": m.last_column_id},
        {"type": "assert-current-schema-id", "current-schema-id": m.current_schema_id}, {"type": "assert-last-assigned-partition-id", "last-assigned-partition-id": m.last_partition_id},
        {"type": "assert-default-spec-id", "default-spec-id": 0}, {"type": "assert-default-sort-order-id", "default-sort-order-id": m.default_sort_order_id},
    ]
    rows: list[tuple[str, object]] = [("assert-create", _refused(lambda: check_requirements(m, [{"type": "assert-create"}]))), ("assert-create without table", _refused(lambda: check_requirements(None, [{"type": "assert-create"}])))]
    for r in held:
        off = {k: v if k in ("type", "ref") else "other" if isinstance(v, str) else (v or 0) + 77 for k, v in r.items()}
        rows += [(f"{x['type']} {x is r}", _refused(lambda x=x: check_requirements(m, [x]))) for x in (r, off)]
    return _steps(spark, rows)


def table_handle(spark: SparkSession, d: str) -> DataFrame:
    """Types, paths and versions that a table handle tells."""
    table = build(spark, load(spark, d, "nation"), [("n_nationkey", "bucket[4]"), ("n_name", "truncate[2]")])
    (first, *_), inside = table.data_files(), table.absolute_path("data/x.parquet")
    rows = [
        ("partition type", " ".join(f"{f.name}:{f.type.name}" for f in table.partition_type().fields)), ("arrow", " ".join(f"{f.name}:{f.type}" for f in table.arrow_schema())),
        ("relative", table.relative_path(inside)), ("outside", _refused(lambda: table.relative_path("/elsewhere/x"))), ("versions", len(table.versions)), ("snapshot", table.current_snapshot().snapshot_id),
        ("file json", DataFile.from_json(first.to_json(table.partition_type()), table.partition_type()) == first),
    ]
    return _steps(spark, rows)


def json_values(spark: SparkSession, d: str) -> DataFrame:
    """Single values in JSON, and whether they come back."""
    values = [
        ("boolean", True), ("int", -5), ("long", 2**40), ("double", 1.5), ("date", dt.date(2017, 11, 16)), ("time", dt.time(22, 31, 8, 123456)), ("timestamp", dt.datetime(2017, 11, 16, 22, 31, 8, 123456)),
        ("timestamptz", dt.datetime(2017, 11, 16, 22, 31, 8, 123456, tzinfo=dt.timezone.utc)), ("string", "iceberg"), ("uuid", uuid.UUID("f79c3e09-677c-4bbd-a479-3f349cb785e7")),
        ("binary", b"\x00\x01\xff"), ("decimal(9,2)", Decimal("14.20")),
    ]
    rows = []
    for name, v in values:
        t = Primitive(name)
        rows.append((name, f"{json.dumps(value_to_json(t, v))} {value_from_json(t, value_to_json(t, v)) == v}"))
    return _steps(spark, rows)


def transform_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Hashes and truncations of single values of every type, as columns."""
    one = spark.range(1)
    value = lambda sql, name: (F.expr(sql), Primitive(name))
    hashes = {
        "int 34": value("34", "int"), "long 34": value("34L", "long"), "decimal 14.20": value("cast('14.20' as decimal(9,2))", "decimal(9,2)"), "date": value("date'2017-11-16'", "date"),
        "timestamp": value("timestamp_ntz'2017-11-16 22:31:08'", "timestamp"), "timestamptz": value("timestamp'2017-11-16 14:31:08-08:00'", "timestamptz"),
        "string": value("'iceberg'", "string"), "uuid": value("unhex('f79c3e09677c4bbda4793f349cb785e7')", "uuid"), "fixed": value("unhex('00010203')", "fixed[4]"), "binary": value("unhex('00010203')", "binary"),
        "null": value("cast(null as string)", "string"),
    }
    cuts = {
        "truncate int 1": (10, *value("1", "int")), "truncate int -1": (10, *value("-1", "int")), "truncate long -11": (10, *value("-11L", "long")), "truncate decimal 10.65": (50, *value("cast('10.65' as decimal(9,2))", "decimal(9,2)")),
        "truncate decimal -0.05": (10, *value("cast('-0.05' as decimal(9,2))", "decimal(9,2)")), "truncate string": (3, *value("'iceberg'", "string")), "truncate letters": (2, *value("'äöü'", "string")),
    }
    columns = {f"hash {k}": hash_column(c, t) for k, (c, t) in hashes.items()} | {k: transform_column(Transform.parse(f"truncate[{w}]"), c, t) for k, (w, c, t) in cuts.items()}
    columns["bucket time"] = F.lit(transform_value(Transform.parse("bucket[1000000]"), dt.time(22, 31, 8), Primitive("time")))
    named = [c.cast("string").alias(f"c{i}") for i, c in enumerate(columns.values())]
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("step"), F.col(f"c{i}").alias("outcome")) for i, k in enumerate(columns))))
    return one.select(*named).select(pairs.alias("p")).select("p.step", "p.outcome")


def partitions_bucket_string(spark: SparkSession, d: str) -> DataFrame:
    table = build(spark, load(spark, d, "part").withColumn("brand", F.rpad("p_brand", 8, "_")), [("brand", "bucket[8]")])
    return table.partitions_df().select(F.col("partition.brand_bucket").alias("p"), "record_count")


def partitions_truncate_decimal(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    table = build(spark, o, [("price", "truncate[5000000]")])
    return table.partitions_df().select(F.col("partition.price_trunc").alias("p"), "record_count")


def partitions_several(spark: SparkSession, d: str) -> DataFrame:
    table = build(spark, load(spark, d, "orders"), [("o_orderdate", "year"), "o_orderstatus", ("o_custkey", "bucket[4]")])
    return table.partitions_df().select("partition.o_orderdate_year", "partition.o_orderstatus", "partition.o_custkey_bucket", "record_count")


def partitions_separators(spark: SparkSession, d: str) -> DataFrame:
    """Two text columns whose values hold separators, nothing and null: each tuple is a partition of its own."""
    pick = lambda shift, *texts: F.element_at(F.array(*(F.lit(t) for t in texts)), (F.pmod(F.col("c_custkey") + shift, F.lit(len(texts))) + 1).cast("int"))
    rows = load(spark, d, "customer").select("c_custkey", pick(0, "a\x1fb", "a", None, "", "-", "1:a").alias("p"), pick(1, "c", "b\x1fc", "", None, "1:-", "").alias("q"), pick(0, "x", "y").alias("r"))
    table = build(spark, rows, ["p", "q", "r"])
    whole = table.partitions_df().select("partition.p", "partition.q", "partition.r", "record_count")
    one = table.new_scan().with_partition_value({"p": "a\x1fb", "q": "b\x1fc", "r": "x"}).to_df()
    return whole.unionByName(one.groupBy("p", "q", "r").agg((-F.count(F.lit(1))).alias("record_count")))


# ---------------------------------------------------------------- files


def append_rolled(spark: SparkSession, d: str) -> DataFrame:
    """Files of two appends under a small target size: none much larger, and few much smaller."""
    rows, target = load(spark, d, "lineitem"), 200_000
    table = build(spark, rows.limit(0))
    table.config = TableConfig(target_file_size=target)
    table.append(rows.coalesce(1))
    table.append(rows.coalesce(1))
    sizes = [f.size for f in table.data_files()]
    return spark.createDataFrame([(table.to_df().count(), max(sizes) <= 1.3 * target, sum(s < 0.5 * target for s in sizes) <= 2)], "records bigint, none_larger boolean, few_smaller boolean")


def compact_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Many small files of each partition become one or few of about the target size."""
    o, target = load(spark, d, "orders"), 100_000
    table = build(spark, [o.where(f"o_orderkey % 5 = {i}") for i in range(5)], ["o_orderstatus"])
    before = len(table.data_files())
    table.compact(small_bytes=1 << 30, target_bytes=target)
    rows = []
    for status in ("F", "O", "P"):
        files = [f for f in table.data_files() if f.partition["o_orderstatus"] == status]
        whole = sum(f.size for f in files)
        rows.append((status, sum(f.record_count for f in files), len(files) < before / 3 and all(f.size <= 2 * target for f in files) and len(files) <= max(1, 2 * whole / target)))
    return spark.createDataFrame(rows, "o_orderstatus string, records bigint, right_sizes boolean")


def compact_reached(spark: SparkSession, d: str) -> DataFrame:
    """A delete in one partition: only its file is written anew, the rows are right."""
    o = load(spark, d, "orders")
    table = build(spark, o, ["o_orderpriority"])
    before = {f.path for f in table.data_files()}
    table.delete_where_equal(o.where("o_orderpriority = '2-HIGH' and o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority"), ["o_orderkey"])
    table.compact(small_bytes=1)
    fresh = {f.partition["o_orderpriority"] for f in table.data_files() if f.path not in before}
    return table.to_df().withColumn("rewritten", F.lit(",".join(sorted(fresh)))).withColumn("deletes", F.lit(len(table.delete_files())))


def append_single(spark: SparkSession, d: str) -> DataFrame:
    """One file for each flush, whatever its size; an empty one gives none."""
    o = load(spark, d, "orders")
    table = build(spark, o.limit(0))
    files = [f for s in ("F", "O", "P", "none") if (f := table.new_writer(config=TableConfig(target_file_size=1000)).single(o.where(F.col("o_orderstatus") == s)))]
    table.new_transaction().append_data_file(*files).commit()
    return table.to_df().withColumn("files", F.lit(len(table.data_files())))


def append_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a sorted write, and whether each is where its file's order has it."""
    from pyspark.sql.window import Window as W

    table = build(spark, load(spark, d, "orders"), ["o_orderstatus"], sort=["o_orderkey"])
    rows = spark.read.parquet(*(f.path for f in table.data_files())).select("o_orderkey", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    before = F.lag("o_orderkey").over(W.partitionBy("f").orderBy("i"))
    marked = all(f.sort_order_id == table.metadata.sort_order.order_id for f in table.data_files())
    return rows.select("o_orderkey", F.coalesce(before <= F.col("o_orderkey"), F.lit(True)).alias("in_order"), F.lit(marked).alias("marked"))


def scan_elements(spark: SparkSession, d: str) -> DataFrame:
    """Every element of an array column, with its place."""
    table = build(spark, load(spark, d, "embeddings"))
    return table.new_scan().select("vec_id", "embedding").with_batch_size(512).to_df().select("vec_id", F.posexplode("embedding").alias("place", "value"))


def over_scan_top_k(spark: SparkSession, d: str) -> DataFrame:
    """The ten dearest orders; the limit is the feature."""
    return build(spark, load(spark, d, "orders")).new_scan().select("o_orderkey", "o_totalprice").to_df().orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


# ---------------------------------------------------------------- changes and history


def _changed_spec(spark: SparkSession, d: str):
    o = load(spark, d, "orders")
    table = build(spark, o, ["o_orderstatus"])
    table.update_spec([("o_orderkey", "bucket[4]")])
    return o, table


def _events(df: DataFrame, op: int) -> DataFrame:
    return df.withColumn("op", F.lit(op)).withColumn("seq", F.col("o_orderkey"))


def delta_after_spec_change(spark: SparkSession, d: str) -> DataFrame:
    o, table = _changed_spec(spark, d)
    table.apply_changes(_events(o.where("o_orderpriority < '3'"), 2), "op", "seq", ["o_orderkey"])
    return table.to_df()


def upsert_after_spec_change(spark: SparkSession, d: str) -> DataFrame:
    o, table = _changed_spec(spark, d)
    table.apply_changes(_events(o.where("o_orderpriority < '3'").withColumn("o_totalprice", F.lit(0.5)), 1), "op", "seq", ["o_orderkey"], upsert=True)
    return table.to_df()


def delete_where_equal_after_spec_change(spark: SparkSession, d: str) -> DataFrame:
    o, table = _changed_spec(spark, d)
    table.append(o.where("o_orderpriority = '1-URGENT'"))
    table.delete_where_equal(o.where("o_orderpriority < '3'").select("o_orderkey"), ["o_orderkey"])
    table.update_spec(["o_orderpriority"])  # does not follow from the key: rows are looked up
    table.delete_where_equal(o.where("o_orderpriority > '4'").select("o_orderkey", "o_orderpriority"), ["o_orderkey"])
    return table.to_df()


def cherry_pick(spark: SparkSession, d: str) -> DataFrame:
    """Rows appended on a branch come to main, once."""
    o = load(spark, d, "orders")
    table = build(spark, o.where("o_orderstatus = 'F'"))
    table.set_ref("audit", 1, "branch")
    table.append(o.where("o_orderstatus = 'O'"), branch="audit")
    table.cherry_pick(2)
    return table.to_df().withColumn("again", F.lit(_refused(lambda: table.cherry_pick(2))))


def manifests_merged(spark: SparkSession, d: str) -> DataFrame:
    """Many appends, few manifests; expired snapshots take the files with them that nobody needs."""
    o = load(spark, d, "orders")
    table = build(spark, o.limit(0))
    table.set_properties(**{"commit.manifest.min-count-to-merge": "3"})
    for i in range(6):
        table.append(o.where(f"o_orderkey % 6 = {i}"))
    table.overwrite(o.where("o_orderstatus = 'F'"))
    table.append(o.where("o_orderstatus = 'P'"))
    few = len(table.manifests()) <= 4
    table.expire_snapshots(1 << 62, keep=1, remove_files=True)
    left = sum(n.endswith(".parquet") for n, _ in table.storage.listing(f"{table.location}/data"))
    return table.to_df().withColumn("few_manifests", F.lit(few)).withColumn("only_live_files", F.lit(left == len(table.data_files())))


QUERIES = {f.__name__: f for f in (
    catalog_tables, catalog_metered, catalog_requirements, table_handle, json_values, transform_vectors, partitions_bucket_string, partitions_truncate_decimal,
    partitions_several, partitions_separators, append_rolled, compact_sizes, compact_reached, append_single, append_in_order, scan_elements, over_scan_top_k, delta_after_spec_change,
    upsert_after_spec_change, delete_where_equal_after_spec_change, cherry_pick, manifests_merged,
)}


# ---------------------------------------------------------------- the same in SQL


def _values(rows: list[tuple[str, str]]) -> str:
    """Rows of fixed outcomes; an outcome in braces is SQL."""
    text = lambda t: f"CAST(({t[1:-1]}) AS VARCHAR)" if t.startswith("{") else f"'{t}'"
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {text(v)})" for k, v in rows) + ") AS t(step, outcome)"


_NATIONS = "{SELECT count(*) FROM nation}"
_KINDS = ("assert-table-uuid", "assert-ref-snapshot-id", "assert-last-assigned-field-id", "assert-current-schema-id", "assert-last-assigned-partition-id", "assert-default-spec-id", "assert-default-sort-order-id")
# Eight letters of ASCII are one long of eight bytes, the first the lowest; its hash is that of the text.
_BRANDS = "SELECT CAST(" + " + ".join(f"ascii(substr(rpad(p_brand, 8, '_'), {i + 1}, 1))::HUGEINT * {256**i}" for i in range(8)) + " AS BIGINT) AS key FROM part"

ORACLE_SQL = {
    "catalog_tables": _values([
        ("create again", "AlreadyExists"), ("tables", "db.a,db.b"), ("rows of a", _NATIONS), ("files of a", "{SELECT ceil(count(*) / 10)::INT FROM nation}"), ("rows of b", "0"), ("load c", "NotFound"),
        ("a exists", "True"), ("c exists", "False"), ("rows of a by path", _NATIONS), ("rename a", "FeatureUnsupported"), ("tables then", "db.a,db.c,db.d"), ("rows of d", _NATIONS),
        ("tables at last", "db.a,db.d"), ("drop again", "NotFound"),
    ]),
    "catalog_metered": _values([("create_table calls", "1"), ("update_table calls", "2"), ("load_table calls", "1"), ("load_table failures", "1")]),
    "catalog_requirements": _values([("assert-create", "CommitConflict"), ("assert-create without table", "done"), *((f"{k} True", "done") for k in _KINDS), *((f"{k} False", "CommitConflict") for k in _KINDS)]),
    "table_handle": _values([
        ("partition type", "n_nationkey_bucket:int n_name_trunc:string"), ("arrow", "n_nationkey:int32 n_name:string n_regionkey:int32"), ("relative", "data/x.parquet"), ("outside", "DataInvalid"),
        ("versions", "2"), ("snapshot", "1"), ("file json", "True"),
    ]),
    # The JSON of single values and the hashes that the table format publishes for them.
    "json_values": _values([
        ("boolean", "true True"), ("int", "-5 True"), ("long", "1099511627776 True"), ("double", "1.5 True"), ("date", '"2017-11-16" True'), ("time", '"22:31:08.123456" True'),
        ("timestamp", '"2017-11-16T22:31:08.123456" True'), ("timestamptz", '"2017-11-16T22:31:08.123456+00:00" True'), ("string", '"iceberg" True'),
        ("uuid", '"f79c3e09-677c-4bbd-a479-3f349cb785e7" True'), ("binary", '"0001ff" True'), ("decimal(9,2)", '"14.20" True'),
    ]),
    "transform_vectors": _values([
        ("hash int 34", "2017239379"), ("hash long 34", "2017239379"), ("hash decimal 14.20", "-500754589"), ("hash date", "-653330422"), ("bucket time", "{(-662762989 & 2147483647) % 1000000}"), ("hash timestamp", "-2047944441"),
        ("hash timestamptz", "-2047944441"), ("hash string", "1210000089"), ("hash uuid", "1488055340"), ("hash fixed", "-188683207"), ("hash binary", "-188683207"), ("hash null", "{NULL}"),
        ("truncate int 1", "0"), ("truncate int -1", "-10"), ("truncate long -11", "-20"), ("truncate decimal 10.65", "10.50"), ("truncate decimal -0.05", "-0.10"), ("truncate string", "ice"), ("truncate letters", "äö"),
    ]),
    "partitions_bucket_string": f"WITH {murmur(_BRANDS, 'key')} SELECT CAST(bits % 8 AS INT) AS p, count(*) AS record_count FROM hashed GROUP BY 1",
    "partitions_truncate_decimal": """SELECT CAST(floor(CAST(o_totalprice AS DECIMAL(18,2)) / 50000.00) * 50000 AS DECIMAL(18,2)) AS p, count(*) AS record_count FROM orders GROUP BY 1""",
    "partitions_several": f"""WITH {murmur('SELECT o_orderdate, o_orderstatus, o_custkey FROM orders', 'o_custkey')}
        SELECT CAST(year(o_orderdate) - 1970 AS INT) AS o_orderdate_year, o_orderstatus, CAST(bits % 4 AS INT) AS o_custkey_bucket, count(*) AS record_count FROM hashed GROUP BY ALL""",
    "partitions_separators": """WITH rows AS (SELECT ['a' || chr(31) || 'b', 'a', NULL, '', '-', '1:a'][c_custkey % 6 + 1] AS p, ['c', 'b' || chr(31) || 'c', '', NULL, '1:-', ''][(c_custkey + 1) % 6 + 1] AS q,
          ['x', 'y'][c_custkey % 2 + 1] AS r FROM customer),
        counted AS (SELECT p, q, r, count(*) AS record_count FROM rows GROUP BY ALL)
        SELECT * FROM counted UNION ALL SELECT p, q, r, -record_count FROM counted WHERE p = 'a' || chr(31) || 'b' AND q = 'b' || chr(31) || 'c' AND r = 'x'""",
    "append_rolled": "SELECT 2 * count(*) AS records, true AS none_larger, true AS few_smaller FROM lineitem",
    "compact_sizes": "SELECT o_orderstatus, count(*) AS records, true AS right_sizes FROM orders GROUP BY ALL",
    "compact_reached": "SELECT *, '2-HIGH' AS rewritten, CAST(0 AS INT) AS deletes FROM orders WHERE NOT (o_orderpriority = '2-HIGH' AND o_orderstatus = 'F')",
    "append_single": "SELECT *, CAST((SELECT count(DISTINCT o_orderstatus) FROM orders) AS INT) AS files FROM orders",
    "append_in_order": "SELECT o_orderkey, true AS in_order, true AS marked FROM orders",
    "scan_elements": "SELECT vec_id, CAST(i - 1 AS INT) AS place, embedding[i] AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
    "over_scan_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "delta_after_spec_change": "SELECT * FROM orders WHERE o_orderpriority >= '3'",
    "upsert_after_spec_change": "SELECT * REPLACE (CASE WHEN o_orderpriority < '3' THEN 0.5 ELSE o_totalprice END AS o_totalprice) FROM orders",
    "delete_where_equal_after_spec_change": "SELECT * FROM orders WHERE o_orderpriority >= '3' AND o_orderpriority <= '4'",
    "cherry_pick": "SELECT *, 'DataInvalid' AS again FROM orders WHERE o_orderstatus IN ('F', 'O')",
    "manifests_merged": "SELECT *, true AS few_manifests, true AS only_live_files FROM orders WHERE o_orderstatus IN ('F', 'P')",
}
