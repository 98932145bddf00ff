"""Queries over lake tables: each builds its table in a fresh warehouse and reads it back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..core.session import scratch_path
from ..format.types import PartitionSpec, Primitive, SortField, SortOrder, Transform, from_spark
from ..functions.transforms import transform_column
from ..sources.catalog import StorageCatalog
from ..sources.table import Table
from ..streaming.sink import write_stream
from .pipeline import load


def build(spark: SparkSession, rows: DataFrame | list[DataFrame], parts: list = (), name: str = "db.t", sort: list[str] = ()) -> Table:
    """A table of the rows' schema; one append per DataFrame."""
    batches = rows if isinstance(rows, list) else [rows]
    schema = from_spark(batches[0].schema)
    order = SortOrder(1, tuple(SortField(schema.struct.by_name(c).id, Transform("identity")) for c in sort)) if sort else None
    table = StorageCatalog(spark, scratch_path(spark, "warehouse")).create_table(name, schema, PartitionSpec.build(schema, list(parts)), sort_order=order)
    for batch in batches:
        table.append(batch, sort=bool(sort))
    return table


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders")


def _decimal_orders(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))


def _int_parts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").withColumn("p_size", F.col("p_size").cast("int"))


def _date_orders(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))



#: Name, source rows and partition layout of the tables that cover every transform.
LAYOUTS = {
    "identity": (lambda s, d: load(s, d, "customer"), ["c_mktsegment"]),
    "year": (_orders, [("o_orderdate", "year")]),
    "month": (lambda s, d: load(s, d, "lineitem"), [("l_shipdate", "month")]),
    "day": (lambda s, d: load(s, d, "events"), [("ts", "day")]),
    "hour": (lambda s, d: load(s, d, "events"), [("ts", "hour")]),
    "void": (lambda s, d: load(s, d, "nation"), [("n_name", "void")]),
    "truncate_int": (_int_parts, [("p_size", "truncate[10]")]),
    "truncate_long": (_orders, [("o_orderkey", "truncate[5000]")]),
    "truncate_string": (lambda s, d: load(s, d, "part"), [("p_brand", "truncate[7]")]),
    "truncate_decimal": (_decimal_orders, [("price", "truncate[5000000]")]),
    "bucket_int": (_int_parts, [("p_size", "bucket[8]")]),
    "bucket_long": (_orders, [("o_custkey", "bucket[16]")]),
    "bucket_string": (lambda s, d: load(s, d, "part"), [("p_brand", "bucket[8]")]),
    "bucket_date": (_date_orders, [("day", "bucket[8]")]),
    "bucket_timestamp": (_orders, [("o_orderdate", "bucket[8]")]),
    "bucket_decimal": (_decimal_orders, [("price", "bucket[8]")]),
    "several": (_orders, [("o_orderdate", "year"), "o_orderstatus", ("o_custkey", "bucket[4]")]),
}
#: Layouts whose partition tuples SQL can compute.
CHECKED = ("identity", "year", "month", "day", "hour", "truncate_int", "truncate_long", "truncate_string", "bucket_int", "bucket_long", "bucket_date", "bucket_timestamp")


def _empty(spark: SparkSession, like: DataFrame) -> Table:
    return StorageCatalog(spark, scratch_path(spark, "warehouse")).create_table("db.t", from_spark(like.schema))


def _append(layout: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows, parts = LAYOUTS[layout]
        return build(spark, rows(spark, d), parts).to_df()

    return query


def _partitions(layout: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows, parts = LAYOUTS[layout]
        table = build(spark, rows(spark, d), parts)
        view = table.partitions_df()
        name = table.spec.fields[0].name
        return view.select(F.col(f"partition.{name}").alias("p"), "record_count")

    return query


# ---------------------------------------------------------------- scans


def scan_all(spark, d):
    return build(spark, load(spark, d, "nation")).to_df()


def scan_projection(spark, d):
    return build(spark, _orders(spark, d)).new_scan().select("o_orderkey", "o_totalprice").to_df()


def scan_nested(spark, d):
    """Arrays survive; one row per element position keeps the comparison free of float sums."""
    table = build(spark, load(spark, d, "embeddings"))
    return table.to_df().select("*", F.size("embedding").alias("dim")).drop("embedding")


def scan_partition_value(spark, d):
    table = build(spark, load(spark, d, "customer"), ["c_mktsegment"])
    return table.new_scan().with_partition_value({"c_mktsegment": "BUILDING"}).to_df()


def scan_time_travel(spark, d):
    o = _orders(spark, d)
    table = build(spark, [o.where("o_orderpriority < '3'"), o.where("o_orderpriority >= '3'")])
    return table.new_scan().with_snapshot_id(1).to_df()


def scan_tag(spark, d):
    o = _orders(spark, d)
    table = build(spark, [o.where("o_orderpriority < '3'"), o.where("o_orderpriority >= '3'")])
    table.set_ref("half", 1)
    return table.new_scan().with_ref("half").to_df()


def scan_resume(spark, d):
    """One file per priority; the scan goes on at the second row of the third."""
    o = _orders(spark, d)
    cuts = [o.where(f"o_orderpriority like '{i}%'").coalesce(1).sortWithinPartitions("o_orderkey") for i in range(1, 6)]
    table = _empty(spark, o)
    tx, files = table.new_transaction(), []
    for part in cuts:
        files += table.new_writer().data(part)
    tx.append_data_file(*files).commit()
    return table.new_scan().start_from(files[2].path, 1).to_df()


def predicate_pruned_scan(spark, d):
    table = build(spark, load(spark, d, "lineitem"), [("l_shipdate", "month")])
    import datetime as dt

    scan = table.new_scan().select("l_orderkey", "l_shipdate", "l_quantity").where("l_shipdate", ">=", dt.datetime(1997, 6, 15)).where("l_shipdate", "<", dt.datetime(1997, 9, 1))
    return scan.to_df()


# ---------------------------------------------------------------- writes


def append_precomputed_partition(spark, d):
    o = _orders(spark, d)
    schema = from_spark(o.schema)
    table = StorageCatalog(spark, scratch_path(spark, "warehouse")).create_table("db.t", schema, PartitionSpec.build(schema, [("o_orderdate", "year")]))
    table.append(o.withColumn("place", F.struct((F.year("o_orderdate") - 1970).alias("o_orderdate_year"))), partition_col="place")
    return table.to_df()


def append_sorted(spark, d):
    return build(spark, _orders(spark, d), ["o_orderstatus"], sort=["o_orderkey"]).to_df()


def append_overwrite(spark, d):
    o = _orders(spark, d)
    return build(spark, o).overwrite(o.where("o_orderstatus = 'F'")).to_df()


def append_many_compacted(spark, d):
    """Five appends, one compaction: the rows stay, the files go."""
    o = _orders(spark, d)
    table = build(spark, [o.where(f"o_orderpriority like '{i}%'") for i in range(1, 6)])
    table.compact(small_bytes=1 << 40, target_bytes=1 << 30)
    files = table.files_df().agg(F.count(F.lit(1)).alias("files"))
    return table.to_df().crossJoin(files)  # one row on the right


def stream_append(spark, d):
    """A file stream of orders into a table, one snapshot per micro-batch."""
    o = _orders(spark, d)
    source = scratch_path(spark, "stream")
    o.repartition(4).write.parquet(source)
    table = _empty(spark, o)
    stream = spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 2).parquet(source)
    write_stream(stream, table, "orders", scratch_path(spark, "stream-state")).awaitTermination()
    return table.refresh().to_df()


# ---------------------------------------------------------------- row-level changes


def _numbered(df: DataFrame, op: int, base: int, *order: str) -> DataFrame:
    """Events in the order of a unique key."""
    return df.withColumn("op", F.lit(op)).withColumn("seq", F.col(order[0]) + F.lit(base))


STEP = 1 << 40


def delta_insert_overwrites(spark, d):
    """The same keys inserted twice in one call: the later rows stay."""
    o = _orders(spark, d)
    later = o.withColumn("o_totalprice", F.col("o_totalprice") * 2)
    table = _empty(spark, o)
    table.apply_changes(_numbered(o, 1, 0, "o_orderkey").unionByName(_numbered(later, 1, STEP, "o_orderkey")), "op", "seq", ["o_orderkey"])
    return table.to_df()


def delta_delete_same_call(spark, d):
    o = _orders(spark, d)
    table = _empty(spark, o)
    gone = o.where("o_orderpriority = '1-URGENT'")
    table.apply_changes(_numbered(o, 1, 0, "o_orderkey").unionByName(_numbered(gone, 2, STEP, "o_orderkey")), "op", "seq", ["o_orderkey"])
    return table.to_df()


def delta_delete_prior_snapshot(spark, d):
    o = _orders(spark, d)
    table = build(spark, o)
    table.apply_changes(_numbered(o.where("o_orderstatus = 'O'"), 2, 0, "o_orderkey"), "op", "seq", ["o_orderkey"])
    return table.to_df()


def delta_partitioned(spark, d):
    """Delete older rows, insert them again with a new price, delete a part of these: by year."""
    o = _orders(spark, d)
    table = build(spark, o, [("o_orderdate", "year")])
    again = o.where("o_orderstatus = 'F' and o_orderpriority < '3'").withColumn("o_totalprice", F.lit(1.0))
    events = [
        _numbered(o.where("o_orderstatus = 'F'"), 2, 0, "o_orderkey"),
        _numbered(again, 1, STEP, "o_orderkey"),
        _numbered(o.where("o_orderstatus = 'F' and o_orderpriority < '2'"), 2, 2 * STEP, "o_orderkey"),
    ]
    table.apply_changes(reduce(DataFrame.unionByName, events), "op", "seq", ["o_orderkey", "o_orderdate"])
    return table.to_df()


def delta_upsert(spark, d):
    o = _orders(spark, d)
    table = build(spark, o)
    new = o.where("o_orderpriority = '5-LOW'").withColumn("o_totalprice", F.lit(0.0))
    table.apply_changes(_numbered(new, 1, 0, "o_orderkey"), "op", "seq", ["o_orderkey"], upsert=True)
    return table.to_df()


def delta_compacted(spark, d):
    """Deletes folded into the data files."""
    o = _orders(spark, d)
    table = build(spark, o)
    table.apply_changes(_numbered(o.where("o_orderstatus = 'O'"), 2, 0, "o_orderkey"), "op", "seq", ["o_orderkey"])
    table.compact()
    return table.to_df().withColumn("delete_files", F.lit(len(table.delete_files())))


def equality_delete_read(spark, d):
    table = build(spark, load(spark, d, "lineitem"))
    table.delete_where_equal(_orders(spark, d).where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey")), ["l_orderkey"])
    return table.to_df()


def position_delete_read(spark, d):
    """Rows found by a scan of the files, then deleted by their positions."""
    li = load(spark, d, "lineitem")
    table = build(spark, li, [("l_shipdate", "year")])
    paths = [f.path for f in table.data_files()]
    found = spark.read.parquet(*paths).select("*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.row_index").alias("pos"))
    table.delete_positions(found.where("l_quantity > 25").select("file_path", "pos"))
    return table.to_df()


# ---------------------------------------------------------------- metadata


def snapshot_summary(spark, d):
    o = _orders(spark, d)
    table = build(spark, [o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'")])
    table.delete_where_equal(o.where("o_orderstatus = 'F'").select("o_orderkey"), ["o_orderkey"])
    s = table.snapshots_df()
    count = lambda k: F.coalesce(F.col("summary")[k].cast("bigint"), F.lit(0).cast("bigint"))
    return s.select(
        "snapshot_id", "parent_id", "sequence_number", "operation", count("added-records").alias("added_records"),
        count("total-records").alias("total_records"), count("added-equality-deletes").alias("added_equality_deletes"),
        count("total-equality-deletes").alias("total_equality_deletes"),
    )


def files_null_counts(spark, d):
    """Per column: values and nulls, summed over the files' statistics."""
    docs = load(spark, d, "documents").select("doc_id", "text", "lang", "question_id", "score", "duplicate_of", "created_at")
    table = build(spark, docs)
    names = {f.id: f.name for f in table.schema.fields}
    named = F.create_map(*[F.lit(x) for i, n in names.items() for x in (i, n)])
    nulls = table.files_df().select(F.explode("null_value_counts").alias("id", "nulls"), "record_count")
    return nulls.groupBy(named[F.col("id")].alias("column_name")).agg(F.sum("record_count").alias("records"), F.sum("nulls").alias("nulls"))


def entries_by_status(spark, d):
    o = _orders(spark, d)
    table = build(spark, [o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'")], ["o_orderstatus"])
    return table.entries_df().where("status = 1").groupBy("sequence_number").agg(F.sum("record_count").alias("records"))


def manifest_rows(spark, d):
    o = _orders(spark, d)
    table = build(spark, [o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'")])
    return table.manifests_df().select("sequence_number", "added_rows", "deleted_rows")


def schema_rename_add(spark, d):
    table = build(spark, load(spark, d, "nation"))
    table.update_schema(rename={"n_name": "country"}, add=[("note", "string"), ("rank", "int", 7)])
    return table.to_df()


def schema_drop_widen(spark, d):
    """A column goes, its name comes back as a new column, an int becomes long."""
    table = build(spark, _int_parts(spark, d))
    table.update_schema(drop=["p_brand"], widen={"p_size": "long"})
    table.update_schema(add=[("p_brand", "string")])
    return table.to_df().select("p_partkey", "p_size", "p_brand")


def spec_evolution(spark, d):
    """Files of two partition layouts in one table."""
    o = _orders(spark, d)
    table = build(spark, o.where("o_orderpriority < '3'"), [("o_orderdate", "year")])
    table.update_spec([("o_custkey", "bucket[4]")])
    table.append(o.where("o_orderpriority >= '3'"))
    return table.to_df()


def rollback(spark, d):
    o = _orders(spark, d)
    table = build(spark, [o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'")])
    return table.rollback_to(1).to_df()


def branch_append(spark, d):
    """Rows on a branch do not show on main; the branch has them."""
    o = _orders(spark, d)
    table = build(spark, o.where("o_orderstatus = 'F'"))
    table.set_ref("audit", 1, "branch")
    table.append(o.where("o_orderstatus = 'O'"), branch="audit")
    on = lambda df, name: df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).withColumn("branch", F.lit(name))
    return on(table.to_df(), "main").unionByName(on(table.new_scan().with_ref("audit").to_df(), "audit"))


# ---------------------------------------------------------------- transforms as columns


def transform_columns(spark, d):
    ts, day = Primitive("timestamp"), Primitive("date")
    events = load(spark, d, "events").select(F.col("event_id").cast("bigint").alias("id"), F.col("ts").cast("timestamp_ntz").alias("t"))
    early = spark.createDataFrame([(-1, "1969-12-31 23:00:00"), (-2, "2022-11-01 23:30:00"), (-3, None), (-4, "1900-03-01 00:00:00.000001")], "id bigint, s string")
    rows = events.unionByName(early.select("id", F.col("s").cast("timestamp_ntz").alias("t")))
    column = lambda name, c, t: transform_column(Transform.parse(name), c, t)
    return rows.select(
        "id", *(column(u, F.col("t"), ts).alias(f"t_{u}") for u in ("year", "month", "day", "hour")),
        *(column(u, F.col("t").cast("date"), day).alias(f"d_{u}") for u in ("year", "month", "day")),
        column("truncate[10]", F.col("id"), Primitive("long")).alias("id_trunc"), column("bucket[32]", F.col("id"), Primitive("long")).alias("id_bucket"),
        column("void", F.col("id"), Primitive("long")).alias("id_void"),
    )


# ---------------------------------------------------------------- Spark's own operators over a scan


def over_scan_join_agg(spark, d):
    orders = build(spark, _orders(spark, d), [("o_orderdate", "year")]).new_scan().select("o_orderkey", "o_custkey", "o_orderstatus").to_df()
    customer = build(spark, load(spark, d, "customer"), name="db.c").new_scan().select("c_custkey", "c_mktsegment").to_df()
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("c_mktsegment", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_order"))


def over_scan_window(spark, d):
    orders = build(spark, _orders(spark, d)).new_scan().select("o_orderkey", "o_custkey", "o_totalprice").to_df()
    w = W.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return orders.withColumn("rn", F.row_number().over(w)).where("rn <= 2")


def over_scan_set_ops(spark, d):
    orders = build(spark, _orders(spark, d)).to_df()
    a, b = orders.where("o_orderstatus = 'F'").select("o_custkey"), orders.where("o_orderstatus = 'O'").select("o_custkey")
    both = a.intersect(b).withColumn("side", F.lit("both"))
    return both.unionByName(a.subtract(b).withColumn("side", F.lit("only_f")))


def over_scan_rollup(spark, d):
    li = build(spark, load(spark, d, "lineitem"), [("l_shipdate", "year")]).new_scan().select("l_returnflag", "l_linestatus", "l_quantity").to_df()
    return li.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("qty"))


QUERIES = {
    **{f"append_{n}": _append(n) for n in LAYOUTS},
    **{f"partitions_{n}": _partitions(n) for n in CHECKED},
    **{f.__name__: f for f in (
        scan_all, scan_projection, scan_nested, scan_partition_value, scan_time_travel, scan_tag, scan_resume, predicate_pruned_scan,
        append_precomputed_partition, append_sorted, append_overwrite, append_many_compacted, stream_append,
        delta_insert_overwrites, delta_delete_same_call, delta_delete_prior_snapshot, delta_partitioned, delta_upsert, delta_compacted,
        equality_delete_read, position_delete_read, snapshot_summary, files_null_counts, entries_by_status, manifest_rows,
        schema_rename_add, schema_drop_widen, spec_evolution, rollback, branch_append, transform_columns,
        over_scan_join_agg, over_scan_window, over_scan_set_ops, over_scan_rollup,
    )},
}
