"""Queries p1_ to p7_: the training-data operators of the core, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..core.errors import CommitConflict
from ..core.session import cut_table, scratch_path
from ..operators import changefeed, compaction, drift, hierarchy, incremental, nested, references


def load(spark: SparkSession, sf_dir: str, *names: str):
    frames = [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]
    return frames[0] if len(frames) == 1 else frames


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.unprocessed_changes(*load(spark, d, "manifest_entries", "snapshots", "consumer_runs"))


def p1_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Work items per consumer and state, the ledger's clock standing at its newest event."""
    entries, snapshots, runs = load(spark, d, "manifest_entries", "snapshots", "consumer_runs")
    changes = incremental.table_changes(entries, snapshots)
    # One number: the time of the newest event.
    now = runs.agg(F.max("logged_ms")).first()[0]
    states = incremental.ledger_states(changes.select("table_uuid", "sequence").distinct(), runs, now or 0)
    return states.groupBy("consumer", "state").agg(F.count(F.lit(1)).alias("items"))


def p1_runs(spark: SparkSession, d: str) -> DataFrame:
    """All unprocessed changes worked off through the durable ledger, with failures on the way.

    The first attempt writes part of its output and dies, the second one finishes its output after its
    lease has expired, the third completes. Readers see what completed leases wrote: each change once.
    """
    entries, snapshots, runs = load(spark, d, "manifest_entries", "snapshots", "consumer_runs")
    changes = cut_table(incremental.table_changes(entries, snapshots))
    now = [1_000]
    ledger = incremental.BatchLedger(scratch_path(spark, "ledger"), spark, runs, lease_ms=100, clock=lambda: now[0])
    columns = ("consumer", "table_uuid", "file_path", "status")
    dead = ledger.lease(changes)
    if dead is None:
        return spark.createDataFrame([], "consumer string, table_uuid string, file_path string, status int")
    ledger.work(dead, changes).where("status = 2").select(*columns).write.parquet(dead.output)
    now[0] += 200
    late = ledger.lease(changes)
    ledger.work(late, changes).select(*columns).write.parquet(late.output)
    now[0] += 200
    for lease in (dead, late):
        try:
            ledger.complete(lease)
            raise AssertionError("a stale lease was completed")
        except CommitConflict:
            pass
    last = ledger.lease(changes)
    ledger.work(last, changes).select(*columns).write.parquet(last.output)
    ledger.complete(last)
    if ledger.lease(changes) is not None:
        raise AssertionError("work is left after all was done")
    return spark.read.parquet(*ledger.outputs()).distinct()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    entries, snapshots, rows = load(spark, d, "manifest_entries", "snapshots", "delta_rows")
    table, files = changefeed.apply_feed(spark, entries, snapshots, rows, scratch_path(spark, "feed"))
    return table.read().select("file_id", "row_pos").join(files.select("file_id", "file_path"), "file_id").select("file_path", "row_pos")


def p2_feeds(spark: SparkSession, d: str) -> DataFrame:
    """The same rows from two feeds: what arrived in the later half of the time comes first."""
    entries, snapshots, rows = load(spark, d, "manifest_entries", "snapshots", "delta_rows")
    at = F.unix_micros("arrived_at")
    edge = rows.agg(F.min(at), F.max(at)).first()  # two numbers
    late = at > F.lit(((edge[0] or 0) + (edge[1] or 0)) // 2)
    root = scratch_path(spark, "feeds")
    for part in (rows.where(late), rows.where(~F.coalesce(late, F.lit(False)))):
        table, _ = changefeed.apply_feed(spark, entries, snapshots, part, root)
    files = changefeed.feed_files(entries, snapshots, rows)  # those of both feeds
    return table.read().select("file_id", "row_pos").join(files.select("file_id", "file_path"), "file_id").select("file_path", "row_pos")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    files = compaction.live_files(load(spark, d, "manifest_entries"))
    return compaction.plan_compaction(files).select("table_uuid", "file_path")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """What a compaction would do to each partition: inputs, records and bytes, and whether the groups of
    each shard are as many as the target asks for and as even as longest-first makes them."""
    plan = compaction.plan_compaction(compaction.live_files(load(spark, d, "manifest_entries")))
    keys = ["table_uuid", "partition_tuple"]
    size = F.col("file_size_in_bytes")
    groups = plan.groupBy(*keys, "shard", "out_group").agg(F.count(F.lit(1)).alias("n"), F.sum("record_count").alias("records"), F.sum(size).alias("bytes"), F.max(size).alias("largest"))
    shards = groups.groupBy(*keys, "shard").agg(
        F.sum("n").alias("n"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("fullest"), F.max("largest").alias("largest"), F.max("out_group").alias("last")
    )
    wanted = F.greatest(F.lit(1), F.round(F.col("bytes") / compaction.TARGET_BYTES))
    even = (F.col("fullest") <= F.col("bytes") / wanted + F.col("largest")) & (F.col("last") < wanted)
    return shards.withColumn("even", even).groupBy(*keys).agg(F.sum("n").alias("inputs"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes"), F.min("even").alias("even"))


def p3_rewritten(spark: SparkSession, d: str) -> DataFrame:
    """All file records, written as the tiny files they come from, compacted through pyarrow, and read by the
    published manifest, beside the files that stayed as they were."""
    records, root = load(spark, d, "file_records"), scratch_path(spark, "compaction")
    listing = cut_table(compaction.write_small_files(records, ["table_uuid", "file_path"], f"{root}/small"))
    files = listing.select("table_uuid", F.col("path").alias("file_path"), F.lit(None).cast("string").alias("partition_tuple"), "file_size_in_bytes", "record_count")
    plan = cut_table(compaction.plan_compaction(files))
    merged = compaction.rewrite_files(spark, plan, f"{root}/merged").select(F.col("out_path").alias("path"))
    rest = files.join(plan, "file_path", "left_anti").select(F.col("file_path").alias("path"))
    paths = [r.path for r in merged.unionByName(rest).collect()]  # a path for each file that is read, as any scan has
    return spark.read.schema(records.schema).parquet(*paths).select("table_uuid", "file_path", "row_pos", "schema_id", "payload") if paths else records.limit(0)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy.lineage(load(spark, d, "snapshots"), "table_uuid", "snapshot_id", "parent_snapshot_id", "sequence_number")
    return tree.select(
        F.col("tree").alias("table_uuid"), F.col("node_id").alias("snapshot_id"), F.col("root_id").alias("root_snapshot_id"), "depth"
    )


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy.lineage(load(spark, d, "snapshots"), "table_uuid", "snapshot_id", "parent_snapshot_id", "sequence_number")
    return tree.select(F.col("tree").alias("table_uuid"), F.col("node_id").alias("snapshot_id"), "descendants")


def p4_spans(spark: SparkSession, d: str) -> DataFrame:
    """Paths and descendants of all snapshots as intervals: how many lie in each, whether it lies in that of
    its parent, and whether it begins where no other does."""
    rows = load(spark, d, "snapshots")
    found = cut_table(hierarchy.spans(rows, "table_uuid", "snapshot_id", "parent_snapshot_id", "sequence_number"))
    links = rows.groupBy("table_uuid", "snapshot_id").agg(F.max("parent_snapshot_id").alias("parent_id"))
    above = found.select(F.col("tree").alias("table_uuid"), F.col("node_id").alias("parent_id"), F.col("first").alias("f"), F.col("last").alias("l"))
    placed = found.withColumnsRenamed({"tree": "table_uuid", "node_id": "snapshot_id"}).join(links, ["table_uuid", "snapshot_id"]).join(above, ["table_uuid", "parent_id"], "left")
    alone = F.when(F.col("first").isNull(), F.col("snapshot_id"))  # those without a number are not one group
    once = F.count("first").over(W.partitionBy("table_uuid", "root_id", "first", alone)) <= 1
    nested_ = F.coalesce((F.col("first") > F.col("f")) & (F.col("last") <= F.col("l")), F.lit(True)) & once
    size = F.coalesce(F.col("last") - F.col("first"), F.lit(-1).cast("bigint"))
    return placed.select("table_uuid", "snapshot_id", F.col("root_id").alias("root_snapshot_id"), "depth", size.alias("descendants"), nested_.alias("nested"))


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """The full path of every snapshot, itself at distance 0; read by ancestor, all descendants. A snapshot whose
    ancestry never ends has one row, with -1."""
    found = hierarchy.paths(load(spark, d, "snapshots"), "table_uuid", "snapshot_id", "parent_snapshot_id", "sequence_number")
    return found.withColumnsRenamed({"tree": "table_uuid", "node_id": "snapshot_id", "ancestor_id": "ancestor_snapshot_id"})


def p4_history(spark: SparkSession, d: str) -> DataFrame:
    """The full path of the snapshot that the newest metadata document of each table calls current (of all: ``p4_paths``)."""
    snapshots, metadata = load(spark, d, "snapshots", "table_metadata")
    current = metadata.groupBy("table_uuid").agg(F.max_by("current_snapshot_id", F.struct("last_updated_ms", "metadata_file")).alias("node_id"))
    found = hierarchy.histories(snapshots, "table_uuid", "snapshot_id", "parent_snapshot_id", "sequence_number", current.withColumnRenamed("table_uuid", "tree"))
    return found.withColumnsRenamed({"tree": "table_uuid", "node_id": "snapshot_id", "ancestor_id": "ancestor_snapshot_id"})


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.lake_schema_changes(load(spark, d, "table_metadata"))


def p5_union(spark: SparkSession, d: str) -> DataFrame:
    schemas = nested.table_schemas(load(spark, d, "table_metadata"))
    fused = drift.fuse_schemas(nested.schema_fields(schemas))
    return fused.select("table_uuid", "field_id", F.posexplode("branches").alias("tag", "b")).select(
        "table_uuid", "field_id", "tag", F.col("b.kind").alias("kind"), F.element_at("b.schema_ids", 1).alias("since_schema_id"),
        F.size("b.schema_ids").alias("schemas"), F.array_join("b.names", ",").alias("names"),
    )


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return drift.unified_records(*load(spark, d, "file_records", "table_metadata", "manifest_entries", "snapshots"))


def p5_leaves(spark: SparkSession, d: str) -> DataFrame:
    """How many values each record has after it was brought under the current schema, in its payload and
    its branches together, defaults apart: as many as before."""
    records = cut_table(drift.unified_records(*load(spark, d, "file_records", "table_metadata", "manifest_entries", "snapshots"), fill=False))
    key = F.concat_ws("\u0001", "table_uuid", "file_path", F.coalesce(F.col("row_pos").cast("string"), F.lit("")))
    kept = records.where("payload is not null").select(key.alias("k"), F.col("payload").alias("doc"))
    spilled = records.where("payload is not null").select(key.alias("k"), F.explode("branches").alias("b", "v"))
    # A scalar in a branch is one value, whatever its text is; other branches are JSON.
    nested_ = F.col("b").rlike(":(struct|list|map)$") | (F.endswith("b", F.lit(":json")) & F.col("v").rlike(r"^[\[{]"))
    docs = kept.unionByName(spilled.select("k", F.when(nested_, F.col("v")).otherwise(F.lit("0")).alias("doc")))
    cells = nested.flatten(docs, "k", "doc").select("doc_key", F.size(F.filter(F.map_values("vals"), lambda v: v.isNotNull())).alias("n"))
    parts = F.split("doc_key", "\u0001")
    return cells.groupBy("doc_key").agg(F.sum("n").alias("leaves")).select(
        parts[0].alias("table_uuid"), parts[1].alias("file_path"), F.when(parts[2] != "", parts[2].cast("bigint")).alias("row_pos"), "leaves"
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    fields = nested.schema_fields(nested.table_schemas(load(spark, d, "table_metadata")))
    return fields.select("table_uuid", "schema_id", "field_id", "parent_field_id").distinct()


def p6_schema(spark: SparkSession, d: str) -> DataFrame:
    """The merged schema of all schema documents: every place, the types of its values, how many."""
    flat = nested.flat_schemas(nested.table_schemas(load(spark, d, "table_metadata")))
    return nested.merged_schema(flat).select("relation", "name", F.array_join("kinds", ",").alias("kinds"), "cells")


def p6_relations(spark: SparkSession, d: str) -> DataFrame:
    """Of the typed tables those of the fields of schemas and of structs in them, side by side under the columns that
    they share, with parent key and ordinal (all tables and columns: ``p6_tables``)."""
    flat = cut_table(nested.flat_schemas(nested.table_schemas(load(spark, d, "table_metadata"))))
    schema = cut_table(nested.merged_schema(flat))
    out = None
    for relation in ("$/fields", "$/fields/type.fields", "$/fields/type.element.fields"):
        rows = nested.relation_table(flat, relation, schema)
        have = [F.col(f"`{c}`") if c in rows.columns else F.lit(None).cast("string").alias(c) for c in ("id", "name", "required", "doc", "type")]
        keys = F.split("doc_key", nested.SEPARATOR)
        part = rows.select(keys[0].alias("table_uuid"), keys[1].cast("int").alias("schema_id"), F.lit(relation).alias("relation"), "row_key", "parent_key", "ordinal", *have)
        out = part if out is None else out.unionByName(part)
    return out


def p6_tables(spark: SparkSession, d: str) -> DataFrame:
    """The typed tables of all relations of the schema documents, at any depth and with all columns, a row per cell."""
    flat = cut_table(nested.flat_schemas(nested.table_schemas(load(spark, d, "table_metadata"))).drop("carried"))
    cells = nested.typed_cells(flat, cut_table(nested.merged_schema(flat)))
    keys = F.split("doc_key", nested.SEPARATOR)
    return cells.select(keys[0].alias("table_uuid"), keys[1].cast("int").alias("schema_id"), "relation", "row_key", "parent_key", "ordinal", "name", "type", "value")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    snapshots, log, entries, listing = load(spark, d, "snapshots", "metadata_log", "manifest_entries", "stored_files")
    most = snapshots.count() + log.count() + entries.count()  # by the files' footers
    return references.orphan_references(references.lake_references(snapshots, log, entries), listing, most)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_report(p7_found(spark, d))


QUERIES = {f.__name__: f for f in (
    p1_found, p1_ledger, p1_runs, p2_found, p2_feeds, p3_found, p3_groups, p3_rewritten, p4_found, p4_descendants, p4_spans, p4_paths, p4_history, p5_found, p5_union, p5_records, p5_leaves, p6_found, p6_schema, p6_relations, p6_tables, p7_found, p7_report,
)}
