"""Far too many small files: balanced longest-first grouping, and a verified rewrite."""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.errors import CommitConflict, InvalidData
from ..core.storage import Storage, join, local_path, is_local

#: A file below this size is worth merging, and the size that merged files should have.
SMALL_BYTES = 256 * 1024
TARGET_BYTES = 1024 * 1024
#: Files that one heap schedules at most, about; larger groups are split by hash.
SHARD_FILES = 4096


def live_files(entries: DataFrame) -> DataFrame:
    """(table_uuid, file_path, partition_tuple, file_size_in_bytes, record_count) of data files
    without a removal entry, one row per file. Null paths give no row; of differing facts about
    one file the greatest value holds."""
    return (
        entries.where((F.col("content") == 0) & F.col("file_path").isNotNull())
        .groupBy("table_uuid", "file_path")
        .agg(
            F.max(F.col("status") == 2).alias("removed"),
            F.max("partition_tuple").alias("partition_tuple"),
            F.max("file_size_in_bytes").alias("file_size_in_bytes"),
            F.max("record_count").alias("record_count"),
        )
        .where(~F.coalesce("removed", F.lit(False)))
        .drop("removed")
    )


def least_loaded(sizes: np.ndarray, groups: int) -> np.ndarray:
    """Longest first, each to the group with the least bytes so far; ties go to the lowest group."""
    owner = np.zeros(len(sizes), dtype=np.int32)
    if groups <= 1:
        return owner
    heap = [(0, g) for g in range(groups)]
    for i in np.argsort(-sizes, kind="stable"):
        load, g = heap[0]
        owner[i] = g
        heapq.heapreplace(heap, (load + int(sizes[i]), g))
    return owner


def plan_compaction(
    files: DataFrame,
    small_bytes: int = SMALL_BYTES,
    target_bytes: int = TARGET_BYTES,
    shard_files: int = SHARD_FILES,
) -> DataFrame:
    """Assign each small file to an output group of its table and partition.

    Returns (table_uuid, partition_tuple, shard, out_group, file_path, file_size_in_bytes,
    record_count). Files of unknown size, and the only small file of a partition, stay alone and
    give no row; null partition tuples are one group, empty files are merged like others. A
    (table, partition) with many files is split by a hash of the path into shards of about
    ``shard_files``, each scheduled by its own heap, so no task ever holds a whole hot partition.
    """
    small = files.where(F.col("file_size_in_bytes") < small_bytes)
    counted = small.groupBy("table_uuid", "partition_tuple").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    named = small.join(
        counted.select(F.col("table_uuid").alias("t"), F.col("partition_tuple").alias("p"), "n"),
        (F.col("table_uuid") == F.col("t")) & F.col("partition_tuple").eqNullSafe(F.col("p")),
    )
    shards = F.ceil(F.col("n") / shard_files)
    placed = named.select(
        "table_uuid", "partition_tuple", F.pmod(F.xxhash64("file_path"), shards).cast("int").alias("shard"),
        "file_path", F.col("file_size_in_bytes").cast("bigint").alias("file_size_in_bytes"), F.col("record_count").cast("bigint").alias("record_count"),
    )
    keys = ["table_uuid", "partition_tuple", "shard"]
    # The schedule travels without names that Python does not need: a dense key and the size.
    ordered = placed.repartition(*keys).sortWithinPartitions(*keys, "file_path")
    ordered = ordered.withColumn("gkey", F.xxhash64(*keys, F.col("partition_tuple").isNull()))
    schema = (
        "table_uuid string, partition_tuple string, shard int, out_group int, file_path string, "
        "file_size_in_bytes bigint, record_count bigint"
    )

    def schedule(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            sizes = table.column("file_size_in_bytes").to_numpy()
            gkey = table.column("gkey").to_numpy()
            owner = np.zeros(len(sizes), dtype=np.int32)
            edges = np.flatnonzero(np.diff(gkey)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(gkey)]):
                total = int(sizes[lo:hi].sum())
                owner[lo:hi] = least_loaded(sizes[lo:hi], max(1, round(total / target_bytes)))
            out = table.drop_columns(["gkey"]).add_column(3, "out_group", pa.array(owner, pa.int32()))
            yield from out.to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            gkey = batch.column(batch.schema.get_field_index("gkey")).to_numpy()
            cut = len(gkey) - int(np.argmax(gkey[::-1] != gkey[-1])) if (gkey != gkey[-1]).any() else 0
            if cut:  # everything before the last group of the batch is complete
                yield from flush(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            elif held and held[-1].column(held[-1].schema.get_field_index("gkey"))[0].as_py() != int(gkey[0]):
                yield from flush(pa.Table.from_batches(held))
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield from flush(pa.Table.from_batches(held))

    return ordered.mapInArrow(schedule, schema)


def rewrite_files(spark: SparkSession, plan: DataFrame, out_root: str) -> DataFrame:
    """Write each output group as one Parquet file and publish a verified manifest.

    Tasks stream row group by row group through pyarrow, so memory does not grow with the group.
    Each writes under a name of its own; only the manifest says which files count, and it is
    published by one exclusive create after every group of the plan has been compared with what was written:
    it is there, with as many inputs and records as planned, and its records are those of the inputs'
    footers. A record count that the plan does not know is not compared.
    Returns the manifest: (table_uuid, partition_tuple, shard, out_group, out_path, inputs, records, bytes).
    """
    attempt = uuid.uuid4().hex
    target = join(out_root, "data")
    group = ["table_uuid", "partition_tuple", "shard", "out_group"]
    schema = "table_uuid string, partition_tuple string, shard int, out_group int, out_path string, inputs int, records bigint, bytes bigint, expected bigint"

    def merge(key, pdf):
        import os

        import pandas as pd
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs

        def opened(uri):
            return (pafs.LocalFileSystem(), local_path(uri)) if is_local(uri) else pafs.FileSystem.from_uri(uri)

        table_uuid, part, shard, out_group = key
        fs, folder = opened(target)
        fs.create_dir(folder, recursive=True)
        name = f"{attempt}-{uuid.uuid5(uuid.NAMESPACE_URL, repr(tuple(key))).hex}-{uuid.uuid4().hex}.parquet"
        path = os.path.join(folder, name)
        paths = sorted(pdf["file_path"])
        schemas = []
        for p in paths:
            source, rel = opened(p)
            schemas.append(pq.read_schema(rel, filesystem=source))
        merged, expected = pa.unify_schemas(schemas), 0
        with pq.ParquetWriter(path, merged, filesystem=fs) as writer:
            for p in paths:
                source, rel = opened(p)
                with source.open_input_file(rel) as f:
                    reader = pq.ParquetFile(f)
                    expected += reader.metadata.num_rows
                    for batch in reader.iter_batches(batch_size=65536):
                        rows = pa.Table.from_batches([batch])
                        for field in merged:
                            if field.name not in rows.column_names:
                                rows = rows.append_column(field, pa.nulls(len(rows), field.type))
                        writer.write_table(rows.select(merged.names).cast(merged))
        info = fs.get_file_info(path)
        with fs.open_input_file(path) as f:
            records = pq.ParquetFile(f).metadata.num_rows
        return pd.DataFrame([(table_uuid, part, shard, out_group, join(target, name), len(paths), records, info.size, expected)], columns=[c.split()[0] for c in schema.split(", ")])

    report = plan.select(*group, "file_path").groupBy(*group).applyInPandas(merge, schema)
    manifest = join(out_root, "manifests", attempt)
    report.write.parquet(manifest)  # one run of the tasks; what they say is then fixed
    written = spark.read.schema(schema).parquet(manifest)
    known = F.when(F.count("record_count") == F.count(F.lit(1)), F.sum("record_count"))
    asked = plan.groupBy(*group).agg(F.count(F.lit(1)).alias("asked_inputs"), known.alias("asked_records"))
    l, r = asked.alias("l"), written.alias("r")
    both = l.join(r, reduce(lambda a, b: a & b, (F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in group)), "full")
    right = (F.col("asked_inputs") == F.col("inputs")) & (F.col("records") == F.col("expected")) & (F.col("records") == F.coalesce("asked_records", "records"))
    bad = both.where(~F.coalesce(right, F.lit(False))).count()
    if bad:
        raise InvalidData("rewritten files differ from the plan", groups=bad)
    if not Storage(spark).create(join(out_root, "current.json"), json.dumps({"manifest": manifest}).encode()):
        raise CommitConflict("this output folder has a manifest already", root=out_root)
    return written.drop("expected")


def published(spark: SparkSession, out_root: str) -> DataFrame:
    """The manifest of a finished rewrite."""
    return spark.read.parquet(json.loads(Storage(spark).read(join(out_root, "current.json")))["manifest"])


def write_small_files(rows: DataFrame, keys: list[str], root: str) -> DataFrame:
    """Write the rows of each ``keys`` as one Parquet file, however few they are, and return the listing:
    (keys..., path, record_count, file_size_in_bytes). Tasks stream, so a file may be of any size."""
    schema = rows.select(*keys, F.lit("").alias("path"), F.lit(0).cast("bigint").alias("record_count"), F.lit(0).cast("bigint").alias("file_size_in_bytes")).schema
    folder = join(root, uuid.uuid4().hex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs as pafs

        fs, base = (pafs.LocalFileSystem(), local_path(folder)) if is_local(folder) else pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        now, writer, name, count, done = None, None, None, 0, []

        def close() -> None:
            writer.close()
            done.append((*now, join(folder, name), count, fs.get_file_info(f"{base}/{name}").size))

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            each = list(zip(*columns))
            edges = [0, *(i for i in range(1, len(each)) if each[i] != each[i - 1]), len(each)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if writer is None or each[lo] != now:
                    if writer is not None:
                        close()
                    now, name, count = each[lo], f"{uuid.uuid4().hex}.parquet", 0
                    writer = pq.ParquetWriter(f"{base}/{name}", batch.schema, filesystem=fs)
                writer.write_batch(batch.slice(lo, hi - lo))
                count += hi - lo
        if writer is not None:
            close()
            fields = [batch.schema.field(k) for k in keys] + [pa.field("path", pa.string()), pa.field("record_count", pa.int64()), pa.field("file_size_in_bytes", pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), fields)], schema=pa.schema(fields))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
