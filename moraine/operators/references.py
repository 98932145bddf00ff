"""References to objects that do not exist: ranges of sorted keys, probed by binary search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core.session import parallelism
from ..functions.paths import canonical_path


def object_index(listing: DataFrame) -> DataFrame:
    """(object, created_ms, deleted_ms): the latest listing of every object in the store.

    Objects are compared in one spelling. A null path gives no row; among listings with equal
    times the one that shows the object as present wins.
    """
    newest = F.max_by(
        F.struct("created_ms", "deleted_ms"),
        F.struct(F.coalesce("listed_ms", F.lit(-(2**62))), F.col("deleted_ms").isNull(), F.coalesce("created_ms", F.lit(0))),
    )
    return (
        listing.where(F.col("file_path").isNotNull())
        .select(canonical_path(F.col("file_path")).alias("object"), "created_ms", "deleted_ms", "listed_ms")
        .groupBy("object")
        .agg(newest.alias("x"))
        .select("object", "x.created_ms", "x.deleted_ms")
    )


#: Rows of a range, parents and references together: few, while there are not very many ranges ...
SMALL_RANGE, MANY_RANGES = 1 << 15, 20_000
#: ... and at most so many, about, in any case.
LARGE_RANGE = 1_000_000


def range_number(rows: int, at_least: int) -> int:
    return max(at_least, min(-(-rows // SMALL_RANGE), MANY_RANGES), -(-rows // LARGE_RANGE))


def _range_of(key: Column, ranges: int) -> Column:
    """Ranges of equal width over the 64-bit key space; the keys are hashes, so ranges fill evenly."""
    width = 2**64 // ranges + 1
    return F.floor((key.cast("double") + F.lit(float(2**63))) / F.lit(float(width))).cast("int")


def probe_references(refs: DataFrame, objects: DataFrame, rows: int) -> DataFrame:
    """Give every reference its ``state``: missing, deleted, late or found.

    ``refs`` has ref_table, table_uuid, ref_path, at_ms and object; ``objects`` the columns of
    ``object_index``; ``rows`` is an upper bound of both together and sets the number of ranges. Both
    sides are cut into the same ranges of a 64-bit key, one range to a task. A task first reads the parents of its range,
    which are unique and therefore bounded, into sorted arrays; then batches of references stream
    past and are looked up by binary search, so any number of references may share a key. Hits are
    confirmed on the object's name: equal hashes of different names do no harm. A null time is
    never late.
    """
    ranges = range_number(rows, parallelism(refs.sparkSession))
    key = F.xxhash64("object")
    none = lambda kind: F.lit(None).cast(kind)
    have = objects.select(
        F.lit(0).alias("tag"), key.alias("k"), "object", F.col("created_ms").cast("bigint").alias("created_ms"), F.col("deleted_ms").cast("bigint").alias("deleted_ms"),
        none("string").alias("ref_table"), none("string").alias("table_uuid"), none("string").alias("ref_path"), none("bigint").alias("at_ms"),
    )
    want = refs.select(
        F.lit(1).alias("tag"), key.alias("k"), "object", none("bigint").alias("created_ms"), none("bigint").alias("deleted_ms"),
        "ref_table", "table_uuid", "ref_path", F.col("at_ms").cast("bigint").alias("at_ms"),
    )
    both = have.unionByName(want).repartitionById(ranges, _range_of(F.col("k"), ranges)).sortWithinPartitions("tag", "k")
    schema = "ref_table string, table_uuid string, ref_path string, at_ms bigint, state string"

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded: list[pa.RecordBatch] = []
        parents_ = None
        for batch in batches:
            first_ref = int(np.searchsorted(batch.column("tag").to_numpy(), 1))
            if first_ref:
                loaded.append(batch.slice(0, first_ref).select(["k", "object", "created_ms", "deleted_ms"]))
            if first_ref == batch.num_rows:
                continue
            if parents_ is None:
                parents_ = _sorted_arrays(loaded)
                loaded = []
            ref = batch.slice(first_ref)
            state = _lookup(ref, *parents_)
            yield pa.RecordBatch.from_arrays(
                [*(ref.column(c) for c in ("ref_table", "table_uuid", "ref_path", "at_ms")), pa.array(state, pa.string())],
                names=["ref_table", "table_uuid", "ref_path", "at_ms", "state"],
            )

    return both.mapInArrow(probe, schema)


def _float(column) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)  # milliseconds fit; null becomes NaN


def _sorted_arrays(batches: list[pa.RecordBatch]):
    if not batches:
        return np.empty(0, np.int64), pa.array([], pa.string()), np.empty(0), np.empty(0)
    table = pa.Table.from_batches(batches).combine_chunks()
    parts = [table.column(c).combine_chunks() for c in ("k", "object", "created_ms", "deleted_ms")]
    return parts[0].to_numpy(), parts[1], _float(parts[2]), _float(parts[3])


def _lookup(ref: pa.RecordBatch, keys: np.ndarray, names: pa.Array, created: np.ndarray, deleted: np.ndarray) -> np.ndarray:
    state = np.full(ref.num_rows, "missing", dtype=object)
    if not len(keys):
        return state
    want, wanted, when = ref.column("k").to_numpy(), ref.column("object"), _float(ref.column("at_ms"))
    at = np.searchsorted(keys, want)
    open_ = np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == want))
    while len(open_):  # more than one turn only where hashes collide
        pos = at[open_]
        same = pc.equal(names.take(pa.array(pos)), wanted.take(pa.array(open_))).to_numpy(zero_copy_only=False)
        row, src = open_[same], pos[same]
        late = np.where(created[src] > when[row], "late", "found")
        state[row] = np.where(np.isnan(deleted[src]), late, "deleted")
        rest = open_[~same]
        at[rest] += 1
        rest = rest[at[rest] < len(keys)]
        open_ = rest[keys[at[rest]] == want[rest]]
    return state


def lake_references(snapshots: DataFrame, metadata_log: DataFrame, entries: DataFrame) -> DataFrame:
    """(ref_table, table_uuid, ref_path, at_ms, object): what the metadata refers to, each once.

    Manifest lists of snapshots, logged metadata files, and the files of manifest entries whose
    table has no removal entry for the path. The time of several rows is the earliest; that of an
    entry is its snapshot's. Null paths give no row.
    """
    lists = snapshots.select("table_uuid", F.col("manifest_list").alias("ref_path"), F.col("timestamp_ms").alias("at_ms"), F.lit("snapshots").alias("ref_table"))
    logs = metadata_log.select("table_uuid", F.col("metadata_file").alias("ref_path"), F.col("timestamp_ms").alias("at_ms"), F.lit("metadata_log").alias("ref_table"))
    times = (
        snapshots.select("table_uuid", F.col("snapshot_id").alias("sid"), "timestamp_ms")
        .groupBy("table_uuid", "sid")
        .agg(F.min("timestamp_ms").alias("at_ms"))
    )
    files = (
        entries.select("table_uuid", F.coalesce("snapshot_id", "added_snapshot_id").alias("sid"), F.col("file_path").alias("ref_path"), (F.col("status") == 2).alias("gone"))
        .join(times, ["table_uuid", "sid"], "left")
        .select("table_uuid", "ref_path", "at_ms", F.lit("manifest_entries").alias("ref_table"), F.coalesce("gone", F.lit(False)).alias("gone"))
    )
    every = lists.withColumn("gone", F.lit(False)).unionByName(logs.withColumn("gone", F.lit(False))).unionByName(files)
    return (
        every.where(F.col("ref_path").isNotNull())
        .groupBy("ref_table", "table_uuid", "ref_path")
        .agg(F.min("at_ms").alias("at_ms"), F.max("gone").alias("gone"))
        .where(~F.col("gone"))
        .select("ref_table", "table_uuid", "ref_path", "at_ms", canonical_path(F.col("ref_path")).alias("object"))
    )


def orphan_references(refs: DataFrame, listing: DataFrame, most: int) -> DataFrame:
    """(ref_table, table_uuid, ref_path, period, state) of references that are not found.

    ``most`` is an upper bound of the references, which sets how finely the work is cut.
    ``period`` is the UTC month of the reference's time as YYYY-MM, null when there is no time.
    """
    probed = probe_references(refs, object_index(listing), listing.count() + most).where("state <> 'found'")
    period = F.date_format(F.timestamp_millis("at_ms"), "yyyy-MM")
    return probed.select("ref_table", "table_uuid", "ref_path", period.alias("period"), "state")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted per referring table, period and state."""
    return orphans.groupBy("ref_table", "table_uuid", "period", "state").agg(F.count(F.lit(1)).alias("orphans"))
