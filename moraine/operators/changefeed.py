"""Applying a stream of inserts, updates and deletes: bucketed copy-on-write.

The base table lies in hash buckets of its key. Changes are routed to their buckets; only touched
buckets are read again, sort-merged with their changes and written anew. One exclusively created manifest
names the files of each version, so readers see a version whole, and a crashed or repeated apply
leaves the table as it was. Of each key the change with the greatest sequence holds, so changes may come
late, repeated and in any order, in one feed or several.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.errors import CommitConflict, InvalidData
from ..core.session import parallelism
from ..core.storage import Storage, join
from ..functions.paths import canonical_path

#: Buckets of one table at most: their numbers and files are named in its manifest.
MAX_BUCKETS = 1 << 15
#: Hash values of deletes by which rows are routed; the list of those in use is broadcast, at most 256 KB.
ROUTES = 1 << 15
#: Feed rows per bucket of the table, about.
BUCKET_ROWS = 500_000

#: Columns of the delta tables by field id.
FIELDS = {1: "row_id", 2: "row_key", 3: "row_value"}
DELETED = "deleted"


class BucketedTable:
    """A copy-on-write table of rows with a ``key`` and a sequence, in hash buckets.

    A row that is deleted stays as a tombstone, which ``read`` does not show, so that an older change
    of its key that comes later finds it.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str], sequence: str = "sequence"):
        self.spark, self.root, self.key, self.sequence = spark, root, list(key), sequence
        self.storage = Storage(spark)

    def _manifest_name(self, version: int) -> str:
        return join(self.root, "manifests", f"{version:012d}.json")

    def version(self) -> int:
        names = [n for n, _ in self.storage.listing(join(self.root, "manifests")) if n.endswith(".json")]
        return max((int(n.split(".")[0]) for n in names), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return json.loads(self.storage.read(self._manifest_name(version)))

    def bucket_of(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int")

    def _commit(self, version: int, manifest: dict) -> None:
        if not self.storage.create(self._manifest_name(version), json.dumps(manifest).encode()):
            raise CommitConflict("another writer committed this version", version=version)

    def _newest(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """One row per key: that of the greatest sequence. Of equal sequences a delete wins, then the
        greatest values."""
        rest = [n for n in names if n not in (*self.key, self.sequence, DELETED)]
        best = F.max(F.struct(self.sequence, DELETED, *rest)).alias("best")
        return rows.groupBy("bucket", *self.key).agg(best).select("bucket", *(F.col(n if n in self.key else f"best.{n}") for n in names))

    def _write(self, rows: DataFrame, names: list[str], version: int, buckets: int) -> dict[str, list[str]]:
        """Merge ``rows`` (with ``bucket``) by key and write them under a fresh folder; files by bucket.

        Each bucket goes to a task of its own, where the merge rides on the partitioning.
        """
        folder = join(self.root, "data", f"v{version}-{uuid.uuid4().hex}")
        merged = self._newest(rows.repartitionById(buckets, F.col("bucket")), names)
        merged.sortWithinPartitions("bucket", *self.key).write.partitionBy("bucket").option("compression", "zstd").parquet(folder)
        found = {}
        for name, is_dir in self.storage.listing(folder):
            if is_dir and name.startswith("bucket="):
                inner = join(folder, name)
                found[name.split("=")[1]] = [join(inner, f) for f, _ in self.storage.listing(inner) if f.endswith(".parquet")]
        return found

    def create(self, schema: T.StructType, buckets: int) -> None:
        """Version 0: no rows. ``schema`` has the key, the sequence and further columns of types that
        can be ordered; null keys equal each other."""
        if not set(self.key) | {self.sequence} <= set(schema.names) or DELETED in schema.names:
            raise InvalidData("the schema needs key and sequence, and no column for deletes", columns=schema.names)
        shape = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields]).add(DELETED, T.BooleanType())
        self._commit(0, {"buckets": max(1, min(buckets, MAX_BUCKETS)), "files": {}, "schema": shape.jsonValue()})

    def _rows(self, m: dict, paths: list[str]) -> DataFrame:
        schema = T.StructType.fromJson(m["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version that are not deleted."""
        m = self.manifest(version)
        return self._rows(m, [f for fs in m["files"].values() for f in fs]).where(~F.col(DELETED)).drop(DELETED)

    def apply(self, changes: DataFrame, **extra) -> int:
        """Apply inserts, updates and deletes; returns the new version.

        ``changes`` has the key, the sequence, ``deleted`` and, for rows that are not, the other columns;
        columns of its own are ignored, missing ones are null. Whether a key is there before does not matter.
        Changes of one key are reduced to the newest before they are routed, so a hot key is one row
        in its bucket. Buckets without a change keep their files. ``extra`` goes into the manifest.
        """
        base = self.version()
        m = self.manifest(base)
        shape = T.StructType.fromJson(m["schema"])
        have = set(changes.columns)
        typed = [(F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape.fields]
        routed = changes.select(*typed).withColumn(DELETED, F.coalesce(DELETED, F.lit(False))).withColumn("bucket", self.bucket_of(m["buckets"]))
        staged, seen = join(self.root, "changes", uuid.uuid4().hex), Observation()
        # They are needed for the routing and for the merge. As many buckets as the table has at most.
        self._newest(routed, shape.names).observe(seen, F.collect_set("bucket").alias("touched")).write.option("compression", "zstd").parquet(staged)
        staged_rows = self.spark.read.schema(T.StructType([*shape.fields, T.StructField("bucket", T.IntegerType())])).parquet(staged)
        touched = {str(b) for b in (seen.get["touched"] if self._wrote(staged) else [])}
        old = [f for b, fs in m["files"].items() if b in touched for f in fs]
        new = {}
        if touched:
            rows = staged_rows.unionByName(self._rows(m, old).withColumn("bucket", self.bucket_of(m["buckets"]))) if old else staged_rows
            new = self._write(rows, shape.names, base + 1, m["buckets"])
        kept = {b: fs for b, fs in m["files"].items() if b not in touched}
        self._commit(base + 1, {**m, **extra, "files": {**kept, **new}})
        self.storage.delete(staged, recursive=True)
        return base + 1

    def _wrote(self, folder: str) -> bool:
        """Whether a job left files; the metrics of a plan that is known to be empty are never filled."""
        return any(n.endswith(".parquet") or (d and self._wrote(join(folder, n))) for n, d in self.storage.listing(folder))

    def expire(self, keep: int = 1) -> None:
        """Delete data files that none of the ``keep`` newest versions names."""
        newest = self.version()
        live = {f for v in range(max(0, newest - keep + 1), newest + 1) for fs in self.manifest(v)["files"].values() for f in fs}
        for v in range(0, newest - keep + 1):
            for fs in self.manifest(v)["files"].values():
                for f in fs:
                    if f not in live:
                        self.storage.delete(f)


def feed_files(entries: DataFrame, snapshots: DataFrame, feed: DataFrame) -> DataFrame:
    """(file_id, table_uuid, file_path, object, content, equality_ids, sequence, removed), one row per
    file of the tables in the feed.

    The sequence is that of the entry that added the file, or its snapshot's when null; a file
    never seen as added takes the number of any of its entries. Files without any number, without
    a path or a content give no row. ``file_id`` is a digest of table and path, the same in every feed.
    """
    tables = feed.select("table_uuid").distinct()
    snaps = (
        snapshots.select("table_uuid", F.col("snapshot_id").alias("sid"), F.col("sequence_number").alias("snap_seq"))
        .groupBy("table_uuid", "sid")
        .agg(F.max("snap_seq").alias("snap_seq"))
    )
    rows = (
        entries.where(F.col("file_path").isNotNull())
        .select(
            "table_uuid", "file_path", F.coalesce("snapshot_id", "added_snapshot_id").alias("sid"), "status", "content",
            F.array_sort("equality_ids").alias("equality_ids"), "sequence_number",
        )
        .join(tables, "table_uuid", "left_semi")
    )
    return (
        rows.join(snaps, ["table_uuid", "sid"], "left")
        .groupBy("table_uuid", "file_path")
        .agg(
            F.max("content").alias("content"),
            F.max("equality_ids").alias("equality_ids"),
            F.coalesce(
                F.max(F.when(F.col("status") == 1, F.coalesce("sequence_number", "snap_seq"))), F.max("sequence_number")
            ).alias("sequence"),
            F.max(F.coalesce(F.col("status") == 2, F.lit(False))).alias("removed"),
        )
        .where(F.col("sequence").isNotNull() & F.col("content").isNotNull())
        .select(F.unhex(F.md5(F.concat("table_uuid", F.lit("\n"), "file_path"))).alias("file_id"), "*", canonical_path(F.col("file_path")).alias("object"))
    )


def victims_of_positions(deletes: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, row_pos, sequence): one delete per position of every data file that is meant.

    ``deletes``: object, del_offset, sequence. One object may be listed under several spellings; each of its
    files is meant. Deletes of one position are reduced to the newest before they meet the files.
    """
    newest = deletes.groupBy("object", F.col("del_offset").alias("row_pos")).agg(F.max("sequence").alias("sequence"))
    return newest.join(files.where("content = 0").select("object", "file_id"), "object").select("file_id", "row_pos", "sequence")


def newest_keys(deletes: DataFrame, fields: dict[int, str]) -> DataFrame:
    """(equality_ids, table_uuid, fields..., sequence): the newest delete of each set of values; fields that
    are not among the ids are null."""
    values = [F.when(F.array_contains("equality_ids", i), F.col(n)).alias(n) for i, n in fields.items()]
    return deletes.select("equality_ids", "table_uuid", *values, "sequence").groupBy("equality_ids", "table_uuid", *fields.values()).agg(F.max("sequence").alias("sequence"))


def victims_of_keys(rows: DataFrame, deletes: DataFrame, masks: list[tuple[int, ...]], fields: dict[int, str], key: list[str]) -> DataFrame:
    """(key..., sequence) of rows older than an equality delete of their table with equal values, the
    sequence being the delete's. Null equals null.

    ``deletes`` as ``newest_keys`` gives them. A row looks itself up once for every set of field ids in
    ``masks``, all in one join. Rows whose lookup no delete can equal stay out of the shuffle. Deletes are
    one per set of values, so a hot value's rows meet one delete and adaptive execution can split them.
    """
    hashed = F.xxhash64("equality_ids", "table_uuid", *fields.values(), *(F.col(n).isNull() for n in fields.values()))
    wanted = deletes.withColumn("h", hashed)
    of = lambda ids: F.struct(F.array(*(F.lit(i) for i in ids)).alias("equality_ids"), *((F.col(n) if i in ids else F.lit(None).cast("bigint")).alias(n) for i, n in fields.items()))
    lookups = rows.select(*key, "table_uuid", "sequence", F.explode(F.array(*map(of, masks))).alias("m")).select(*key, "table_uuid", "sequence", "m.*").withColumn("h", hashed)
    route = lambda df: df.withColumn("route", F.pmod("h", F.lit(ROUTES)).cast("int"))
    near = route(lookups).join(F.broadcast(route(wanted).select("route").distinct()), "route", "left_semi")
    l, r = near.alias("l"), wanted.alias("r")
    same = (F.col("l.h") == F.col("r.h")) & (F.col("l.table_uuid") == F.col("r.table_uuid")) & (F.col("l.equality_ids") == F.col("r.equality_ids"))
    same = reduce(lambda a, c: a & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), fields.values(), same)
    return l.join(r, same & (F.col("r.sequence") > F.col("l.sequence"))).select(*(f"l.{k}" for k in key), "r.sequence")


def apply_feed(
    spark: SparkSession, entries: DataFrame, snapshots: DataFrame, feed: DataFrame, root: str, bucket_rows: int = BUCKET_ROWS, fields: dict[int, str] | None = None
) -> tuple[BucketedTable, DataFrame]:
    """Bring the current rows of all delta tables under ``root`` up to date with one more feed.

    Returns the bucketed table, whose rows carry a ``file_id``, and the files by that number. Order of
    arrival does not matter, within a feed or between feeds: sequence numbers decide, and deletes are
    kept for rows that come later. ``entries`` and ``snapshots`` are the whole manifests at that time; rows of files
    that they do not know are ignored, as are deletes that hit nothing and data rows without a position;
    a delete needs no position of its own. Repeated feed rows count once; rows of files removed since go.
    ``fields`` names the feed's value columns by field id, all of them long.
    """
    fields, key = fields or FIELDS, ["file_id", "row_pos"]
    work = join(root, "work", uuid.uuid4().hex)

    def written(df: DataFrame, name: str, *parts: str) -> DataFrame:
        df.write.option("compression", "zstd").partitionBy(*parts).parquet(join(work, name))
        return spark.read.schema(df.schema).parquet(join(work, name))

    files = written(feed_files(entries, snapshots, feed), "files")
    wanted = ["table_uuid", "file_path", "row_pos", *fields.values(), "del_path", "del_offset"]
    known = feed.where(F.col("file_path").isNotNull()).select(*wanted)
    tagged = (
        known.join(files.drop("object"), ["table_uuid", "file_path"])  # a large file can be split here
        .where("content <> 0 or row_pos is not null and not removed")
        .select(
            "file_id", "table_uuid", "row_pos", *fields.values(), "sequence", "equality_ids",
            F.when(F.col("content") == 1, canonical_path(F.col("del_path"))).alias("object"), "del_offset", "content",
        )
    )
    counted = Observation()
    tagged = written(tagged.observe(counted, F.count(F.lit(1)).alias("rows")), "feed", "content")
    table = BucketedTable(spark, root, key)
    columns = ["file_id", "table_uuid", "row_pos", *fields.values(), "sequence"]
    fresh = tagged.where("content = 0").select(*columns)
    if table.version() < 0:
        some = counted.get["rows"] if table._wrote(join(work, "feed")) else 0
        table.create(fresh.schema, max(parallelism(spark), -(-some // bucket_rows)))
    m = table.manifest()
    base = table.read() if m["files"] else None

    as_delete = lambda df: df.select(*key, "sequence", F.lit(True).alias(DELETED))
    positions = tagged.where("content = 1 and object is not null and del_offset is not null")
    changes = [fresh.withColumn(DELETED, F.lit(False)), as_delete(victims_of_positions(positions, files))]
    # Distinct sets of field ids: at most 2^fields - 1, whatever the size of the feed.
    masks = {tuple(sorted(set(r[0]))) for r in files.where("content = 2 and size(equality_ids) > 0").select("equality_ids").distinct().collect()}
    for ids in masks:
        if any(i not in fields for i in ids):
            raise InvalidData("equality delete on an unknown field", ids=ids)
    kept, shape = m.get("deletes", []), f"equality_ids array<int>, table_uuid string, {', '.join(f'{n} bigint' for n in fields.values())}, sequence bigint"
    older = {tuple(x) for x in m.get("masks", [])}
    now = None
    if masks:
        some = tagged.where("content = 2 and size(equality_ids) > 0").withColumn("equality_ids", F.array_sort(F.array_distinct("equality_ids")))
        place = join(root, "deletes", uuid.uuid4().hex)
        newest_keys(some, fields).write.option("compression", "zstd").parquet(place)
        now, kept = spark.read.schema(shape).parquet(place), [*kept, place]
    if kept:  # rows of this feed, by all deletes so far
        changes.append(as_delete(victims_of_keys(fresh, spark.read.schema(shape).parquet(*kept), sorted(masks | older), fields, key)))
    if base is not None and now is not None:
        changes.append(as_delete(victims_of_keys(base, now, sorted(masks), fields, key)))
    if base is not None:
        gone = base.select(*key, "sequence").join(files.where("removed").select("file_id"), "file_id", "left_semi")
        changes.append(as_delete(gone))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), changes)
    table.apply(rows, deletes=kept, masks=sorted(masks | older))
    table.expire()
    table.storage.delete(join(work, "feed"), recursive=True)
    return table, files
