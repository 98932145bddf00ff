"""A table at one state: metadata, its views as DataFrames, and the ways to change it."""

from __future__ import annotations

from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.config import TableConfig
from ..core.errors import InvalidData
from ..core.session import small_frame
from ..core.storage import Storage, join, read_object
from ..format.manifest import ADDED, DATA, DELETED, POSITION_DELETES, DataFile, Entry, ManifestFile, decode_list, decode_manifest, inherit
from ..format.metadata import MAIN, TableMetadata
from ..format.types import PartitionSpec, SortOrder, Struct, Transform, evolve, to_spark
from ..functions.paths import object_key, object_key_column
from ..operators.changes import ChangeReport, delete_older, write_changes
from ..operators.compaction import least_loaded
from ..operators.scan import PATH, POS, ScanBuilder
from ..operators.transaction import Transaction
from ..operators.write import FileWriter, partition_key_of


#: Manifest entries that the driver decodes itself at most.
DECODE_HERE = 50_000


class Table:
    def __init__(self, spark, identifier, metadata: TableMetadata, catalog=None, config: TableConfig | None = None, version: int | None = None, metadata_path: str | None = None, history: list[TableMetadata] = ()):
        self.spark, self.identifier, self.catalog = spark, identifier, catalog
        self.config = config or TableConfig()
        self.version, self.metadata_path = version, metadata_path
        self.versions = {m.last_updated_ms: m for m in (*history, metadata)}
        self.metadata = metadata
        self.storage = Storage(spark)
        self.tasks = 0

    @staticmethod
    def from_versions(spark, identifier, versions: list[TableMetadata], current: int | None = None, **kw) -> Table:
        """From several metadata versions; the current one is named by its update time, or the latest."""
        if not versions:
            raise InvalidData("a table needs metadata")
        by_time = {m.last_updated_ms: m for m in versions}
        if current is not None and current not in by_time:
            raise InvalidData("no such metadata version", last_updated_ms=current)
        return Table(spark, identifier, by_time[current if current is not None else max(by_time)], history=versions, **kw)

    def _become(self, other: Table) -> None:
        self.metadata, self.version, self.metadata_path = other.metadata, other.version, other.metadata_path
        self.versions[other.metadata.last_updated_ms] = other.metadata

    def refresh(self) -> Table:
        self._become(self.catalog.load_table(self.identifier))
        return self

    # -- metadata

    @property
    def location(self) -> str:
        return self.metadata.location

    @property
    def schema(self):
        return self.metadata.schema

    @property
    def spec(self) -> PartitionSpec:
        return self.metadata.spec

    def current_snapshot(self):
        return self.metadata.snapshot()

    def partition_type(self, spec_id: int | None = None) -> Struct:
        spec = self.spec if spec_id is None else self.metadata.specs.get(spec_id)
        if spec is None:
            raise InvalidData("no such partition spec", spec_id=spec_id)
        return spec.struct(self.schema)

    def arrow_schema(self):
        return self.schema.to_arrow()

    def absolute_path(self, relative: str) -> str:
        return join(self.location, relative)

    def relative_path(self, absolute: str) -> str:
        """The part below the table's location; paths elsewhere are errors."""
        base, path = object_key(self.location).rstrip("/") + "/", object_key(absolute)
        if not path.startswith(base):
            raise InvalidData("path is not below the table", path=absolute, location=self.location)
        return path[len(base) :]

    def manifests(self, snapshot_id: int | None = None) -> list[ManifestFile]:
        snapshot = self.metadata.snapshot(snapshot_id)
        return [] if snapshot is None else decode_list(self.storage.read(snapshot.manifest_list))

    def entries(self, snapshot_id: int | None = None, wanted=None, keep=None) -> list[Entry]:
        """All entries in manifest order, with inherited numbers filled in.

        ``wanted`` tells from a manifest's summary whether it has to be read at all, ``keep`` which
        entries are wanted. Few entries are decoded here, many by the executors, where ``keep`` runs too, so
        only what it keeps comes to the driver.
        """
        return self._decoded([m for m in self.manifests(snapshot_id) if wanted is None or wanted(m)], keep)

    def _decoded(self, manifests: list[ManifestFile], keep=None) -> list[Entry]:
        if sum(m.added_files + m.existing_files + m.deleted_files for m in manifests) > DECODE_HERE:
            return self._decoded_by_executors(manifests, keep)

        def one(m: ManifestFile) -> list[Entry]:
            return [e for e in inherit(decode_manifest(self.storage.read(m.path))[1], m) if keep is None or keep(e)]

        with ThreadPoolExecutor(min(16, max(1, len(manifests)))) as pool:
            return [e for part in pool.map(one, manifests) for e in part]

    def _decoded_by_executors(self, manifests: list[ManifestFile], keep=None) -> list[Entry]:
        import pickle

        import pyarrow as pa

        def run(batches):
            for b in batches:
                for i, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    m = pickle.loads(blob)
                    found = pickle.dumps([e for e in inherit(decode_manifest(read_object(m.path))[1], m) if keep is None or keep(e)])
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([found], pa.binary())], names=["i", "found"])

        source = self.spark.createDataFrame([(i, bytearray(pickle.dumps(m))) for i, m in enumerate(manifests)], "i int, m binary")
        rows = source.repartition(min(len(manifests), 512)).mapInArrow(run, "i int, found binary")
        return [e for r in sorted(rows.collect(), key=lambda r: r.i) for e in pickle.loads(bytes(r.found))]

    def live_entries(self, snapshot_id: int | None = None, wanted=None, keep=None) -> list[Entry]:
        return self.entries(snapshot_id, wanted, lambda e: e.status != DELETED and (keep is None or keep(e)))

    def data_files(self, snapshot_id: int | None = None) -> list[DataFile]:
        """Data files of a snapshot (the current one); an error if there is none."""
        if self.metadata.snapshot(snapshot_id) is None:
            raise InvalidData("the table has no snapshot")
        return [e.file for e in self.live_entries(snapshot_id) if e.file.content == DATA]

    def delete_files(self, snapshot_id: int | None = None) -> list[DataFile]:
        return [e.file for e in self.live_entries(snapshot_id) if e.file.content != DATA]

    # -- metadata as DataFrames

    def entries_df(self, snapshot_id: int | None = None) -> DataFrame:
        """One row per manifest entry; manifests are decoded by the executors."""
        import json

        import pyarrow as pa

        manifests = self.manifests(snapshot_id)
        partition = T.StructType([T.StructField(f.name, to_spark(f.type)) for s in self.metadata.specs.values() for f in s.struct(self.schema).fields])
        seen: dict[str, T.StructField] = {}
        for f in partition.fields:
            seen.setdefault(f.name, f)
        flat = "status int, snapshot_id bigint, sequence_number bigint, content int, file_path string, file_format string, spec_id int, part string, record_count bigint, file_size_in_bytes bigint, value_counts map<int,bigint>, null_value_counts map<int,bigint>, equality_ids array<int>, sort_order_id int"
        storage_needed = [(m.path, m.spec_id, m.sequence, m.snapshot_id) for m in manifests]
        if not storage_needed:
            rows = self.spark.createDataFrame([], flat)
        else:
            specs = {i: s.struct(self.schema) for i, s in self.metadata.specs.items()}

            def run(batches):
                from ..format.values import value_to_json

                for b in batches:
                    out = []
                    for path, spec_id, seq, sid in zip(*(c.to_pylist() for c in b.columns)):
                        entries = decode_manifest(read_object(path))[1]
                        m = ManifestFile(path, 0, spec_id, 0, seq, seq, sid)
                        for e in inherit(entries, m):
                            d = e.file
                            part = {f.name: value_to_json(f.type, d.partition.get(f.name)) for f in specs[spec_id].fields}
                            out.append((e.status, e.snapshot_id, e.sequence, d.content, d.path, d.format, spec_id, json.dumps(part), d.record_count, d.size, list(d.value_counts.items()), list(d.null_counts.items()), list(d.equality_ids), d.sort_order_id))
                    if out:
                        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.map_(pa.int32(), pa.int64()), pa.map_(pa.int32(), pa.int64()), pa.list_(pa.int32()), pa.int32())
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[x.strip().split(" ")[0] for x in flat.replace("map<int,bigint>", "m").split(",")])

            source = self.spark.createDataFrame(storage_needed, "path string, spec int, seq bigint, sid bigint")
            rows = source.repartition(min(len(storage_needed), 512)).mapInArrow(run, flat)
        text = T.StructType([T.StructField(f.name, T.StringType() if not isinstance(f.dataType, (T.IntegerType, T.LongType, T.BooleanType, T.DoubleType, T.FloatType)) else f.dataType) for f in seen.values()])
        if not seen:
            return rows.withColumn("partition", F.lit(None).cast("string")).drop("part")
        parsed = F.from_json("part", text)
        typed = [self._typed(parsed[f.name], f.dataType).alias(f.name) for f in seen.values()]
        return rows.withColumn("partition", F.struct(*typed)).drop("part")

    @staticmethod
    def _typed(c, kind: T.DataType):
        return F.unhex(F.replace(c, F.lit("-"), F.lit(""))) if isinstance(kind, T.BinaryType) else c.cast(kind)

    def files_df(self, snapshot_id: int | None = None) -> DataFrame:
        return self.entries_df(snapshot_id).where(F.col("status") != DELETED).drop("status", "snapshot_id", "sequence_number")

    def partitions_df(self, snapshot_id: int | None = None) -> DataFrame:
        """Records and files per partition tuple; positions and keys deleted are not subtracted."""
        files = self.files_df(snapshot_id).where(F.col("content") == DATA)
        return files.groupBy("partition").agg(F.sum("record_count").alias("record_count"), F.count(F.lit(1)).alias("file_count"))

    def manifests_df(self, snapshot_id: int | None = None) -> DataFrame:
        rows = [(m.path, m.length, m.spec_id, m.content, m.sequence, m.snapshot_id, m.added_files, m.existing_files, m.deleted_files, m.added_rows, m.existing_rows, m.deleted_rows) for m in self.manifests(snapshot_id)]
        return self.spark.createDataFrame(rows, "path string, length bigint, partition_spec_id int, content int, sequence_number bigint, added_snapshot_id bigint, added_files int, existing_files int, deleted_files int, added_rows bigint, existing_rows bigint, deleted_rows bigint")

    def snapshots_df(self) -> DataFrame:
        rows = [(s.snapshot_id, s.parent_id, s.sequence, s.timestamp_ms, s.summary.get("operation"), s.manifest_list, s.summary) for s in self.metadata.snapshots.values()]
        return self.spark.createDataFrame(rows, "snapshot_id bigint, parent_id bigint, sequence_number bigint, timestamp_ms bigint, operation string, manifest_list string, summary map<string,string>")

    # -- reading

    def new_scan(self) -> ScanBuilder:
        return ScanBuilder(self)

    def to_df(self) -> DataFrame:
        return self.new_scan().to_df()

    # -- writing

    def new_writer(self, partition_id: int = 0, config: TableConfig | None = None) -> FileWriter:
        self.tasks += 1
        return FileWriter(self.spark, self.location, self.schema, self.spec, self.metadata.properties, config or self.config, partition_id, self.tasks, self._bytes_per_row())

    def _bytes_per_row(self) -> float:
        """What a row took so far, by the current snapshot's summary; 0 if there is none or its files are
        too small to tell, because little files are mostly overhead."""
        s = self.current_snapshot()
        size, rows, files = (sum(int(s.summary.get(f"total-{k}", 0)) for k in keys) if s else 0 for keys in (("files-size",), ("records",), ("data-files", "delete-files")))
        return size / rows if rows and files and size / files * 4 >= self.config.target_file_size else 0.0

    def new_transaction(self, branch: str = MAIN) -> Transaction:
        return Transaction(self, branch)

    def append(self, df: DataFrame, partition_col: str | None = None, branch: str = MAIN, sort: bool = False, summary: dict | None = None, properties: dict | None = None) -> Table:
        """Add the rows of ``df`` as one snapshot; an empty ``df`` gives a snapshot without files.
        ``summary`` goes into the snapshot, ``properties`` into the table, with the same commit.

        ``partition_col`` names a struct column with the partition tuple, which is not written.
        ``sort`` orders the rows of each file by the table's sort order.
        """
        files = self.new_writer().data(df, partition_col, self.metadata.sort_order if sort else None)
        return self.new_transaction(branch).append_data_file(*files).set_summary(**(summary or {})).set_properties(**(properties or {})).commit()

    def apply_changes(self, changes: DataFrame, op: str, seq: str, keys: list[str], partition_col: str | None = None, upsert: bool = False, summary: dict | None = None, properties: dict | None = None) -> ChangeReport:
        """Apply inserts (1) and deletes (2) in the order of ``seq`` as one snapshot."""
        ids = [self._field(k).id for k in keys]
        report = write_changes(self, changes, op, seq, ids, partition_col, upsert)
        tx = self.new_transaction().append_data_file(*report.data).append_delete_file(*report.position_deletes, *report.equality_deletes)
        tx.set_summary(**(summary or {})).set_properties(**(properties or {})).commit()
        return report

    def delete_where_equal(self, keys: DataFrame, columns: list[str]) -> Table:
        """Delete all rows of earlier snapshots whose ``columns`` equal a row of ``keys``; null equals null.

        In a partitioned table the delete reaches the partitions of the rows of ``keys``, if these have
        the columns that the partition is made from, otherwise all.
        """
        writer = self.new_writer()
        sources = {self.schema.paths[f.source_id][0] for f in self.spec.fields if f.transform.name != "void"}
        if not sources <= set(keys.columns):
            writer.spec = self.global_spec()
        equality, positions = delete_older(self, writer, keys.distinct(), [self._field(c).id for c in columns])
        return self.new_transaction().append_delete_file(*equality, *positions).commit()

    def files_of_other_specs(self, spec_id: int) -> list[Entry]:
        """Live data files of the current snapshot that were written under another spec."""
        if self.current_snapshot() is None:
            return []
        wanted = lambda m: m.spec_id != spec_id and m.content == DATA and m.added_files + m.existing_files > 0
        return [e for e in self.live_entries(wanted=wanted) if e.file.content == DATA]

    def read_files(self, entries: list[Entry], names: list[str]) -> DataFrame:
        """Columns of the current schema from the given data files, with each row's file and position."""
        place = (F.col("_metadata.file_path").alias(PATH), F.col("_metadata.row_index").alias(POS))
        return self.new_scan()._read([e.file.path for e in entries], names, *place)

    def global_spec(self) -> PartitionSpec:
        """A spec without fields, under which deletes concern the whole table; added if there is none."""
        found = next((s for s in self.metadata.specs.values() if not s.fields), None)
        if found is None:
            spec = PartitionSpec(max(self.metadata.specs) + 1)
            self._update([], [{"action": "add-spec", "spec": spec.to_json()}])
            found = self.metadata.specs[spec.spec_id]
        return found

    def delete_positions(self, positions: DataFrame) -> Table:
        """Delete rows by (file_path, pos), in any spelling of the path; unknown files are errors."""
        files = self.position_files(positions, [e for e in self.live_entries() if e.file.content == DATA])
        return self.new_transaction().append_delete_file(*files).commit()

    def position_files(self, positions: DataFrame, data: list[Entry]) -> list[DataFile]:
        """Position delete files for rows of ``data``, one set per partition; one pass over ``positions``."""
        groups: dict[tuple, list[DataFile]] = defaultdict(list)
        for e in data:
            spec = self.metadata.specs[e.file.spec_id]
            groups[partition_key_of(spec, spec.struct(self.schema), e.file.partition)].append(e.file)
        known = small_frame(self.spark, [(object_key(f.path), f.path, n) for n, fs in enumerate(groups.values()) for f in fs], "k string, known_path string, part int")
        named = positions.select(F.col("file_path").alias("given"), F.col("pos").cast("bigint").alias("pos")).withColumn("k", object_key_column(F.col("given")))
        lost = F.raise_error(F.concat(F.lit("position delete on a file that is not in the table: "), F.coalesce("given", F.lit("null")))).cast("int")
        rows = named.join(known, "k", "left").select(F.col("known_path").alias("file_path"), "pos", F.coalesce("part", lost).alias("part"))
        try:
            return self.new_writer().position_deletes(rows, [(files[0].spec_id, files[0].partition) for files in groups.values()])
        except PySparkException as e:
            if "position delete on a file" in str(e):
                raise InvalidData("position delete on a file that is not in the table", e) from e
            raise

    def overwrite(self, df: DataFrame) -> Table:
        """Replace all rows by those of ``df`` in one snapshot."""
        files = self.new_writer().data(df)
        old = [e.file for e in self.live_entries()] if self.current_snapshot() else []
        return self.new_transaction().append_data_file(*files).remove(*old).commit()

    def compact(self, small_bytes: int | None = None, target_bytes: int | None = None) -> int:
        """Merge small files of each partition and fold deletes in; returns how many files went.

        Rewritten are the data files that a delete reaches, and files below ``small_bytes`` of
        partitions that have at least two of them; the others stay. The files of a partition go, longest
        first, to the least loaded of as many groups as their bytes fill ``target_bytes``, and each
        group becomes one file. Delete files go, because afterwards they reach nothing. Files of
        older specs are written anew under the current one, by the rolling of a write.
        """
        if self.current_snapshot() is None:
            return 0
        target = target_bytes or self.config.target_file_size
        small = small_bytes or target * 3 // 4
        live = self.live_entries()
        data, deletes = [e for e in live if e.file.content == DATA], [e for e in live if e.file.content != DATA]
        scan = self.new_scan()
        reached = scan.reached(data, deletes, self._paths_with_deletes(deletes))
        tuples: dict[tuple, list[Entry]] = defaultdict(list)
        for e in data:
            tuples[scan._tuple(e)].append(e)
        chosen: dict[tuple, list[Entry]] = {}
        for key, entries in tuples.items():
            little = [e for e in entries if e.file.size < small]
            picked = [e for e in entries if id(e) in reached or (len(little) > 1 and e.file.size < small)]
            if picked:
                chosen[key] = picked
        if not chosen and not deletes:
            return 0
        groups: list[tuple[list[Entry], tuple[int, dict]]] = []
        elsewhere: list[Entry] = []
        for entries in chosen.values():
            first = entries[0].file
            if first.spec_id != self.spec.spec_id:
                elsewhere += entries
                continue
            sizes = np.array([e.file.size for e in entries], dtype=np.int64)
            owner = least_loaded(sizes, max(1, round(int(sizes.sum()) / target)))
            for g in range(int(owner.max()) + 1):
                members = [e for e, o in zip(entries, owner) if o == g]
                if members:
                    groups.append((members, (first.spec_id, first.partition)))
        names = [f.name for f in self.schema.fields]
        files: list[DataFile] = []
        if groups:
            numbers = {id(e): n for n, (members, _) in enumerate(groups) for e in members}
            parts = scan._parts([e for members, _ in groups for e in members], deletes, names, 0, numbers)
            files += self.new_writer(config=replace(self.config, target_file_size=target)).groups(reduce(DataFrame.unionByName, parts), [place for _, place in groups])
        if elsewhere:
            parts = scan._parts(elsewhere, deletes, names, 0)
            files += self.new_writer(config=replace(self.config, target_file_size=target)).data(reduce(DataFrame.unionByName, parts))
        gone = [e.file for e in (*(e for entries in chosen.values() for e in entries), *deletes)]
        self.new_transaction().append_data_file(*files).remove(*gone).rewrite().commit(retries=0)
        return len(gone)

    def _paths_with_deletes(self, deletes: list[Entry]) -> set[str]:
        """The data files that position deletes name; as many as there are files at most."""
        files = [e.file.path for e in deletes if e.file.content == POSITION_DELETES]
        if not files:
            return set()
        return {object_key(r[0]) for r in self.spark.read.schema("file_path string").parquet(*files).distinct().collect()}

    # -- evolution and history

    def _field(self, name: str):
        f = self.schema.struct.by_name(name)
        if f is None:
            raise InvalidData("no such column", column=name)
        return f

    def _update(self, requirements: list[dict], updates: list[dict]) -> Table:
        self._become(self.catalog.update_table(self.identifier, [{"type": "assert-table-uuid", "uuid": self.metadata.uuid}, *requirements], updates))
        return self

    def update_schema(self, add=(), drop=(), rename=None, widen=None, make_optional=()) -> Table:
        used = {f.source_id for f in self.spec.fields if f.transform.name != "void"}
        if any(self._field(n).id in used for n in drop):
            raise InvalidData("a partition is made from the column", columns=list(drop))
        schema = evolve(self.schema, self.metadata.last_column_id + 1, add, drop, rename, widen, make_optional)
        schema = replace(schema, schema_id=max(self.metadata.schemas) + 1)
        return self._update(
            [{"type": "assert-current-schema-id", "current-schema-id": self.metadata.current_schema_id}, {"type": "assert-last-assigned-field-id", "last-assigned-field-id": self.metadata.last_column_id}],
            [{"action": "add-schema", "schema": schema.to_json()}, {"action": "set-current-schema", "schema-id": schema.schema_id}],
        )

    def update_spec(self, fields: list) -> Table:
        """New files are partitioned by ``fields``; files there keep their spec."""
        spec = PartitionSpec.build(self.schema, fields, max(self.metadata.specs) + 1)
        first = self.metadata.last_partition_id + 1
        spec = replace(spec, fields=tuple(replace(f, field_id=first + i) for i, f in enumerate(spec.fields)))
        return self._update([{"type": "assert-default-spec-id", "default-spec-id": self.metadata.default_spec_id}], [{"action": "add-spec", "spec": spec.to_json()}, {"action": "set-default-spec", "spec-id": spec.spec_id}])

    def update_sort_order(self, fields: list[tuple[str, bool]]) -> Table:
        from ..format.types import SortField

        order = SortOrder(max(self.metadata.sort_orders) + 1, tuple(SortField(self._field(n).id, Transform("identity"), asc, asc) for n, asc in fields))
        return self._update([], [{"action": "add-sort-order", "sort-order": order.to_json()}, {"action": "set-default-sort-order", "sort-order-id": order.order_id}])

    def set_properties(self, **properties: str) -> Table:
        return self._update([], [{"action": "set-properties", "updates": properties}])

    def set_ref(self, name: str, snapshot_id: int, kind: str = "tag", **retention: int) -> Table:
        """Create or move a branch or tag; retention arguments in the protocol's names with underscores."""
        extra = {k.replace("_", "-"): v for k, v in retention.items()}
        return self._update([], [{"action": "set-snapshot-ref", "ref-name": name, "type": kind, "snapshot-id": snapshot_id, **extra}])

    def rollback_to(self, snapshot_id: int) -> Table:
        seen, s = set(), self.current_snapshot()
        while s is not None and s.snapshot_id not in seen:
            seen.add(s.snapshot_id)
            s = self.metadata.snapshots.get(s.parent_id)
        if snapshot_id not in seen:
            raise InvalidData("not an ancestor of the current snapshot", snapshot_id=snapshot_id)
        return self.set_ref(MAIN, snapshot_id, "branch")

    def cherry_pick(self, snapshot_id: int) -> Table:
        """Append the files that a snapshot outside the current history appended, as a new snapshot, once."""
        picked = self.metadata.snapshot(snapshot_id)
        if picked.summary.get("operation") != "append":
            raise InvalidData("only an append can be picked", snapshot_id=snapshot_id)
        seen, s = set(), self.current_snapshot()
        while s is not None and s.snapshot_id not in seen:
            seen |= {s.snapshot_id, int(s.summary.get("source-snapshot-id", s.snapshot_id))}
            s = self.metadata.snapshots.get(s.parent_id)
        if snapshot_id in seen:
            raise InvalidData("the snapshot is in the history already", snapshot_id=snapshot_id)
        own = [e for e in self.entries(snapshot_id, lambda m: m.snapshot_id == snapshot_id) if e.status == ADDED and e.snapshot_id == snapshot_id]
        return self.new_transaction().append_data_file(*(e.file for e in own)).set_summary(**{"source-snapshot-id": str(snapshot_id)}).commit()

    def expire_snapshots(self, older_than_ms: int, keep: int = 1, remove_files: bool = False) -> list[int]:
        """Forget old snapshots that no reference needs; returns their ids.

        With ``remove_files`` the manifests, data and delete files go that only they needed. Files of
        writes that were never committed are not known here and stay.
        """
        held = {r["snapshot-id"] for r in self.metadata.refs.values()}
        by_age = sorted(self.metadata.snapshots.values(), key=lambda s: -s.timestamp_ms)
        ids = [s.snapshot_id for s in by_age[keep:] if s.timestamp_ms < older_than_ms and s.snapshot_id not in held]
        if not ids:
            return ids
        old = {i: (self.metadata.snapshots[i].manifest_list, self.manifests(i)) for i in ids}
        self._update([], [{"action": "remove-snapshots", "snapshot-ids": ids}])
        if remove_files:
            kept: dict[str, ManifestFile] = {m.path: m for i in self.metadata.snapshots for m in self.manifests(i)}
            gone = {m.path: m for _, ms in old.values() for m in ms if m.path not in kept}
            files = {e.file.path for e in self._decoded(list(gone.values()))}
            # A file may be named by a manifest of a snapshot that stays, where it was carried on.
            files -= {e.file.path for e in self._decoded(list(kept.values())) if e.status != DELETED} if files else set()
            with ThreadPoolExecutor(16) as pool:
                list(pool.map(self.storage.delete, [*files, *gone, *(path for path, _ in old.values())]))
        return ids
