"""Writing table files: partitioning, sizes, names, and the statistics of what was written.

One write is one Spark job. Rows are aligned with the table's schema, get their partition tuple
from the transforms (or bring it), are spread by Spark's rebalancing so that a hot partition is
split over tasks, and end as Parquet files with field ids. Files of other writers are never touched.
"""

from __future__ import annotations

import datetime as dt
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.config import TableConfig
from ..core.errors import InvalidData
from ..core.storage import Storage, is_local, join, local_path
from ..format.manifest import DATA, DELETE_PATH_ID, DELETE_POS_ID, EQUALITY_DELETES, POSITION_DELETES, DataFile
from ..format.types import FIELD_ID, PartitionSpec, Primitive, Schema, SortOrder, Struct, to_spark
from ..format.values import to_bytes
from ..functions.transforms import micros_of, transform_column

PART, PKEY, GROUP = "__partition", "__pkey", "__group"
#: Rows of a first write that are measured to learn how many fill a file; the driver holds them for that.
PROBE_ROWS = 2048
SEQ_COLUMN, SEQ_ID = "__change_seq", 2147483447
TIMESTAMP_TYPE = "spark.sql.parquet.outputTimestampType"


def data_folder(location: str, properties: dict[str, str]) -> str:
    """Where data files go: below the table's location, wherever its properties say."""
    folder = properties.get("write.data.path") or properties.get("write.folder-storage.path") or join(location, "data")
    if not (folder.rstrip("/") + "/").startswith(location.rstrip("/") + "/"):
        raise InvalidData("the data folder must lie below the table", folder=folder, location=location)
    return folder.rstrip("/")


def file_name(partition_id: int, task: int, write_id: str, number: int, suffix: str = "") -> str:
    return f"{partition_id:05d}-{task}-{write_id}-{number:05d}{'-' + suffix if suffix else ''}.parquet"


def nullable(schema: T.DataType) -> T.DataType:
    """The same type with every part nullable, as Parquet files are written."""
    if isinstance(schema, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True, f.metadata) for f in schema.fields])
    if isinstance(schema, T.ArrayType):
        return T.ArrayType(nullable(schema.elementType), True)
    if isinstance(schema, T.MapType):
        return T.MapType(schema.keyType, nullable(schema.valueType), True)
    return schema


def align(df: DataFrame, schema: Schema, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of the table by name, cast to its types; extra columns go, except those in ``keep``.

    A missing optional column is filled with its write default, else null; a missing required one
    is an error. Uuids may come as text.
    """
    have = {f.name: f.dataType for f in df.schema.fields}
    out: list[Column] = []
    for f in schema.fields:
        kind = to_spark(f.type)
        if f.name not in have:
            if f.required and f.write_default is None:
                raise InvalidData("required column is missing", column=f.name)
            c = F.lit(f.write_default).cast(kind)
        else:
            c = F.col(f"`{f.name}`")
            if f.type == Primitive("uuid") and isinstance(have[f.name], T.StringType):
                c = F.unhex(F.replace(c, F.lit("-"), F.lit("")))
            elif have[f.name] != kind:
                c = c.cast(nullable(kind))
        out.append(c.alias(f.name))
    return df.select(*out, *(F.col(f"`{k}`") for k in keep))


def partition_columns(schema: Schema, spec: PartitionSpec) -> list[tuple[str, Primitive, Column]]:
    """(name, type, expression) of each partition field."""
    out = []
    for p in spec.fields:
        source = schema.find(p.source_id).type
        out.append((p.name, p.transform.result(source), transform_column(p.transform, F.col(schema.column_path(p.source_id)), source)))
    return out


def _key_text(c: Column, t: Primitive) -> Column:
    """Text that tells any two values of the type apart, also beside others: its length comes first."""
    if t.name in ("timestamp", "timestamptz"):
        c = micros_of(c, t)
    elif t.name in ("binary", "uuid") or t.fixed_length is not None:
        c = F.hex(c)
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))


def with_partition(df: DataFrame, schema: Schema, spec: PartitionSpec, partition_col: str | None = None) -> DataFrame:
    """``df`` with the partition tuple (a struct) and a short key of it."""
    parts = partition_columns(schema, spec)
    if partition_col is not None:
        given = df.schema[partition_col].dataType
        names = [p[0] for p in parts]
        if not isinstance(given, T.StructType) or sorted(given.names) != sorted(names):
            raise InvalidData("the partition column does not fit the spec", want=names, got=given.simpleString())
        parts = [(n, t, F.col(f"`{partition_col}`.`{n}`").cast(to_spark(t))) for n, t, _ in parts]
    packed = df.withColumn(PART, F.struct(*(c.alias(n) for n, _, c in parts)))
    text = [_key_text(F.col(f"{PART}.`{n}`"), t) for n, t, _ in parts]
    return packed.withColumn(PKEY, F.md5(F.concat(F.lit(""), *text)))


def python_value(t: Primitive, v):
    if v is None:
        return None
    if t.name == "timestamptz" and v.tzinfo is None:
        return v.astimezone(dt.timezone.utc)
    if t.name == "uuid":
        return uuid.UUID(bytes=bytes(v))
    if t.name == "binary" or t.fixed_length is not None:
        return bytes(v)
    return v


@dataclass
class Written:
    files: list[DataFile]
    rows: int


class FileWriter:
    """Writes files of one kind for one table state."""

    def __init__(self, spark, location: str, schema: Schema, spec: PartitionSpec, properties: dict, config: TableConfig, partition_id: int = 0, task: int = 0, bytes_per_row: float = 0.0):
        self.bytes_per_row = bytes_per_row
        self.spark, self.schema, self.spec, self.config = spark, schema, spec, config
        self.folder = data_folder(location, properties)
        self.storage = Storage(spark)
        self.partition_id, self.task, self.write_id, self.number = partition_id, task, str(uuid.uuid4()), 0
        self.metrics = {"writes": 0, "files": 0, "partitions": 0, "rows": 0, "bytes": 0, "seconds": 0.0}

    # -- data files

    def data(self, df: DataFrame, partition_col: str | None = None, sort: SortOrder | None = None, keep: tuple[str, ...] = ()) -> list[DataFile]:
        """Data files of ``df``; rows keep no order unless ``sort`` asks for one within each file."""
        extra = (*keep, *([partition_col] if partition_col else []))
        rows = align(df, self.schema, extra)
        shape = nullable(self.schema.to_spark())
        for k in keep:
            shape = shape.add(T.StructField(k, T.LongType(), True, {FIELD_ID: SEQ_ID}))
        order = self._sort_columns(sort)
        files = self._write(rows, shape, partition_col, order, self._rows_per_file(rows, shape))
        self._check(files)
        if sort is not None and sort.fields:
            files = [replace(f, sort_order_id=sort.order_id) for f in files]
        return files

    def single(self, df: DataFrame) -> DataFile | None:
        """All rows of ``df``, of one partition, in one file whatever its size; None for no rows."""
        rows = align(df, self.schema).coalesce(1)
        files = self._write(rows, nullable(self.schema.to_spark()), None, [], 0, spread=False)
        if len(files) > 1:
            for f in files:
                self.storage.delete(f.path)
            raise InvalidData("rows of several partitions do not fit into one file", files=len(files))
        self._check(files)
        return files[0] if files else None

    def groups(self, df: DataFrame, places: list[tuple[int, dict]]) -> list[DataFile]:
        """One file for each number in the column ``GROUP``: ``places`` has its (spec id, partition tuple)."""
        keyed = df.withColumn(PKEY, F.col(GROUP).cast("string")).repartition(max(1, len(places)), GROUP)
        files = self._write(keyed, nullable(self.schema.to_spark()), None, [], 0, places, spread=False)
        self._check(files)
        return files

    def _rows_per_file(self, rows: DataFrame, shape: T.StructType) -> int:
        """How many rows fill a file of the target size, and no more than the settings allow; 0 for any number.

        The size of a row is what the table's rows took so far, or, in an empty table, what the first
        ``PROBE_ROWS`` rows take as Parquet.
        """
        if not self.config.target_file_size:
            return self.config.rows_per_file
        size = self.bytes_per_row or self._probe(rows, shape)
        fitting = max(1, int(self.config.target_file_size / size)) if size else 0
        return min(x for x in (fitting, self.config.rows_per_file) if x) if fitting or self.config.rows_per_file else 0

    def _probe(self, rows: DataFrame, shape: T.StructType) -> float:
        """Bytes of a row as Parquet, by the first ``PROBE_ROWS`` rows, which come to the driver."""
        import pyarrow as pa
        import pyarrow.parquet as pq

        found = rows.select(*(F.col(f"`{f.name}`") for f in shape.fields)).limit(PROBE_ROWS).toArrow()
        if not found.num_rows:
            return 0.0
        codec, sink = self.config.compression.lower(), pa.BufferOutputStream()
        codec = "none" if codec == "uncompressed" else codec if codec in ("gzip", "zstd", "brotli") else "snappy"
        pq.write_table(found, sink, compression=codec)
        meta = pq.ParquetFile(pa.BufferReader(sink.getvalue())).metadata
        size = sum(meta.row_group(g).column(c).total_compressed_size for g in range(meta.num_row_groups) for c in range(meta.num_columns))
        return size / found.num_rows

    def _sort_columns(self, sort: SortOrder | None) -> list[Column]:
        out = []
        for s in sort.fields if sort else ():
            c = transform_column(s.transform, F.col(self.schema.column_path(s.source_id)), self.schema.find(s.source_id).type)
            direction = {(True, True): "asc_nulls_first", (True, False): "asc_nulls_last", (False, True): "desc_nulls_first", (False, False): "desc_nulls_last"}
            out.append(getattr(c, direction[s.ascending, s.nulls_first])())
        return out

    def _check(self, files: list[DataFile]) -> None:
        """Required columns and fixed lengths; what breaks them is deleted again."""
        for f in self.schema.fields:
            if f.required and any(d.null_counts.get(f.id) for d in files):
                for d in files:
                    self.storage.delete(d.path)
                raise InvalidData("null in a required column", column=f.name)

    # -- delete files

    def equality_deletes(self, df: DataFrame, ids: list[int], partition_col: str | None = None) -> list[DataFile]:
        """Files of key values: columns of the given field ids, tagged with them."""
        if not ids:
            raise InvalidData("an equality delete needs columns")
        fields = [self.schema.find(i) for i in ids]
        rows = df
        if not self.spec.unpartitioned and partition_col is None:
            # The keys and what the partition is made from; other columns need not be there.
            sources = [self.schema.paths[p.source_id][0] for p in self.spec.fields]
            needed = dict.fromkeys([*(f.name for f in fields), *sources])
            kept = Schema(self.schema.schema_id, Struct(tuple(replace(self.schema.struct.by_name(n), required=False) for n in needed)))
            rows = align(df, kept)
        shape = nullable(T.StructType([T.StructField(f.name, to_spark(f.type), True, {FIELD_ID: f.id}) for f in fields]))
        files = self._write(rows, shape, partition_col, [], self.config.delete_max_records)
        return [replace(f, content=EQUALITY_DELETES, equality_ids=tuple(ids)) for f in files]

    def position_deletes(self, df: DataFrame, places: list[tuple[int, dict]] | None = None) -> list[DataFile]:
        """Files of (file_path, pos), sorted by both; duplicates stay.

        With ``places``, a list of (spec id, partition tuple), the column ``part`` of a row is the
        index of the place its file goes to; all places are written by one job.
        """
        shape = T.StructType([
            T.StructField("file_path", T.StringType(), True, {FIELD_ID: DELETE_PATH_ID}), T.StructField("pos", T.LongType(), True, {FIELD_ID: DELETE_POS_ID}),
        ])
        order = [F.col("file_path"), F.col("pos")]
        if places is None:
            places, df = [(self.spec.spec_id, {})], df.withColumn("part", F.lit(0))
        keyed = df.withColumn(PKEY, F.col("part").cast("string"))
        files = self._write(keyed, shape, None, order, self.config.delete_max_records, places)
        return [replace(f, content=POSITION_DELETES) for f in files]

    # -- the job

    def _write(self, rows: DataFrame, shape: T.StructType, partition_col: str | None, order: list[Column], max_rows: int, places: list[tuple[int, dict]] | None = None, spread: bool = True) -> list[DataFile]:
        began = time.perf_counter()
        staging = join(self.folder, f"w-{uuid.uuid4().hex}")
        self.spark.conf.set(TIMESTAMP_TYPE, "TIMESTAMP_MICROS")
        options = self.config.writer_options([f.name for f in self.schema.fields if isinstance(f.type, Primitive)])
        options.pop("maxRecordsPerFile", None)
        if max_rows:
            options["maxRecordsPerFile"] = str(max_rows)
        typed = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name, metadata=f.metadata) for f in shape.fields]
        shaped = lambda df, *more: df.select(*typed, *more)
        tuples: dict[str | None, tuple[int, dict]] = {None: (self.spec.spec_id, {})}
        if self.spec.unpartitioned and places is None:
            out = shaped(rows)
            if order:
                out = out.hint("rebalance").sortWithinPartitions(*order)
            out.write.options(**options).parquet(staging)
            found = [(None, join(staging, n)) for n, _ in self.storage.listing(staging) if n.endswith(".parquet")]
        else:
            if places is None:
                parted = with_partition(rows, self.schema, self.spec, partition_col)
                types = [(p.name, p.type) for p in self.spec.struct(self.schema).fields]
                # The tuples come back with the job itself, as many as there are folders.
                seen = Observation()
                parted = parted.observe(seen, F.collect_set(F.struct(PKEY, PART)).alias("tuples"))
            else:
                parted, tuples = rows, {str(i): place for i, place in enumerate(places)}
            out = (parted.hint("rebalance", F.col(PKEY)) if spread else parted).sortWithinPartitions(PKEY, *order)
            shaped(out, PKEY).write.options(**options).partitionBy(PKEY).parquet(staging)
            found = []
            for name, is_dir in self.storage.listing(staging):
                if is_dir and name.startswith(PKEY + "="):
                    key = name.split("=", 1)[1]
                    found += [(key, join(staging, name, n)) for n, _ in self.storage.listing(join(staging, name)) if n.endswith(".parquet")]
            if places is None and found:  # an empty plan is optimised away with its observation
                for r in seen.get["tuples"]:
                    tuples[r[PKEY]] = (self.spec.spec_id, {n: python_value(t, r[PART][n]) for n, t in types})
        files = []
        for key, stats in zip([k for k, _ in found], footers(self.spark, [p for _, p in found])):
            if not stats.record_count:
                self.storage.delete(stats.path)
                continue
            spec_id, partition = tuples[key]
            files.append(replace(self._placed(stats), partition=partition, spec_id=spec_id))
        if is_local(staging):
            self.storage.delete(staging, recursive=True)
        gained = (1, len(files), len({k for k, _ in found}), sum(f.record_count for f in files), sum(f.size for f in files), time.perf_counter() - began)
        self.metrics = {k: v + g for (k, v), g in zip(self.metrics.items(), gained)}
        return files

    def _placed(self, f: DataFile) -> DataFile:
        """Local files get their final name; elsewhere a rename is a copy, so they stay."""
        if not is_local(f.path):
            return f
        target = join(self.folder, file_name(self.partition_id, self.task, self.write_id, self.number))
        self.number += 1
        self.storage.move(f.path, target)
        return replace(f, path=target)


# ---------------------------------------------------------------- statistics


def _leaf_ids(schema) -> dict[str, int]:
    """Parquet column path to field id, for columns at the top and inside structs."""
    import pyarrow as pa

    out: dict[str, int] = {}

    def walk(fields, prefix: str) -> None:
        for f in fields:
            path = f"{prefix}{f.name}"
            tag = (f.metadata or {}).get(b"PARQUET:field_id")
            if pa.types.is_struct(f.type):
                walk([f.type.field(i) for i in range(f.type.num_fields)], path + ".")
            elif tag is not None:
                out[path] = int(tag)

    walk(schema, "")
    return out


_BOUND_KINDS = (bool, int, float, str, dt.date, dt.datetime)


def _bound(v, arrow_type, upper: bool) -> bytes | None:
    import pyarrow as pa

    if not isinstance(v, _BOUND_KINDS) or v != v:
        return None
    if isinstance(v, str):
        if len(v) > 16:
            v = v[:16]
            if upper:  # raise the last character that can be raised
                while v and ord(v[-1]) >= 0xD7FF:
                    v = v[:-1]
                if not v:
                    return None
                v = v[:-1] + chr(ord(v[-1]) + 1)
        return v.encode()
    name = (
        "boolean" if pa.types.is_boolean(arrow_type) else "int" if pa.types.is_int32(arrow_type) else "long" if pa.types.is_int64(arrow_type)
        else "float" if pa.types.is_float32(arrow_type) else "double" if pa.types.is_float64(arrow_type) else "date" if pa.types.is_date(arrow_type)
        else "timestamp" if pa.types.is_timestamp(arrow_type) else None
    )
    return None if name is None else to_bytes(Primitive(name), v)


def _extremes(stats) -> tuple | None:
    import pyarrow as pa

    if stats is None or not stats.has_min_max:
        return None
    try:
        return stats.min, stats.max
    except pa.ArrowNotImplementedError:  # a physical type whose statistics Arrow does not read
        return None


def footer(path: str) -> DataFile:
    """What a Parquet file's footer tells, keyed by field id."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, rel = (pafs.LocalFileSystem(), local_path(path)) if is_local(path) else pafs.FileSystem.from_uri(path)
    size = fs.get_file_info(rel).size
    with fs.open_input_file(rel) as f:
        parquet = pq.ParquetFile(f)
        meta, schema = parquet.metadata, parquet.schema_arrow
    ids = _leaf_ids(schema)
    sizes, values, nulls, low, high, blind = {}, {}, {}, {}, {}, set()
    offsets = []
    kinds = {f.name: f.type for f in schema}
    for g in range(meta.num_row_groups):
        group = meta.row_group(g)
        starts = []
        for c in range(group.num_columns):
            col = group.column(c)
            starts.append(col.dictionary_page_offset or col.data_page_offset)
            fid = ids.get(col.path_in_schema)
            if fid is None:
                continue
            sizes[fid] = sizes.get(fid, 0) + col.total_compressed_size
            values[fid] = values.get(fid, 0) + col.num_values
            stats = col.statistics
            if stats is None or not stats.has_null_count:
                blind.add(fid)
            else:
                nulls[fid] = nulls.get(fid, 0) + stats.null_count
            extremes = _extremes(stats) if col.path_in_schema in kinds else None
            if extremes is not None:
                low[fid] = (min(low[fid][0], extremes[0]) if fid in low else extremes[0], kinds[col.path_in_schema])
                high[fid] = (max(high[fid][0], extremes[1]) if fid in high else extremes[1], kinds[col.path_in_schema])
            elif stats is None or stats.null_count != col.num_values:
                blind.add(-fid)  # a group without bounds: none for the file
        if starts:
            offsets.append(min(starts))
    bounds = lambda d, up: {i: b for i, (v, t) in d.items() if -i not in blind and (b := _bound(v, t, up)) is not None}
    return DataFile(
        path, meta.num_rows, size, DATA, "PARQUET", {}, sizes, values, {i: n for i, n in nulls.items() if i not in blind}, {},
        bounds(low, False), bounds(high, True), tuple(offsets),
    )


def footers(spark, paths: list[str]) -> list[DataFile]:
    """Footers in the order of ``paths``; many are read by the executors."""
    if len(paths) <= 256:
        with ThreadPoolExecutor(min(16, max(1, len(paths)))) as pool:
            return list(pool.map(footer, paths))
    import pickle

    import pyarrow as pa

    def run(batches):
        for b in batches:
            done = [pickle.dumps(footer(p)) for p in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.binary())], names=["i", "f"])

    rows = spark.createDataFrame(list(enumerate(paths)), "i int, p string").repartition(min(len(paths) // 64 + 1, 512)).mapInArrow(run, "i int, f binary")
    return [pickle.loads(bytes(r.f)) for r in sorted(rows.collect(), key=lambda r: r.i)]


def partition_key_of(spec: PartitionSpec, partition: Struct, values: dict) -> tuple:
    """A hashable form of a partition tuple."""
    return (spec.spec_id, *(values.get(f.name) for f in partition.fields))


