"""Table scan: which files, and one DataFrame over them with deletes applied.

Planning reads metadata on the driver: snapshot, partition value, predicates projected on partition
tuples and file bounds, resume position. Rows are read by Spark's Parquet reader, columns are
matched by field id, so filters and column choice go on down to the files.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..core.errors import InvalidData
from ..core.session import small_frame
from ..format.manifest import DATA, DELETE_PATH_ID, DELETE_POS_ID, EQUALITY_DELETES, Entry, require_parquet
from ..format.types import FIELD_ID, Field, PartitionSpec, Primitive, Schema, to_spark
from ..format.values import from_bytes
from ..functions.paths import object_key, object_key_column
from ..functions.transforms import transform_value
from .write import nullable

FIELD_ID_READ = "spark.sql.parquet.fieldId.read.enabled"
OPS = ("=", "<", "<=", ">", ">=", "in", "is null", "is not null")
PATH, POS, GROUP = "__file", "__pos", "__group"


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    value: object = None

    def __post_init__(self):
        if self.op not in OPS:
            raise InvalidData("unknown comparison", op=self.op)

    def column_expr(self) -> Column:
        c = F.col(self.column)
        return {
            "=": lambda: c == self.value, "<": lambda: c < self.value, "<=": lambda: c <= self.value, ">": lambda: c > self.value,
            ">=": lambda: c >= self.value, "in": lambda: c.isin(*self.value), "is null": c.isNull, "is not null": c.isNotNull,
        }[self.op]()


def may_match_partition(p: Predicate, schema: Schema, spec: PartitionSpec, values: dict) -> bool:
    """False only if no row of a file with this partition tuple can satisfy the predicate."""
    for part in spec.fields:
        source = schema.struct.by_name(p.column)
        if source is None or part.source_id != source.id or part.transform.name == "void":
            continue
        have, t = values.get(part.name), part.transform
        if p.op == "is null":
            if have is not None:
                return False
            continue
        if have is None:  # all rows are null there
            return False
        if p.op == "is not null":
            continue
        if p.op in ("=", "in"):
            wanted = [p.value] if p.op == "=" else list(p.value)
            if have not in [transform_value(t, w, source.type) for w in wanted if w is not None]:
                return False
        elif t.name != "bucket":  # the other transforms keep the order
            edge = transform_value(t, p.value, source.type)
            if p.op in ("<", "<=") and have > edge or p.op in (">", ">=") and have < edge:
                return False
            if t.name == "identity" and (p.op == "<" and have == edge or p.op == ">" and have == edge):
                return False
    return True


def may_match_bounds(p: Predicate, schema: Schema, file) -> bool:
    """False only if the file's counts and bounds rule the predicate out."""
    f = schema.struct.by_name(p.column)
    if f is None or not isinstance(f.type, Primitive):
        return True
    nulls, count = file.null_counts.get(f.id), file.value_counts.get(f.id)
    if p.op == "is null":
        return nulls is None or nulls > 0
    if nulls is not None and count is not None and nulls == count and count:
        return False
    if p.op == "is not null" or f.type.name in ("float", "double"):  # NaN is outside the bounds
        return True
    low, high = (from_bytes(f.type, d[f.id]) if f.id in d else None for d in (file.lower_bounds, file.upper_bounds))
    wanted = list(p.value) if p.op == "in" else [p.value]
    if p.op in ("=", "in"):
        return any(w is not None and (low is None or w >= low) and (high is None or w <= high) for w in wanted)
    if p.op in ("<", "<="):
        return low is None or low < p.value or p.op == "<=" and low == p.value
    return high is None or high > p.value or p.op == ">=" and high == p.value


def may_match_manifest(p: Predicate, schema: Schema, spec: PartitionSpec, summaries: tuple[dict, ...]) -> bool:
    """False only if the manifest's partition summaries rule out all of its files."""
    for part, summary in zip(spec.fields, summaries):
        source = schema.struct.by_name(p.column)
        if source is None or part.source_id != source.id or part.transform.name == "void":
            continue
        t, kind = part.transform, part.transform.result(source.type)
        if p.op == "is null":
            if not summary["contains_null"]:
                return False
            continue
        if summary["lower_bound"] is None or kind.name in ("float", "double"):
            if summary["lower_bound"] is None and not summary.get("contains_nan"):
                return False  # nulls only
            continue
        low, high = from_bytes(kind, summary["lower_bound"]), from_bytes(kind, summary["upper_bound"])
        if p.op in ("=", "in"):
            wanted = [transform_value(t, w, source.type) for w in ([p.value] if p.op == "=" else p.value) if w is not None]
            if not any(low <= w <= high for w in wanted):
                return False
        elif p.op != "is not null" and t.name != "bucket":
            edge = transform_value(t, p.value, source.type)
            if p.op in ("<", "<=") and low > edge or p.op in (">", ">=") and high < edge:
                return False
    return True


def attach_by_file(df: DataFrame, path_column: str, rows: list[tuple], ddl: str) -> DataFrame:
    """Add to each row what ``rows`` know of its file: (path, values as ``ddl`` names them).

    The driver knows how the reader spells the files it has listed, so no work is done on each
    row's path. A row of a file that is not among ``rows`` is an error, never dropped.
    """
    spelled = {object_key(path): path for path in df.inputFiles()}
    known = []
    for path, *values in rows:
        raw = spelled[object_key(path)]
        # Local files come with one slash or three, depending on who asks.
        known += [(s, *values) for s in {raw, raw.replace("file:///", "file:/", 1)}]
    joined = df.join(small_frame(df.sparkSession, known, f"raw string, {ddl}"), F.col(path_column) == F.col("raw"), "left")
    first = ddl.split()[0]
    kind = joined.schema[first].dataType
    lost = F.raise_error(F.concat(F.lit("rows of an unknown file: "), F.col(path_column))).cast(kind)
    return joined.withColumn(first, F.coalesce(F.col(first), lost)).drop("raw")


class _Hull:
    """What equality deletes of the same fields in one place have in common: the newest sequence, and
    between which values each field lies."""

    def __init__(self):
        self.sequence, self.nulls, self.low, self.high, self.files = 0, set(), {}, {}, 0

    def add(self, d: Entry) -> None:
        self.sequence = max(self.sequence, d.sequence)
        for i in d.file.equality_ids:
            if d.file.null_counts.get(i) != 0:
                self.nulls.add(i)
            for hull, bounds in ((self.low, d.file.lower_bounds), (self.high, d.file.upper_bounds)):
                hull.setdefault(i, []).append(bounds.get(i))
        self.files += 1

    def _edges(self, i: int, kind) -> tuple | None:
        lows, highs = self.low[i], self.high[i]
        if None in lows or None in highs:
            return None
        if self.files > 1:  # reduce once, later calls find one value each
            self.low[i] = lows = [min(lows, key=lambda b: from_bytes(kind, b))]
            self.high[i] = highs = [max(highs, key=lambda b: from_bytes(kind, b))]
        return from_bytes(kind, lows[0]), from_bytes(kind, highs[0])

    def may_meet(self, e: Entry, ids: tuple[int, ...], kinds: dict) -> bool:
        """False only if no row of the data file can equal a row of the deletes."""
        if self.sequence <= e.sequence:
            return False
        for i in ids:
            kind = kinds[i]
            if i in self.nulls or not isinstance(kind, Primitive) or kind.name in ("float", "double"):
                continue
            edges, low, high = self._edges(i, kind), e.file.lower_bounds.get(i), e.file.upper_bounds.get(i)
            if edges and low is not None and high is not None and (from_bytes(kind, high) < edges[0] or from_bytes(kind, low) > edges[1]):
                return False
        return True


class ScanBuilder:
    """Knobs of a scan; every one returns the builder. ``to_df`` gives the rows."""

    def __init__(self, table, snapshot_id: int | None = None):
        self.table = table
        self.snapshot_id = snapshot_id if snapshot_id is not None else table.metadata.current_snapshot_id
        self.columns: list[str] | None = None
        self.partition: dict | None = None
        self.start: tuple[str, int] | None = None
        self.predicates: list[Predicate] = []
        self.batch_size: int | None = None

    def with_snapshot_id(self, snapshot_id: int):
        self.table.metadata.snapshot(snapshot_id)
        self.snapshot_id = snapshot_id
        return self

    def with_ref(self, name: str):
        """The snapshot that a branch or tag names."""
        if name not in self.table.metadata.refs:
            raise InvalidData("no such reference", name=name)
        return self.with_snapshot_id(self.table.metadata.refs[name]["snapshot-id"])

    def select(self, *names: str):
        """Top-level columns by name; none means all."""
        self.columns = list(names) or None
        return self

    def with_partition_value(self, value: dict | None):
        """Only files whose partition tuple equals ``value``, by partition field name."""
        self.partition = value
        return self

    def start_from(self, path: str, row: int = 0):
        """Resume: skip the files before ``path`` and its first ``row`` rows."""
        self.start = (path, row)
        return self

    def where(self, column: str, op: str, value=None):
        self.predicates.append(Predicate(column, op, value))
        return self

    def with_batch_size(self, rows: int):
        """Rows per batch of the vectorised reader; a setting of the session."""
        self.batch_size = rows
        return self

    # -- planning

    @property
    def schema(self) -> Schema:
        if self.snapshot_id is None:
            return self.table.metadata.schema
        snapshot = self.table.metadata.snapshot(self.snapshot_id)
        # A current snapshot is read under the current schema, an older one under its own.
        current = self.snapshot_id == self.table.metadata.current_snapshot_id
        return self.table.metadata.schema if current else self.table.metadata.schema_of(snapshot)

    def plan(self) -> tuple[list[Entry], list[Entry]]:
        """(data, deletes) to read, data in manifest order."""
        if self.snapshot_id is None:
            return [], []
        data, deletes = [], []
        schema, specs = self.schema, self.table.metadata.specs

        def wanted(m) -> bool:  # delete files may concern files of other manifests
            fits = lambda p: may_match_manifest(p, schema, specs[m.spec_id], m.partitions)
            return bool(m.content) or self.start is not None or all(map(fits, self.predicates))

        partition, predicates = self.partition, self.predicates

        def may_match(e: Entry) -> bool:
            if partition is not None and e.file.partition != partition:
                return False
            return all(may_match_partition(p, schema, specs[e.file.spec_id], e.file.partition) and may_match_bounds(p, schema, e.file) for p in predicates)

        # Where a resumed scan begins is found among all files.
        keep = None if self.start else lambda e: e.file.content != DATA or may_match(e)
        for e in self.table.live_entries(self.snapshot_id, wanted, keep):
            (data if e.file.content == DATA else deletes).append(e)
        if self.start:
            keys = [object_key(e.file.path) for e in data]
            if object_key(self.start[0]) not in keys:
                raise InvalidData("no such data file to start from", path=self.start[0])
            data = [e for e in data[keys.index(object_key(self.start[0])) :] if may_match(e)]
        for e in data:
            require_parquet(e.file)
        return data, deletes

    def _shape(self, names: list[str]) -> T.StructType:
        from .values_sql import literal

        fields = []
        for n in names:
            f = self.schema.struct.by_name(n) or self._dropped(n)
            if f is None:
                raise InvalidData("no such column", column=n)
            meta = {FIELD_ID: f.id}
            if f.initial_default is not None and isinstance(f.type, Primitive):
                meta |= {"EXISTS_DEFAULT": literal(f.type, f.initial_default)}
            fields.append(T.StructField(n, nullable(to_spark(f.type)), True, meta))
        return T.StructType(fields)

    def _any_field(self, field_id: int) -> Field:
        """A field of the scan's schema, or of the newest other schema that has it."""
        others = sorted(self.table.metadata.schemas.values(), key=lambda s: -s.schema_id)
        for schema in (self.schema, *others):
            if field_id in schema.paths:
                return schema.find(field_id)
        raise InvalidData("no such field", field_id=field_id)

    def _column_of(self, field_id: int) -> str:
        """The name under which a scan reads a field, dropped or not."""
        here = next((f.name for f in self.schema.fields if f.id == field_id), None)
        return here if here is not None else f"__field_{field_id}"

    def _dropped(self, name: str) -> Field | None:
        return self._any_field(int(name[8:])) if name.startswith("__field_") and name[8:].isdigit() else None

    def _rebound(self) -> set[str]:
        """Columns whose name, or that of a field inside, has stood for another field id in some schema.

        Spark reads by field id, but pushes filters down by name. In a file of another time such a
        name may be a different column, so these columns are read under names that no file has,
        and their filters stay above the scan.
        """
        ids: dict[tuple[str, ...], set[int]] = defaultdict(set)
        for schema in self.table.metadata.schemas.values():
            for field_id, path in schema.paths.items():
                ids[path].add(field_id)
        return {path[0] for path, found in ids.items() if len(found) > 1}

    def _read(self, paths: list[str], names: list[str], *more: Column) -> DataFrame:
        """The columns ``names`` of the files, and ``more`` columns of the reader."""
        spark = self.table.spark
        spark.conf.set(FIELD_ID_READ, "true")
        if self.batch_size:
            spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(self.batch_size))
        shape, rebound = self._shape(names), self._rebound()
        hidden = {f.name: f"__field_{f.metadata[FIELD_ID]}" for f in shape.fields if f.name in rebound}
        physical = T.StructType([T.StructField(hidden.get(f.name, f.name), f.dataType, True, f.metadata) for f in shape.fields])
        df = spark.read.schema(physical).parquet(*paths)
        if not hidden and not more:
            return df
        return df.select(*(F.col(f"`{hidden.get(n, n)}`").alias(n) if n in hidden else F.col(f"`{n}`") for n in names), *more)

    # -- rows

    def to_df(self) -> DataFrame:
        """The rows. An empty table gives an empty DataFrame of the right schema."""
        names = self.columns or [f.name for f in self.schema.fields]
        shape = self._shape(names)
        data, deletes = self.plan()
        filters = [p.column_expr() for p in self.predicates]
        # Predicates may look at columns that are not selected.
        read = names + [p.column for p in self.predicates if p.column not in names]
        self._shape(read)
        if not data:
            return self.table.spark.createDataFrame([], shape)
        parts: list[DataFrame] = []
        if self.start and self.start[1] > 0 and object_key(data[0].file.path) == object_key(self.start[0]):
            parts += self._parts([data[0]], deletes, read, self.start[1])
            data = data[1:]
        parts += self._parts(data, deletes, read, 0)
        if not parts:
            return self.table.spark.createDataFrame([], shape)
        out = reduce(DataFrame.unionByName, parts)
        for c in filters:
            out = out.where(c)
        return out.select(*(F.col(f"`{n}`") for n in names))

    def reached(self, data: list[Entry], deletes: list[Entry], named: set[str] | None = None) -> set[int]:
        """``id`` of each data entry that a delete may reach, by sequence, partition and key bounds.

        ``named``: the data files that position deletes name, if that is known.
        """
        newest_pos: dict[tuple, int] = {}
        hulls: dict[tuple | None, dict[tuple, _Hull]] = defaultdict(dict)
        for d in deletes:
            if d.file.content != EQUALITY_DELETES:
                newest_pos[self._tuple(d)] = max(newest_pos.get(self._tuple(d), 0), d.sequence)
                continue
            where = None if self.table.metadata.specs[d.file.spec_id].unpartitioned else self._tuple(d)
            hulls[where].setdefault(d.file.equality_ids, _Hull()).add(d)
        kinds = {i: self._any_field(i).type for by_ids in hulls.values() for ids in by_ids for i in ids}
        hit: set[int] = set()
        for e in data:
            where = self._tuple(e)
            if newest_pos.get(where, 0) >= e.sequence and (named is None or object_key(e.file.path) in named):
                hit.add(id(e))
            elif any(h.may_meet(e, ids, kinds) for place in (None, where) for ids, h in hulls.get(place, {}).items()):
                hit.add(id(e))
        return hit

    def _parts(self, data: list[Entry], deletes: list[Entry], names: list[str], skip: int, groups: dict[int, int] | None = None) -> list[DataFrame]:
        """The rows of ``data`` without what ``deletes`` delete, files that no delete reaches apart.

        With ``groups``, a number by ``id`` of each entry, the rows also have that number, as ``GROUP``.
        """
        position = [d for d in deletes if d.file.content != EQUALITY_DELETES]
        equality = [d for d in deletes if d.file.content == EQUALITY_DELETES]
        hit = self.reached(data, deletes)
        out = []
        for merge in (False, True):
            group = [e for e in data if (id(e) in hit) == merge]
            if not group:
                continue
            keys = sorted({i for d in equality for i in d.file.equality_ids}) if merge else []
            extra = [n for n in map(self._column_of, keys) if n not in names]
            place = (F.col("_metadata.file_path").alias(PATH), F.col("_metadata.row_index").alias(POS)) if merge or skip else ()
            if groups is not None and not merge:
                place = (F.col("_metadata.file_path").alias(PATH),)
            df = self._read([e.file.path for e in group], names + extra, *place)
            if skip:
                df = df.where(F.col(POS) >= skip)
            if merge:
                df = self._without_deleted(df, group, position, equality, groups)
            elif groups is not None:
                df = attach_by_file(df, PATH, [(e.file.path, groups[id(e)]) for e in group], f"{GROUP} int")
            out.append(df.select(*(F.col(f"`{n}`") for n in names), *([GROUP] if groups is not None else [])))
        return out

    def _tuple(self, e: Entry) -> tuple:
        return (e.file.spec_id, *((k, repr(v)) for k, v in sorted(e.file.partition.items())))

    def _without_deleted(self, df: DataFrame, data: list[Entry], position: list[Entry], equality: list[Entry], groups: dict[int, int] | None = None) -> DataFrame:
        spark = self.table.spark
        tuples: dict[tuple, int] = {}
        number = lambda e: tuples.setdefault(self._tuple(e), len(tuples))
        facts = [(e.file.path, i, e.sequence, number(e), groups[id(e)] if groups else 0) for i, e in enumerate(data)]
        df = attach_by_file(df, PATH, facts, f"file_no int, seq bigint, part int, {GROUP} int").drop(PATH)
        known = small_frame(spark, [(object_key(e.file.path), i) for i, e in enumerate(data)], "k string, d_no int")
        reach = {self._tuple(e) for e in data}
        position = [d for d in position if self._tuple(d) in reach]
        if position:
            shape = T.StructType([T.StructField("file_path", T.StringType(), True, {FIELD_ID: DELETE_PATH_ID}), T.StructField("pos", T.LongType(), True, {FIELD_ID: DELETE_POS_ID})])
            named = self._delete_rows(shape, position, number).withColumn("d_k", object_key_column(F.col("file_path")))
            gone = named.join(known, F.col("d_k") == F.col("k")).groupBy("d_no", F.col("pos").alias("d_pos")).agg(F.max("d_seq").alias("d_seq"))
            df = df.join(gone, (F.col("file_no") == F.col("d_no")) & (F.col(POS) == F.col("d_pos")) & (F.col("d_seq") >= F.col("seq")), "left_anti")
        by_ids: dict[tuple, list[Entry]] = defaultdict(list)
        for d in equality:
            by_ids[d.file.equality_ids].append(d)
        specs = self.table.metadata.specs
        for ids, files in by_ids.items():
            fields = [self._any_field(i) for i in ids]
            shape = T.StructType([T.StructField(f"d_{f.id}", to_spark(f.type), True, {FIELD_ID: f.id}) for f in fields])
            for everywhere in (True, False):
                chosen = [d for d in files if specs[d.file.spec_id].unpartitioned == everywhere and (everywhere or self._tuple(d) in reach)]
                if not chosen:
                    continue
                keys = [f"d_{f.id}" for f in fields]
                gone = self._delete_rows(shape, chosen, number).groupBy(*keys, *([] if everywhere else ["d_part"])).agg(F.max("d_seq").alias("d_seq"))
                on = F.col("d_seq") > F.col("seq")
                if not everywhere:
                    on = on & (F.col("d_part") == F.col("part"))
                for f in fields:
                    on = on & F.col(f"`{self._column_of(f.id)}`").eqNullSafe(F.col(f"d_{f.id}"))
                df = df.join(gone, on, "left_anti")
        return df

    def _delete_rows(self, shape: T.StructType, files: list[Entry], number) -> DataFrame:
        """Rows of delete files with their sequence number and partition."""
        spark = self.table.spark
        spark.conf.set(FIELD_ID_READ, "true")
        rows = spark.read.schema(shape).parquet(*(e.file.path for e in files)).select("*", F.col("_metadata.file_path").alias("d_file"))
        return attach_by_file(rows, "d_file", [(e.file.path, e.sequence, number(e)) for e in files], "d_seq bigint, d_part int").drop("d_file")
