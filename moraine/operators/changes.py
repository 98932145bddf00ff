"""Row-level changes: inserts and deletes in order become data and delete files.

The order within one call decides. A row that a later event of the same key replaces or deletes is
written and marked by a position delete; a delete whose key the call did not insert before becomes
an equality delete, which reaches older snapshots only. An insert does not touch rows of earlier
calls unless ``upsert`` is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..core.errors import InvalidData
from ..core.session import cut_table
from ..format.manifest import DataFile
from ..format.types import FIELD_ID
from .scan import FIELD_ID_READ, PATH, POS, attach_by_file
from .write import PKEY, SEQ_COLUMN, SEQ_ID, FileWriter, align, partition_key_of, with_partition

INSERT, DELETE = 1, 2


@dataclass(frozen=True)
class ChangeReport:
    """Files and counts of one call."""

    data: list[DataFile]
    position_deletes: list[DataFile]
    equality_deletes: list[DataFile]

    @property
    def rows(self) -> int:
        return sum(f.record_count for f in self.data)

    @property
    def positions(self) -> int:
        return sum(f.record_count for f in self.position_deletes)

    @property
    def keys(self) -> int:
        return sum(f.record_count for f in self.equality_deletes)


def delete_older(table, writer: FileWriter, rows: DataFrame, keys: list[int], partition_col: str | None = None) -> tuple[list[DataFile], list[DataFile]]:
    """(equality delete files, position delete files) that delete the rows of earlier snapshots whose
    ``keys`` equal those of ``rows`` and that lie in the same partition.

    The partition is that of the current spec, also for rows in files of other specs, which a delete
    file under the current spec cannot reach. If the partition follows from the keys, one delete over
    the whole table says the same; otherwise the rows of such files are looked up and marked one by one.
    """
    schema, spec = writer.schema, writer.spec
    names = [schema.find(i).name for i in keys]
    sources = {f.source_id for f in spec.fields if f.transform.name != "void"}
    only_keys = [F.col(f"`{n}`") for n in dict.fromkeys(names)]
    others = [] if spec.unpartitioned else table.files_of_other_specs(spec.spec_id)
    if others and sources <= set(keys):
        everywhere = table.new_writer()
        everywhere.spec = table.global_spec()
        return everywhere.equality_deletes(rows.select(*only_keys), keys), []
    if not sources and partition_col is None:
        rows = rows.select(*only_keys)
    equality = writer.equality_deletes(rows, keys, partition_col)
    if not others:
        return equality, []
    known = {schema.paths[i][0] for i in sources} | set(names)
    kept = rows.select(*(F.col(f"`{c}`") for c in rows.columns if c in known or c == partition_col))
    gone = with_partition(kept, schema, spec, partition_col).select(PKEY, *(c.alias(f"k{i}") for i, c in enumerate(only_keys))).distinct()
    have = with_partition(table.read_files(others, sorted(known)), schema, spec)
    same = have[PKEY] == gone[PKEY]
    for i, n in enumerate(dict.fromkeys(names)):
        same = same & have[f"`{n}`"].eqNullSafe(gone[f"k{i}"])
    hits = have.join(gone, same, "left_semi").select(F.col(PATH).alias("file_path"), F.col(POS).alias("pos"))
    return equality, table.position_files(hits, others)


def write_changes(
    table, changes: DataFrame, op: str, seq: str, keys: list[int], partition_col: str | None = None, upsert: bool = False
) -> ChangeReport:
    """Write ``changes``: the table's columns, ``op`` (1 insert, 2 delete) and ``seq``, a total order.

    ``keys`` are field ids; null keys equal each other. Other op codes, null or repeated sequence
    values are errors. Deletes need their key and, in a partitioned table, the columns that the
    partition is made from; they reach the rows of that partition, whatever the spec of their files.
    """
    writer = table.new_writer()
    schema, spec = writer.schema, writer.spec
    if not keys:
        raise InvalidData("changes need key columns")
    names = [schema.find(i).name for i in keys]
    rows = align(changes, schema, (op, seq, *([partition_col] if partition_col else [])))
    if spec.unpartitioned:
        rows = rows.withColumn(PKEY, F.lit(""))
    else:
        rows = with_partition(rows, schema, spec, partition_col).drop("__partition")
    w = W.partitionBy(PKEY, *(F.col(f"`{n}`") for n in names)).orderBy(F.col(seq))
    tagged = rows.select("*", F.lag(op).over(w).alias("__before"), F.lead(op).over(w).alias("__after"), F.lag(seq).over(w).alias("__before_seq"))
    tagged = cut_table(tagged)  # columnar: what follows reads few of its columns
    times = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("int")), F.lit(0))
    bad = tagged.agg(
        times(~F.coalesce(F.col(op).isin(INSERT, DELETE), F.lit(False))).alias("codes"), times(F.col(seq).isNull()).alias("nulls"),
        times(F.col("__before_seq") == F.col(seq)).alias("ties"),
    ).first()
    if bad.codes or bad.nulls:
        raise InvalidData("changes with an unknown operation or without a sequence", operations=bad.codes, sequences=bad.nulls)
    if bad.ties:
        raise InvalidData("two changes of one key have the same sequence", column=seq)
    fresh = F.coalesce(F.col("__before"), F.lit(DELETE)) == DELETE
    inserts = tagged.where(F.col(op) == INSERT).withColumn(SEQ_COLUMN, F.col(seq).cast("bigint"))
    data = writer.data(inserts, partition_col, keep=(SEQ_COLUMN,))
    unseen = (F.col(op) == DELETE) & fresh
    if upsert:  # the first event of a key also replaces what older snapshots have
        unseen = unseen | ((F.col(op) == INSERT) & F.col("__before").isNull())
    equality_files, elsewhere = delete_older(table, writer, tagged.where(unseen), keys, partition_col)

    dead = inserts.where(F.col("__after").isNotNull()).select(F.col(SEQ_COLUMN).alias("s"), PKEY, *(F.col(f"`{n}`").alias(f"k{i}") for i, n in enumerate(names)))
    positions: list[DataFile] = []
    if data:
        positions = _position_files(writer, data, dead, names)
    return ChangeReport(data, positions + elsewhere, equality_files)


def _position_files(writer: FileWriter, data: list[DataFile], dead: DataFrame, names: list[str]) -> list[DataFile]:
    """Find where the dead rows were written, and mark them, one delete file set per partition."""
    spark = writer.spark
    spark.conf.set(FIELD_ID_READ, "true")
    shape = T.StructType([*(f for f in writer.schema.to_spark(names).fields), T.StructField(SEQ_COLUMN, T.LongType(), True, {FIELD_ID: SEQ_ID})])
    partition = writer.spec.struct(writer.schema)
    by_tuple: dict[tuple, list[DataFile]] = {}
    for f in data:
        by_tuple.setdefault(partition_key_of(writer.spec, partition, f.partition), []).append(f)
    numbered = [(f.path, f.path, n) for n, files in enumerate(by_tuple.values()) for f in files]
    back = spark.read.schema(shape).parquet(*(f.path for f in data)).select("*", F.col("_metadata.file_path").alias("k"), F.col("_metadata.row_index").alias("pos"))
    back = attach_by_file(back, "k", numbered, "file_path string, part int")
    same = F.col("s") == F.col(SEQ_COLUMN)
    for i, n in enumerate(names):
        same = same & F.col(f"`{n}`").eqNullSafe(F.col(f"k{i}"))
    hits = back.join(dead, same, "left_semi").select("file_path", "pos", "part")
    places = [(files[0].spec_id, files[0].partition) for files in by_tuple.values()]
    return writer.position_deletes(hits, places)
