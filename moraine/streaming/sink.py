"""Streams into tables: each micro-batch is one snapshot, and a repeated batch is skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

QUERY_KEY, BATCH_KEY, PROPERTY = "stream-query-id", "stream-batch-id", "stream-batch."


class TableSink:
    """``foreachBatch`` target. The batch number is kept in a property of the table, set by the commit that
    adds the batch, so a batch that was committed before a failure is not committed again after it,
    whatever snapshots have been expired or rolled back since.

    With ``op``, ``seq`` and ``keys`` batches are changes, otherwise appended rows.
    """

    def __init__(self, table, query_id: str, op: str | None = None, seq: str | None = None, keys: list[str] | None = None, upsert: bool = False):
        self.table, self.query_id = table, query_id
        self.op, self.seq, self.keys, self.upsert = op, seq, keys, upsert

    @property
    def _key(self) -> str:
        return f"{PROPERTY}{self.query_id}"

    def last_batch(self) -> int:
        """The newest batch of this query in the table, -1 if there is none."""
        self.table.refresh()
        return int(self.table.metadata.properties.get(self._key, -1))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last_batch():
            return
        summary, properties = {QUERY_KEY: self.query_id, BATCH_KEY: str(batch_id)}, {self._key: str(batch_id)}
        if self.op:
            self.table.apply_changes(batch, self.op, self.seq, self.keys, upsert=self.upsert, summary=summary, properties=properties)
        else:
            self.table.append(batch, summary=summary, properties=properties)


def write_stream(stream: DataFrame, table, query_id: str, checkpoint: str, trigger: dict | None = None, **kw) -> StreamingQuery:
    """Start writing ``stream`` to ``table``; ``checkpoint`` is the query's own folder."""
    sink = TableSink(table, query_id, **kw)
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
