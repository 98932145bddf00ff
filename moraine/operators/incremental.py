"""Processing only new or changed records: a work-item ledger with leases and fencing tokens.

A consumer works through a table's changes in sequence order. Each attempt is a *lease* on an
interval of sequence numbers with a growing token. The newest event of a lease tells its state;
a work item is

* ``done``    - inside the interval of a lease that succeeded,
* ``leased``  - else, inside that of a running lease which has not expired,
* ``pending`` - else; expired, failed and rolled-back leases give their items back.

``ledger_states`` computes that for all consumers at once on event tables of any size. Two durable forms
lease and complete work: ``WorkLedger`` one interval of one consumer and table, ``BatchLedger`` all pending
work of all consumers as one job. Both keep a numbered log of events (``EventLog``), and in both
readers see the output of completed leases only.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..core.errors import CommitConflict, InvalidData
from ..core.storage import Storage, join

#: Sequence numbers per block of the two-level running sum.
BLOCK = 4096
#: Folders of completed intervals that a batch ledger reads at most before it writes them as one.
MERGE_FOLDERS = 32
#: Events after which a log writes down its state, so that nobody has to read them all again.
STATE_EVERY = 64


def table_changes(entries: DataFrame, snapshots: DataFrame, repeated: bool = False) -> DataFrame:
    """(table_uuid, sequence, file_path, status): files added (1) and removed (2), each once, or as
    often as they are listed if ``repeated``.

    An added file counts at its own sequence number, or at its snapshot's when that is null; a
    removed file at its snapshot's. An entry's snapshot is ``snapshot_id`` or, when null,
    ``added_snapshot_id``. Entries of other states, with a null path, or whose sequence number is
    nowhere to be found give no row.
    """
    wanted = entries.where(F.col("status").isin(1, 2) & F.col("file_path").isNotNull()).select(
        F.col("table_uuid"),
        F.coalesce("snapshot_id", "added_snapshot_id").alias("sid"),
        F.col("status"),
        F.when(F.col("status") == 1, F.col("sequence_number")).alias("own"),
        F.col("file_path"),
    )
    snaps = (
        snapshots.select("table_uuid", F.col("snapshot_id").alias("sid"), F.col("sequence_number").alias("snap_seq"))
        .groupBy("table_uuid", "sid")
        .agg(F.max("snap_seq").alias("snap_seq"))
    )
    found = (
        wanted.join(snaps, ["table_uuid", "sid"], "left")
        .select("table_uuid", F.coalesce("own", "snap_seq").alias("sequence"), "file_path", "status")
        .where(F.col("sequence").isNotNull())
    )
    return found if repeated else found.distinct()


def lease_states(events: DataFrame) -> DataFrame:
    """One row per lease: (token, consumer, table_uuid, lo, hi, state, at), the newest event's.

    ``events`` has run_id, consumer, table_uuid, from_sequence, to_sequence, run_status and
    logged_ms. Repeated and disordered events change nothing. Of events with equal times a
    rolled-back or failed one wins over a succeeded one, that over a running one, so that no
    change can be lost by a tie. A null time counts as older than any other.
    """
    rank = (
        F.when(F.col("run_status") == "rolled_back", 3)
        .when(F.col("run_status") == "failed", 2)
        .when(F.col("run_status") == "succeeded", 1)
        .otherwise(0)
    )
    newest = F.max(
        F.struct(
            F.coalesce("logged_ms", F.lit(-(2**62))).alias("at"),
            rank.alias("rank"),
            F.col("run_status").alias("state"),
            F.col("from_sequence").alias("lo"),
            F.col("to_sequence").alias("hi"),
            F.col("consumer").alias("consumer"),
            F.col("table_uuid").alias("table_uuid"),
        )
    )
    return events.groupBy(F.col("run_id").alias("token")).agg(newest.alias("e")).select("token", "e.*").drop("rank")


def ledger_states(
    points: DataFrame,
    events: DataFrame,
    now_ms: Column | int | None = None,
    lease_ms: int = 6 * 3600 * 1000,
    block: int = BLOCK,
) -> DataFrame:
    """(consumer, table_uuid, sequence, state) of every sequence number a consumer has to process.

    ``points``: distinct (table_uuid, sequence) with changes. A consumer has to process the points
    of each table it has any event for. ``now_ms`` is the ledger's clock for lease expiry; without
    one every running lease counts as expired, because nothing proves that its holder lives.

    A succeeded interval with a null end covers nothing; a running one with a null end is open.
    The cover of a point is a running sum of interval starts and ends. It is made in two levels
    (blocks of sequence numbers, then within a block), so that a hot table never is one task.
    """
    leases = lease_states(events)
    subs = events.select("consumer", "table_uuid").distinct()
    todo = (
        points.select("table_uuid", "sequence")
        .join(subs, "table_uuid")  # a union and a shuffle follow, so adaptive execution may split a hot table
        .select("consumer", "table_uuid", F.col("sequence").alias("pos"), F.lit(0).alias("done"), F.lit(0).alias("held"), F.lit(1).alias("is_item"))
    )
    closed = leases.where((F.col("state") == "succeeded") & F.col("lo").isNotNull() & F.col("hi").isNotNull() & (F.col("hi") > F.col("lo")))
    live = leases.where((F.col("state") == "running") & F.col("lo").isNotNull() & (F.col("hi").isNull() | (F.col("hi") > F.col("lo"))))
    live = live.where(F.lit(False)) if now_ms is None else live.where(F.col("at") + F.lit(lease_ms) > now_ms)

    def edges(spans: DataFrame, done: int, held: int) -> DataFrame:
        pair = F.array(
            F.struct((F.col("lo") + 1).alias("pos"), F.lit(1).alias("sign")),
            F.struct((F.col("hi") + 1).alias("pos"), F.lit(-1).alias("sign")),
        )
        return (
            spans.select("consumer", "table_uuid", F.explode(pair).alias("x"))
            .where(F.col("x.pos").isNotNull())
            .select("consumer", "table_uuid", "x.pos", (F.col("x.sign") * done).alias("done"), (F.col("x.sign") * held).alias("held"), F.lit(0).alias("is_item"))
        )

    marks = (
        todo.unionByName(edges(closed, 1, 0))
        .unionByName(edges(live, 0, 1))
        .withColumn("block", F.floor(F.col("pos") / block))
        .groupBy("consumer", "table_uuid", "block", "pos")
        .agg(F.sum("done").alias("done"), F.sum("held").alias("held"), F.max("is_item").alias("is_item"))
    )
    before = W.partitionBy("consumer", "table_uuid").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        marks.groupBy("consumer", "table_uuid", "block")
        .agg(F.sum("done").alias("d"), F.sum("held").alias("h"))
        .select(
            "consumer", "table_uuid", "block",
            F.coalesce(F.sum("d").over(before), F.lit(0)).alias("d0"),
            F.coalesce(F.sum("h").over(before), F.lit(0)).alias("h0"),
        )
    )
    within = W.partitionBy("consumer", "table_uuid", "block").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    state = (
        F.when(F.col("d0") + F.col("d") > 0, "done").when(F.col("h0") + F.col("h") > 0, "leased").otherwise("pending")
    )
    return (
        marks.withColumn("d", F.sum("done").over(within))
        .withColumn("h", F.sum("held").over(within))
        .where(F.col("is_item") == 1)
        .join(carried, ["consumer", "table_uuid", "block"])
        .select("consumer", "table_uuid", F.col("pos").alias("sequence"), state.alias("state"))
    )


def unprocessed_changes(entries: DataFrame, snapshots: DataFrame, events: DataFrame) -> DataFrame:
    """(consumer, table_uuid, file_path, status) that no successful run has processed, each once.

    These are the changes of the ledger's items that are pending or leased, its clock standing at the
    newest event: a live lease is no success yet. Repeated entries are dropped at the end only: both joins then are followed by a shuffle, so
    adaptive execution may split a snapshot that holds a large part of all entries.
    """
    changes = table_changes(entries, snapshots, repeated=True)
    points = changes.select("table_uuid", "sequence").distinct()
    now = events.agg(F.max("logged_ms")).first()[0]  # one number
    open_points = ledger_states(points, events, now or 0).where(F.col("state") != "done").drop("state")
    return (
        changes.join(open_points, ["table_uuid", "sequence"])
        .select("consumer", "table_uuid", "file_path", "status")
        .distinct()
    )


class EventLog:
    """A numbered log in a shared folder: one object per event, created exclusively.

    The number is the order of events, the creation the lock. Every ``STATE_EVERY`` events the state,
    folded from all events so far by ``fold``, is written beside them; a reader takes the newest
    state and the events after it. States say the same as the events, so it does not matter who
    writes one, or whether it was written twice.
    """

    def __init__(self, storage: Storage, folder: str, empty: dict, fold):
        self.storage, self.folder, self.empty, self.fold = storage, folder, empty, fold

    def read(self) -> tuple[int, dict]:
        """(number of events, state)."""
        names = {n for n, is_dir in self.storage.listing(self.folder) if not is_dir and n.endswith(".json")}
        states = sorted(n for n in names if n.startswith("state-"))
        count, state = json.loads(self.storage.read(join(self.folder, states[-1]))) if states else (0, json.loads(json.dumps(self.empty)))
        while f"{count:012d}.json" in names:
            state = self.fold(state, json.loads(self.storage.read(join(self.folder, f"{count:012d}.json"))))
            count += 1
        return count, state

    def append(self, number: int, event: dict) -> None:
        if not self.storage.create(join(self.folder, f"{number:012d}.json"), json.dumps(event, sort_keys=True).encode()):
            raise CommitConflict("another worker wrote to the ledger first", event=number)
        if (number + 1) % STATE_EVERY == 0:
            count, state = self.read()
            self.storage.create(join(self.folder, f"state-{count:012d}.json"), json.dumps([count, state]).encode())


@dataclass(frozen=True)
class Lease:
    consumer: str
    table_uuid: str
    token: int
    lo: int
    hi: int
    expires_ms: int


def _fold_work(state: dict, event: dict) -> dict:
    """The state of one consumer and table: the newest lease, intervals done, intervals to be retried."""
    span = [event["lo"], event["hi"]]
    if event["state"] == "leased":
        state["lease"] = {k: event[k] for k in ("token", "lo", "hi", "expires_ms")} | {"open": True}
        return state
    state["lease"]["open"] = False
    if event["state"] == "done":
        state["done"].append(span)
        state["outputs"].append(event["output"])
        spans: list[list[int]] = []
        for lo, hi in sorted(state["done"]):
            if spans and lo <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], hi)
            else:
                spans.append([lo, hi])
        state["done"] = spans
    return state


class WorkLedger:
    """Durable ledger of intervals in a folder shared by all workers.

    A lease gets the next token of its (consumer, table); a writer whose token is not the newest, or
    whose lease has expired, is rejected. An interval that was leased and not completed is leased again
    with the same bounds. Each attempt writes to ``output_path``, a folder named by interval and
    token, so neither a crashed nor a stale attempt can touch what another wrote; the event that completes
    a lease names the folder, and ``outputs`` lists these only.
    """

    def __init__(self, root: str, spark: SparkSession | None = None, lease_ms: int = 6 * 3600 * 1000, clock=None):
        self.root, self.lease_ms = root, lease_ms
        self.storage = Storage(spark)
        self.spark = spark
        self._clock = clock or (lambda: int(time.time() * 1000))

    def _log(self, consumer: str, table_uuid: str) -> EventLog:
        return EventLog(self.storage, join(self.root, "events", consumer, table_uuid), {"lease": None, "done": [], "outputs": []}, _fold_work)

    def watermark(self, consumer: str, table_uuid: str) -> int:
        """Everything up to here is done, without a gap."""
        done = self._log(consumer, table_uuid).read()[1]["done"]
        return done[0][1] if done and done[0][0] <= 0 else 0

    def outputs(self, consumer: str, table_uuid: str) -> list[str]:
        """The folders that completed leases wrote, in their order."""
        return self._log(consumer, table_uuid).read()[1]["outputs"]

    def lease(self, consumer: str, table_uuid: str, upto: int, limit: int | None = None) -> Lease | None:
        """Take the oldest interval not done; None if all is done or somebody holds a live lease.

        An interval that an earlier lease did not complete keeps its bounds, whatever ``upto`` and
        ``limit`` are.
        """
        log, now = self._log(consumer, table_uuid), self._clock()
        count, state = log.read()
        last = state["lease"]
        if last and last["open"] and last["expires_ms"] > now:
            return None
        done = state["done"]
        lo = done[0][1] if done and done[0][0] <= 0 else 0
        if last and last["lo"] == lo and not any(a <= last["lo"] and last["hi"] <= b for a, b in done):
            hi = last["hi"]
        elif lo >= upto:
            return None
        else:
            later = [a for a, _ in done if a > lo]
            hi = min([upto, *later, *([lo + limit] if limit else [])])
        token, expires = (last["token"] if last else 0) + 1, now + self.lease_ms
        log.append(count, {"token": token, "state": "leased", "lo": lo, "hi": hi, "expires_ms": expires})
        return Lease(consumer, table_uuid, token, lo, hi, expires)

    def _finish(self, lease: Lease, result: str) -> None:
        log = self._log(lease.consumer, lease.table_uuid)
        count, state = log.read()
        last = state["lease"]
        if lease.token != last["token"]:
            raise CommitConflict("stale fencing token", token=lease.token, newest=last["token"])
        if not last["open"]:
            if result == "done" and self.output_path(lease) in state["outputs"][-1:]:
                return  # a retried completion
            raise InvalidData("lease is closed", token=lease.token)
        if result == "done" and self._clock() >= lease.expires_ms:
            raise CommitConflict("lease expired", token=lease.token)
        log.append(count, {"token": lease.token, "state": result, "lo": lease.lo, "hi": lease.hi, "output": self.output_path(lease)})

    def complete(self, lease: Lease) -> None:
        self._finish(lease, "done")

    def release(self, lease: Lease) -> None:
        self._finish(lease, "released")

    def output_path(self, lease: Lease) -> str:
        return join(self.root, "output", lease.consumer, lease.table_uuid, f"{lease.lo:020d}-{lease.hi:020d}", f"attempt-{lease.token:08d}")

    def run(self, consumer: str, changes: DataFrame, table_uuid: str, upto: int, process) -> int | None:
        """Lease, process and complete one interval; returns its end, None if there was nothing.

        ``process(df, path)`` gets the changes of the interval and writes to ``path``. If it
        raises, the lease is given back and the next call does the same interval again.
        """
        lease = self.lease(consumer, table_uuid, upto)
        if lease is None:
            return None
        part = changes.where((F.col("table_uuid") == table_uuid) & (F.col("sequence") > lease.lo) & (F.col("sequence") <= lease.hi))
        try:
            process(part, self.output_path(lease))
        except BaseException:
            self.release(lease)
            raise
        self.complete(lease)
        return lease.hi


# ---------------------------------------------------------------- all consumers at once


@dataclass(frozen=True)
class BatchLease:
    """``items`` is the folder with the leased intervals, ``output`` the one this attempt writes to."""

    token: int
    items: str
    output: str
    expires_ms: int


def _fold_batch(state: dict, event: dict) -> dict:
    if event["state"] == "leased":
        state["lease"] = {k: event[k] for k in ("token", "items", "expires_ms")} | {"open": True, "finished": False}
        return state
    if event["state"] == "merged":
        state["done"] = [event["into"], *(x for x in state["done"] if x not in event["items"])]
        return state
    state["lease"]["open"] = False
    if event["state"] == "done":
        state["lease"]["finished"] = True
        state["done"].append(event["items"])
        state["outputs"].append(event["output"])
    return state


class BatchLedger:
    """Durable ledger that leases the pending work of all consumers and tables together.

    A lease is a folder of intervals (consumer, table_uuid, lo, hi), one for each gap in what is
    done, cut at blocks of ``BLOCK`` sequence numbers; computing, processing and completing it is one job
    each, whatever the number of consumers and tables. Tokens, expiry, retries with the same intervals
    and attempt folders are those of ``WorkLedger``. ``history`` are the events of runs before the ledger.
    """

    def __init__(self, root: str, spark: SparkSession, history: DataFrame, lease_ms: int = 6 * 3600 * 1000, clock=None):
        self.root, self.spark, self.history, self.lease_ms = root, spark, history, lease_ms
        self.storage = Storage(spark)
        self._clock = clock or (lambda: int(time.time() * 1000))
        self.log = EventLog(self.storage, join(root, "events"), {"lease": None, "done": [], "outputs": []}, _fold_batch)

    def events(self) -> DataFrame:
        """The history and the intervals of completed leases, as ``ledger_states`` takes them."""
        names = ["run_id", "consumer", "table_uuid", "from_sequence", "to_sequence", "run_status", "logged_ms"]
        old = self.history.select(*names)
        done = self.log.read()[1]["done"]
        if not done:
            return old
        # Numbers of their own for the intervals: those of the history are not negative.
        own = F.struct("consumer", "table_uuid", "lo", "hi")
        return old.unionByName(self._items(done).select(
            (-1 - F.xxhash64(own).bitwiseAND(F.lit((1 << 62) - 1))).alias("run_id"), "consumer", "table_uuid", F.col("lo").alias("from_sequence"),
            F.col("hi").alias("to_sequence"), F.lit("succeeded").alias("run_status"), F.lit(0).cast("bigint").alias("logged_ms"),
        ))

    def _items(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema("consumer string, table_uuid string, block bigint, lo bigint, hi bigint").parquet(*folders)

    def lease(self, changes: DataFrame) -> BatchLease | None:
        """Take all pending work; None if there is none or somebody holds a live lease.

        ``changes`` has (table_uuid, sequence, ...). Work that an earlier lease did not complete is
        leased again as it was, new work waits for the next lease.
        """
        count, state = self.log.read()
        last, now = state["lease"], self._clock()
        if last and last["open"] and last["expires_ms"] > now:
            return None
        token = (last["token"] if last else 0) + 1
        if last and not last["finished"]:
            items = last["items"]
        else:
            count = self._merge(count, state["done"])
            items = join(self.root, "leases", f"{token:08d}-{uuid.uuid4().hex}")
            points = changes.select("table_uuid", "sequence").distinct()
            states = ledger_states(points, self.events())
            spot = W.partitionBy("consumer", "table_uuid", "block").orderBy("sequence")
            runs = states.withColumn("block", F.floor(F.col("sequence") / BLOCK)).withColumn("turn", (F.col("state") != F.lag("state", 1, "").over(spot)).cast("int"))
            runs = runs.withColumn("run", F.sum("turn").over(spot)).where("state <> 'done'")
            gaps = runs.groupBy("consumer", "table_uuid", "block", "run").agg((F.min("sequence") - 1).alias("lo"), F.max("sequence").alias("hi"))
            gaps.select("consumer", "table_uuid", "block", "lo", "hi").write.parquet(items)
            if self._items([items]).isEmpty():
                return None
        lease = BatchLease(token, items, join(self.root, "output", f"attempt-{token:08d}"), now + self.lease_ms)
        self.log.append(count, {"token": token, "state": "leased", "items": items, "expires_ms": lease.expires_ms})
        return lease

    def _merge(self, count: int, done: list[str]) -> int:
        """Write very many folders of completed intervals as one, touching intervals joined; the new number of events."""
        if len(done) <= MERGE_FOLDERS:
            return count
        before = W.partitionBy("consumer", "table_uuid", "block").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
        turns = self._items(done).withColumn("turn", (F.col("lo") > F.coalesce(F.max("hi").over(before), F.lit(-(2**62)))).cast("int"))
        upto = W.partitionBy("consumer", "table_uuid", "block").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, 0)
        runs = turns.withColumn("run", F.sum("turn").over(upto)).groupBy("consumer", "table_uuid", "block", "run")
        into = join(self.root, "leases", f"merged-{uuid.uuid4().hex}")
        runs.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run").write.parquet(into)
        self.log.append(count, {"state": "merged", "items": done, "into": into})
        return count + 1

    def work(self, lease: BatchLease, changes: DataFrame) -> DataFrame:
        """The leased changes: ``changes`` with a ``consumer``, each change once per consumer."""
        return (
            changes.withColumn("block", F.floor(F.col("sequence") / BLOCK))
            .join(self._items([lease.items]), ["table_uuid", "block"])
            .where("sequence > lo and sequence <= hi")
            .drop("block", "lo", "hi")
        )

    def _finish(self, lease: BatchLease, result: str) -> None:
        count, state = self.log.read()
        last = state["lease"]
        if lease.token != last["token"]:
            raise CommitConflict("stale fencing token", token=lease.token, newest=last["token"])
        if not last["open"]:
            if result == "done" and lease.output in state["outputs"][-1:]:
                return  # a retried completion
            raise InvalidData("lease is closed", token=lease.token)
        if result == "done" and self._clock() >= lease.expires_ms:
            raise CommitConflict("lease expired", token=lease.token)
        self.log.append(count, {"token": lease.token, "state": result, "items": lease.items, "output": lease.output})

    def complete(self, lease: BatchLease) -> None:
        self._finish(lease, "done")

    def release(self, lease: BatchLease) -> None:
        self._finish(lease, "released")

    def outputs(self) -> list[str]:
        return self.log.read()[1]["outputs"]
