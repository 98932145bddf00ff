"""The data-processing operators against brute force, on awkward small inputs."""

import json
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moraine.core.errors import CommitConflict, InvalidData, LakeError
from moraine.core.session import scratch_path
from moraine.functions.paths import canonical_path_text
from moraine.operators import changefeed, compaction, drift, hierarchy, incremental, nested, references
from moraine.plans import pipeline

ENTRY = "table_uuid string, manifest_path string, added_snapshot_id long, status int, snapshot_id long, sequence_number long, content int, file_path string, partition_tuple string, record_count long, file_size_in_bytes long, equality_ids array<int>, consumer string"
SNAP = "table_uuid string, snapshot_id long, parent_snapshot_id long, sequence_number long, timestamp_ms long, manifest_list string, schema_id long, file_path string"
RUN = "run_id long, consumer string, table_uuid string, from_sequence long, to_sequence long, run_status string, logged_ms long"


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def entry(table="t", path="f", status=1, sid=None, added=1, seq=None, content=0, part=None, records=1, size=10, ids=None):
    return (table, "m", added, status, sid, seq, content, path, part, records, size, ids, "clash")


# ---------------------------------------------------------------- 1: incremental


def test_unprocessed_changes_against_brute_force(spark):
    rng = random.Random(3)
    snaps = [(t, i, None, i * 2, 0, None, 0, "x") for t in "ab" for i in range(1, 30)]
    entries = [entry(rng.choice("ab"), f"f{rng.randrange(60)}", rng.choice([0, 1, 1, 2]), rng.choice([None, 5, 9]), rng.randrange(1, 32), rng.choice([None, None, 7])) for _ in range(150)]
    entries += entries[:30] + [entry(path=None), (None,) * 13, entry(table=None)]
    runs = []
    for r in range(40):
        c, t, lo = rng.choice("xyz"), rng.choice("abc"), rng.randrange(60)
        for at in range(rng.randrange(1, 4)):
            runs.append((r, c, t, rng.choice([lo, lo, None]) if r % 7 == 0 else lo, rng.choice([None, lo + 5, lo + 20]), rng.choice(["running", "succeeded", "failed", "rolled_back", "succeeded"]), at))
    runs += runs[:10]
    seq_of = {(s[0], s[1]): s[3] for s in snaps}
    changes = set()
    for e in entries:
        if e[3] in (1, 2) and e[7] is not None:
            s = seq_of.get((e[0], e[4] if e[4] is not None else e[2]))
            s = e[5] if e[3] == 1 and e[5] is not None else s
            if s is not None:
                changes.add((e[0], e[7], e[3], s))
    state = {}
    for r in runs:
        if r[0] not in state or r[6] >= state[r[0]][6]:
            state[r[0]] = r
    want = set()
    for c, t in {(r[1], r[2]) for r in runs}:
        done = [(r[3], r[4]) for r in state.values() if r[1:3] == (c, t) and r[5] == "succeeded" and None not in r[3:5]]
        want |= {(c, t, p, s) for tt, p, s, q in changes if tt == t and not any(lo < q <= hi for lo, hi in done)}
    frames = spark.createDataFrame(entries, ENTRY), spark.createDataFrame(snaps, SNAP), spark.createDataFrame(runs, RUN)
    assert set(tuples(incremental.unprocessed_changes(*frames))) == want
    changes_df = incremental.table_changes(*frames[:2])
    assert changes_df.count() == changes_df.distinct().count() == len(changes)
    small_blocks = incremental.ledger_states(changes_df.select("table_uuid", "sequence").distinct(), frames[2], block=3)
    assert tuples(small_blocks) == tuples(incremental.ledger_states(changes_df.select("table_uuid", "sequence").distinct(), frames[2]))
    empty = [f.limit(0) for f in frames]
    assert incremental.unprocessed_changes(*empty).count() == 0


def test_ledger_states_know_expired_leases(spark):
    points = spark.createDataFrame([("t", s) for s in (1, 2, 3)], "table_uuid string, sequence long")
    runs = spark.createDataFrame([(1, "c", "t", 0, 1, "succeeded", 10), (2, "c", "t", 1, None, "running", 100)], RUN)
    states = lambda now: [r.state for r in incremental.ledger_states(points, runs, now, lease_ms=50).orderBy("sequence").collect()]
    assert states(120) == ["done", "leased", "leased"] and states(150) == ["done", "pending", "pending"] and states(None) == states(150)


def test_work_ledger_survives_failures(spark, tmp_path):
    now = [1000]
    ledger = incremental.WorkLedger(str(tmp_path / "ledger"), spark, lease_ms=100, clock=lambda: now[0])
    rows = spark.createDataFrame([("t", s, f"f{s}") for s in range(1, 11)], "table_uuid string, sequence long, file_path string")
    done = []

    def work(df, path):
        done.append((path, [r.sequence for r in df.orderBy("sequence").collect()]))

    def crash(df, path):
        raise RuntimeError("boom")

    with pytest.raises(RuntimeError):
        ledger.run("c", rows, "t", 4, crash)
    assert ledger.run("c", rows, "t", 9, work) == 4 and done[-1][1] == [1, 2, 3, 4]  # the bounds of the attempt that failed
    a = ledger.lease("c", "t", 8)
    assert (a.lo, a.hi, a.token) == (4, 8, 3) and ledger.lease("c", "t", 10) is None
    now[0] += 200  # the holder of a is thought dead
    b = ledger.lease("c", "t", 10)
    assert (b.lo, b.hi) == (4, 8) and ledger.output_path(b) != ledger.output_path(a)
    with pytest.raises(CommitConflict):
        ledger.complete(a)
    ledger.complete(b)
    ledger.complete(b)
    with pytest.raises(CommitConflict):
        ledger.complete(a)
    assert ledger.watermark("c", "t") == 8
    c = ledger.lease("c", "t", 10)
    now[0] += 200
    with pytest.raises(CommitConflict):
        ledger.complete(c)  # too late, though nobody took over
    ledger.release(c)
    with pytest.raises(InvalidData):
        ledger.release(c)
    assert ledger.run("c", rows, "t", 10, work) == 10 and done[-1][1] == [9, 10] and ledger.run("c", rows, "t", 10, work) is None
    assert ledger.run("other", rows, "t", 10, work) == 10 and done[-1][1] == list(range(1, 11))


def test_retries_show_each_record_once(spark, tmp_path, monkeypatch):
    """A crash after writing, then a larger range, then a stale writer: readers see each record once."""
    monkeypatch.setattr(incremental, "STATE_EVERY", 2)
    now = [1000]
    ledger = incremental.WorkLedger(str(tmp_path / "ledger"), spark, lease_ms=100, clock=lambda: now[0])
    rows = spark.createDataFrame([("t", s) for s in range(1, 13)], "table_uuid string, sequence long")
    part = lambda x: rows.where(f"sequence > {x.lo} and sequence <= {x.hi}")
    a = ledger.lease("c", "t", 5)
    part(a).coalesce(1).write.parquet(ledger.output_path(a))
    now[0] += 200
    b = ledger.lease("c", "t", 8)
    part(b).coalesce(1).write.parquet(ledger.output_path(b))
    ledger.complete(b)
    rows.coalesce(1).write.mode("overwrite").parquet(ledger.output_path(a))  # the stale worker goes on writing
    for upto in (8, 10, 12):
        x = ledger.lease("c", "t", upto)
        part(x).coalesce(1).write.parquet(ledger.output_path(x))
        ledger.complete(x)
    seen = sorted(r.sequence for r in spark.read.parquet(*ledger.outputs("c", "t")).collect())
    assert seen == list(range(1, 13)) and ledger.watermark("c", "t") == 12 and ledger.lease("c", "t", 12) is None
    names = [n for n, _ in ledger.storage.listing(ledger._log("c", "t").folder)]
    assert sum(n.startswith("state-") for n in names) == 4


def test_batch_ledger_does_all_consumers(spark, tmp_path, monkeypatch):
    now = [1000]
    runs = spark.createDataFrame([(1, "c", "t", 0, 2, "succeeded", 10), (2, "c", "t", 4, 5, "succeeded", 10), (3, "d", "u", 0, 1, "failed", 1), (4, "d", "t", None, None, "running", 1)], RUN)
    rows = spark.createDataFrame([(t, s, f"{t}{s}") for t in "tu" for s in (1, 2, 3, 4, 5, 6, 5000, 9000)], "table_uuid string, sequence long, file_path string")
    ledger = incremental.BatchLedger(str(tmp_path / "ledger"), spark, runs, lease_ms=100, clock=lambda: now[0])
    first = ledger.lease(rows.where("sequence < 5000"))
    assert ledger.lease(rows) is None
    now[0] += 200
    again = ledger.lease(rows)
    assert again.items == first.items and again.output != first.output
    with pytest.raises(CommitConflict):
        ledger.complete(first)
    got = tuples(ledger.work(again, rows).select("consumer", "file_path"))
    assert got == sorted([("c", f"t{s}") for s in (3, 4, 6)] + [("d", f"{t}{s}") for t in "tu" for s in range(1, 7)])
    ledger.work(again, rows).write.parquet(again.output)
    ledger.complete(again)
    last = ledger.lease(rows)
    assert tuples(ledger.work(last, rows).select("consumer", "sequence")) == sorted([("c", 5000), ("c", 9000)] + [("d", 5000), ("d", 9000)] * 2)
    ledger.work(last, rows).write.parquet(last.output)
    ledger.complete(last)
    assert ledger.lease(rows) is None and spark.read.parquet(*ledger.outputs()).count() == 15 + 6
    monkeypatch.setattr(incremental, "MERGE_FOLDERS", 1)
    assert ledger.lease(rows) is None and len(ledger.log.read()[1]["done"]) == 1 and ledger.lease(rows) is None
    more = rows.unionByName(spark.createDataFrame([("t", 7, "t7")], rows.schema))
    assert tuples(ledger.work(ledger.lease(more), more).select("consumer", "file_path")) == [("c", "t7"), ("d", "t7")]


# ---------------------------------------------------------------- 2: change feed

FEED = "table_uuid string, file_path string, row_pos long, row_id long, row_key long, row_value long, del_path string, del_offset long, arrived_at timestamp, content int"


def test_change_feed_against_brute_force(spark):
    rng = random.Random(11)
    some = lambda n=4: rng.choice([None, *range(n)])
    spell = lambda p: rng.choice([p, p.replace("s3:", "s3a:"), p.replace("/f", "//f"), p.replace("-", "%2D"), p.replace("/b", "/./b")])
    entries, feed, files = [], [], {}
    for n in range(60):
        t, content, seq = rng.choice("ab"), rng.choice([0, 0, 1, 2]), rng.randrange(1, 20)
        path = f"s3://w-x/b/f{n}"
        ids = rng.choice([[1, 2], [2], [1]]) if content == 2 else None
        inherits, gone = rng.random() < 0.5, content == 0 and rng.random() < 0.15
        entries.append(entry(t, path, 1, None, seq, None if inherits else seq, content, ids=ids))
        if gone:
            entries.append(entry(t, path, 2, None, 25, seq, content, ids=ids))
        files[path] = (t, content, ids, seq, gone)
        for pos in range(rng.randrange(0, 8)):
            row = (some(), some(), some(9)) if content != 1 else (None, None, None)
            target = (spell(f"s3://w-x/b/f{rng.randrange(60)}"), rng.randrange(8)) if content == 1 else (None, None)
            feed.append((t, path, pos, *row, *target, None, 7))
    rng.shuffle(feed)
    feed += feed[:40] + [("a", "s3://unknown", 0, 1, 1, 1, None, None, None, 7), (None,) * 10]
    snaps = [(t, s, None, s, 0, None, 0, "x") for t in "ab" for s in range(30)]
    rows = {(r[1], r[2]): r for r in feed if r[1] in files and files[r[1]][1] == 0 and not files[r[1]][4]}
    positions = [(canonical_path_text(r[6]), r[7], files[r[1]][3]) for r in feed if r[1] in files and files[r[1]][1] == 1]
    keys = [(r, files[r[1]]) for r in feed if r[1] in files and files[r[1]][1] == 2]
    want = set()
    for (path, pos), r in rows.items():
        seq = files[path][3]
        dead = any(p == canonical_path_text(path) and o == pos and s >= seq for p, o, s in positions)
        dead = dead or any(k[0] == r[0] and f[3] > seq and all(k[2 + i] == r[2 + i] for i in f[2]) for k, f in keys)
        if not dead:
            want.add((path, pos))
    frames = spark.createDataFrame(entries, ENTRY), spark.createDataFrame(snaps, SNAP), spark.createDataFrame(feed, FEED)
    table, names = changefeed.apply_feed(spark, *frames, scratch_path(spark, "feed"), bucket_rows=20)
    got = tuples(table.read().join(names, "file_id").select("file_path", "row_pos"))
    assert set(got) == want and len(got) == len(want) and 0 < len(want) < len(rows)
    table, names = changefeed.apply_feed(spark, *(f.limit(0) for f in frames), scratch_path(spark, "feed"))
    assert table.read().count() == 0


def test_deletes_need_no_position_of_their_own(spark):
    files = [("s3://w/b/d", 1, 0, None), ("s3://w/b/p", 2, 1, None), ("s3://w/b/e", 2, 2, [1])]
    entries = spark.createDataFrame([entry("t", path, 1, None, seq, seq, content, ids=ids) for path, seq, content, ids in files], ENTRY)
    row = lambda path, pos, key, *at: ("t", path, pos, key, None, None, *(at or (None, None)), None, 7)
    feed = [*(row("s3://w/b/d", i, i) for i in range(4)), row("s3://w/b/d", None, 9), row("s3://w/b/p", None, None, "s3://w/b/d", 0), row("s3://w/b/e", None, 2)]
    table, names = changefeed.apply_feed(spark, entries, spark.createDataFrame([], SNAP), spark.createDataFrame(feed, FEED), scratch_path(spark, "feed"))
    assert sorted(tuples(table.read().join(names, "file_id").select("file_path", "row_pos"))) == [("s3://w/b/d", 1), ("s3://w/b/d", 3)]


def test_only_touched_buckets_are_written_again(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("sequence"), F.lit("a").alias("v"), F.lit(False).alias("deleted"))
    table = changefeed.BucketedTable(spark, str(tmp_path / "t"), ["k"])
    table.create(rows.drop("deleted").schema, 16)
    assert table.apply(rows.unionByName(rows)) == 1 and table.read().count() == 1000
    before = table.manifest()["files"]
    assert len(before) == 16 and all(len(fs) == 1 for fs in before.values())
    changes = spark.createDataFrame([(7, 2, None, True, 0), (7, 2, None, True, 0), (-1, 1, None, True, 0), (8, 5, "b", False, 0), (8, 4, "c", False, 0), (9, 0, "late", False, 0)], "k long, sequence long, v string, deleted boolean, clash int")
    version = table.apply(changes)
    after = table.manifest(version)["files"]
    assert 1 <= len({b for b in before if before[b] != after.get(b)}) <= 4
    assert {r.k: r.v for r in table.read().where("k in (-1, 7, 8, 9)").collect()} == {8: "b", 9: "a"} and table.read(1).count() == 1000
    assert table.apply(changes.limit(0)) == 3 and table.read().count() == 999
    with pytest.raises(CommitConflict):
        table._commit(3, {})
    with pytest.raises(InvalidData):
        changefeed.BucketedTable(spark, str(tmp_path / "u"), ["x"]).create(rows.schema, 4)
    table.expire()
    assert table.read().count() == 999


def test_feeds_in_any_order_equal_a_replay(spark, tmp_path):
    rng = random.Random(8)
    changes = [(rng.choice([None, *range(12)]), rng.choice("ab"), s, rng.randrange(100), rng.random() < 0.3) for s in range(200)]
    want = {}
    for k, part, s, v, gone in changes:
        want[k, part] = None if gone else v
    rng.shuffle(changes)
    shape = "k long, part string, sequence long, v long, deleted boolean"
    table = changefeed.BucketedTable(spark, str(tmp_path / "t"), ["k", "part"])
    table.create(spark.createDataFrame([], "k long, part string, sequence long, v long").schema, 4)
    for lo in range(0, 200, 70):
        table.apply(spark.createDataFrame(changes[lo : lo + 80], shape))  # some come twice
    assert {(r.k, r.part): r.v for r in table.read().collect()} == {k: v for k, v in want.items() if v is not None}


# ---------------------------------------------------------------- 3: compaction


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=60), st.integers(1, 9))
def test_least_loaded_is_balanced(sizes, groups):
    sizes = np.array(sizes, dtype=np.int64)
    owner = compaction.least_loaded(sizes, groups)
    loads = np.bincount(owner, weights=sizes, minlength=groups)
    assert loads.sum() == sizes.sum() and loads.max() <= sizes.sum() / groups + sizes.max()


def test_compaction_plan_covers_each_file_once(spark):
    rng = random.Random(2)
    entries = [entry(rng.choice("ab"), f"f{i}", 1, part=rng.choice([None, "p=1", "p=2"]), size=rng.choice([None, 0, 100, 5000, 300_000]), content=rng.choice([0, 0, 0, 1])) for i in range(400)]
    entries += [entry("a", f"f{i}", 2) for i in range(0, 400, 9)] + entries[:50] + [entry("c", "only", size=5), entry(path=None), entry("d", "x", part="", size=5), entry("d", "y", part=None, size=5)]
    live = {}
    for e in entries:
        if e[7] is not None and e[6] == 0:
            live.setdefault((e[0], e[7]), []).append(e)
    groups = {}
    for k, es in live.items():
        size = max((e[10] for e in es if e[10] is not None), default=None)
        if not any(e[3] == 2 for e in es) and size is not None and size < 262_144:
            groups.setdefault((k[0], max((e[8] for e in es if e[8] is not None), default=None)), set()).add(k)
    want = set().union(*(g for g in groups.values() if len(g) > 1))
    files = compaction.live_files(spark.createDataFrame(entries, ENTRY))
    for shard_files in (4096, 7):
        plan = compaction.plan_compaction(files, target_bytes=20_000, shard_files=shard_files).collect()
        assert sorted((r.table_uuid, r.file_path) for r in plan) == sorted(want)
        by_group = {}
        for r in plan:
            by_group.setdefault((r.table_uuid, r.partition_tuple, r.shard, r.out_group), []).append(r.file_size_in_bytes)
        assert shard_files == 7 or max(map(sum, by_group.values())) < 40_000
    assert compaction.plan_compaction(files.limit(0)).count() == 0


def test_rewritten_files_hold_the_same_records(spark, tmp_path):
    rows = []
    for i in range(12):
        path = str(tmp_path / f"in{i}.parquet")
        table = pa.table({"a": pa.array(range(i * 3, i * 3 + i % 4), pa.int64()), "b": pa.array([None] * (i % 4), pa.string())})
        pq.write_table(table if i % 2 else table.drop_columns(["b"]), path)
        rows.append(entry("t", path, part="p", records=i % 4 if i else None, size=len(open(path, "rb").read())))
    plan = compaction.plan_compaction(compaction.live_files(spark.createDataFrame(rows, ENTRY)), target_bytes=3000)
    out = str(tmp_path / "out")
    manifest = compaction.rewrite_files(spark, plan, out)
    assert manifest.agg(F.sum("inputs")).first()[0] == 12 and manifest.count() < 12
    merged = spark.read.parquet(*[r.out_path for r in compaction.published(spark, out).collect()])
    assert sorted(r.a for r in merged.collect()) == sorted(x for i in range(12) for x in range(i * 3, i * 3 + i % 4))
    with pytest.raises(CommitConflict):
        compaction.rewrite_files(spark, plan, out)
    short = plan.withColumn("record_count", F.coalesce("record_count", F.lit(0)) + (F.col("file_path").like("%in3.parquet")).cast("long"))
    with pytest.raises(InvalidData):  # a file has fewer records than the plan knows
        compaction.rewrite_files(spark, short, str(tmp_path / "short"))
    assert not (tmp_path / "short" / "current.json").exists()


def test_small_files_are_written_one_to_a_key(spark, tmp_path):
    rows = spark.createDataFrame([(t, f, i) for i in range(40) for t, f in [("a", "x"), (None, "x"), ("b", None), ("a", str(i % 7))]], "t string, f string, i int")
    listing = compaction.write_small_files(rows, ["t", "f"], f"file://{tmp_path}/small").collect()
    assert len(listing) == 10 and sum(r.record_count for r in listing) == 160 and all(r.file_size_in_bytes > 0 for r in listing)
    back = spark.read.parquet(*(r.path for r in listing))
    assert tuples(back) == tuples(rows) and compaction.write_small_files(rows.limit(0), ["t"], f"file://{tmp_path}/none").count() == 0


# ---------------------------------------------------------------- 4: hierarchies


def forest_answer(parents):
    out = {}
    for n in parents:
        seen, m, d = set(), n, 0
        while parents.get(m) in parents and m not in seen:
            seen.add(m)
            m, d = parents[m], d + 1
        out[n] = (-1, -1) if m in seen else (m, d)
    return out


def random_forest(rng, n):
    kind = rng.choice(["chain", "random", "star", "cycles"])
    parents = {0: None}
    for i in range(1, n):
        parents[i] = {"chain": i - 1, "random": rng.randrange(i), "star": rng.choice([0, i - 1]), "cycles": rng.randrange(n)}[kind]
    if rng.random() < 0.5 and n > 3:
        parents[rng.randrange(n)] = 10_000  # leads nowhere
        parents[1] = 1
    return parents


def test_lineage_against_brute_force(spark):
    rng = random.Random(1)
    rows, want = [], set()
    for t in range(8):
        parents = random_forest(rng, rng.choice([1, 2, 30, 40]))
        answer = forest_answer(parents)
        rows += [(f"t{t}", i, p, i if t % 2 else rng.randrange(1000), 0, None, 0, "x") for i, p in parents.items()]
        want |= {(f"t{t}", i, *answer[i]) for i in parents}
    descendants = {}
    for t, i, p, *_ in rows:
        if (t, i, -1, -1) not in want:
            up = {r[1]: r[2] for r in rows if r[0] == t}
            m = i
            while m in up:
                descendants.setdefault((t, m), set()).add(i)
                m = up[m]
    below = {k: len(v) - 1 for k, v in descendants.items()}
    rows += rows[:20] + [("t0", None, 3, 1, 0, None, 0, "x")]
    df = spark.createDataFrame(rows, SNAP)
    args = ("table_uuid", "snapshot_id", "parent_snapshot_id", "sequence_number")
    for range_nodes in (100_000, 40, 8):
        got = tuples(hierarchy.lineage(df, *args, range_nodes=range_nodes))
        assert len(got) == len(want) and {g[:4] for g in got} == want
        assert all(g[4] == below.get(g[:2], -1) for g in got)
    for range_nodes in (100_000, 40):
        rows_ = hierarchy.spans(df, *args, range_nodes=range_nodes).collect()
        assert {(r.tree, r.node_id, r.root_id, r.depth) for r in rows_} == want
        sane = [r for r in rows_ if r.root_id != -1]
        assert all(r["first"] is None and r["last"] is None for r in rows_ if r.root_id == -1)
        for r in sane:
            inside = {x.node_id for x in sane if (x.tree, x.root_id) == (r.tree, r.root_id) and r["first"] <= x["first"] <= r["last"]}
            assert inside == descendants[r.tree, r.node_id]
    assert hierarchy.lineage(df.limit(0), *args).count() == 0


def test_splicing_finishes_scattered_chains(spark):
    rng = random.Random(4)
    order = list(range(14))
    rng.shuffle(order)
    links = [(n, order[i - 1] if i else -1, n) for i, n in enumerate(order)] + [(1000 + i, 1000 + (i + 1) % 4, i) for i in range(4)] + [(2000, 1003, 5)]
    df = spark.createDataFrame(links, "node long, parent long, place long")
    records = []
    one = lambda n: F.lit(n).cast("long")
    core = df.select("node", "parent", one(1).alias("weight"), "place", one(1).alias("own"), one(0).alias("extra"))
    solved = hierarchy._reversed(hierarchy._finish_by_splicing(core, records, 64), records)
    want = {(n, order[0], i, len(order) - i) for i, n in enumerate(order)} | {(n, -1, -1, -1) for n in [*range(1000, 1004), 2000]}
    assert set(tuples(solved)) == want


def test_ancestry_lists_every_ancestor(spark):
    links = spark.createDataFrame([(0, -1), (1, 0), (2, 1), (3, 2), (4, 1), (5, -1)], "node long, parent long")
    got = tuples(hierarchy.ancestry(links, spark.createDataFrame([(3,), (5,)], "node long")))
    assert got == [(3, 0, 3), (3, 1, 2), (3, 2, 1), (3, 3, 0), (5, 5, 0)]


def test_every_path_is_written_out(spark, tmp_path):
    rng = random.Random(6)
    parents = [random_forest(rng, n) for n in (1, 2, 30, 40)] + [{i: i - 1 for i in range(25)}, {i: min(i - 1, 9) for i in range(40)}]
    rows, want = [], set()
    for t, forest in enumerate(parents):
        answer = forest_answer(forest)
        for i, p in forest.items():
            rows.append((f"t{t}", i, p, rng.randrange(1000), 0, None, 0, "x"))
            want |= {(f"t{t}", i, -1, -1)} if answer[i] == (-1, -1) else set()
            m = i
            for distance in range(answer[i][1] + 1):
                want.add((f"t{t}", i, m, distance))
                m = forest[m]
    df = spark.createDataFrame(rows + rows[:20] + [("t0", None, 3, 1, 0, None, 0, "x")], SNAP)
    args = ("table_uuid", "snapshot_id", "parent_snapshot_id", "sequence_number")
    got = tuples(hierarchy.paths(df, *args, stride=3, task_rows=7))
    assert len(got) == len(want) and set(got) == want
    assert hierarchy.paths(df.limit(0), *args).count() == 0
    df.write.parquet(f"{tmp_path}/snapshots.parquet")
    query = pipeline.QUERIES["p4_paths"](spark, str(tmp_path))
    assert query.columns == ["table_uuid", "snapshot_id", "ancestor_snapshot_id", "distance"] and set(tuples(query)) == want


@settings(deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60))
def test_contraction_of_one_range(seed, n):
    parents = random_forest(random.Random(seed), n)
    node = np.array(list(parents), dtype=np.int64) + 5
    parent = np.array([-1 if p not in parents else p + 5 for p in parents.values()], dtype=np.int64)
    children = np.array([sum(p == q for p in parent) for q in node])
    (gone, ref, far, heir, size), (kept, up, dist, root, own, extra), (to, _) = hierarchy.contract(node, parent, np.ones(n, np.int64), children, np.ones(n, np.int64), np.zeros(n, np.int64))
    assert not len(to) and all(h == -1 or h in kept for h in heir)
    answer, place = forest_answer(parents), {}
    for k, u, r in zip(kept, up, root):
        place[k] = (k - 5, 0) if r else (-1, -1)
        assert r or u in kept
    for g, r, f in zip(gone, ref, far):
        base = place[r]
        place[g] = (-1, -1) if base[0] == -1 else (base[0], base[1] + f)
    assert {k - 5: v for k, v in place.items()} == answer


# ---------------------------------------------------------------- 5 and 6: schemas


def schema_json(sid, fields, **more):
    return {"type": "struct", "schema-id": sid, "fields": fields, **more}


def fld(i, name, t, **more):
    return {"id": i, "name": name, "required": False, "type": t, **more}


LIST = {"type": "list", "element-id": 3, "element": {"type": "struct", "fields": [fld(4, "x.y", "int"), fld(5, "m", {"type": "map", "key-id": 6, "key": "string", "value-id": 7, "value": {"type": "list", "element-id": 8, "element": "decimal(9, 2)", "element-required": True}, "value-required": False})]}, "element-required": False}
S0 = schema_json(0, [fld(1, "id", "long"), fld(2, "items", LIST), fld(9, "s", {"type": "struct", "fields": [fld(10, "in", "date")]}), fld(11, "d", "decimal(9,2)")])
S2 = schema_json(2, [fld(1, "ID", "long"), fld(2, "items", {**LIST, "element": "string"}), fld(9, "s", {"type": "struct", "fields": [fld(10, "in", "string"), fld(12, "new", "int", **{"initial-default": 4})]}), fld(11, "d", "decimal(9, 2)")], **{"identifier-field-ids": [1]})
META = "metadata_file string, table_uuid string, last_updated_ms long, schemas_json string, current_schema_id int, name string"


def test_schema_fields_and_changes(spark):
    docs = [("m1", "t", 1, json.dumps([S0]), 0, "n"), ("m2", "t", 2, json.dumps([S2, S0], indent=2), 2, "n"), ("m3", "u", 1, json.dumps([S0]), 0, "n"), ("m4", "v", 1, None, 0, "n"), ("m5", "w", 1, "[]", 0, "n"), ("m2", "t", 2, json.dumps([S2, S0], indent=2), 2, "n")]
    meta = spark.createDataFrame(docs, META)
    schemas = nested.table_schemas(meta)
    fields = nested.schema_fields(schemas)
    got = {(r.table_uuid, r.schema_id, r.field_id): (r.parent_field_id, r.name, r.kind) for r in fields.collect()}
    of = lambda sid: {k[2]: v for k, v in got.items() if k[:2] == ("t", sid)}
    assert of(0) == {
        1: (-1, "id", "long"), 2: (-1, "items", "list"), 3: (2, "element", "struct"), 4: (3, "x.y", "int"), 5: (3, "m", "map"), 6: (5, "key", "string"),
        7: (5, "value", "list"), 8: (7, "element", "decimal(9,2)"), 9: (-1, "s", "struct"), 10: (9, "in", "date"), 11: (-1, "d", "decimal(9,2)"),
    }
    assert len(got) == 11 + 11 + 7
    changes = {tuple(r)[1:] for r in drift.schema_changes(nested.schema_rows(schemas)).collect()}
    assert changes == {(2, 1, "renamed"), (2, 3, "retyped"), (2, 10, "retyped"), (2, 12, "added"), *((2, i, "removed") for i in (4, 5, 6, 7, 8))}
    odd = spark.createDataFrame([("t", s, *f) for s, f in [(1, (None, None, None)), (1, (1, "a", "int")), (1, (1, "b", "int")), (1, (2, "x", "int")), (4, (None, None, None)), (6, (None, None, None)), (6, (1, "b", "long")), (6, (2, "y", "long"))]], "table_uuid string, schema_id int, field_id int, name string, kind string")
    assert {tuple(r)[1:] for r in drift.schema_changes(odd).collect()} == {(4, 1, "removed"), (4, 2, "removed"), (6, 1, "added"), (6, 2, "added")}
    union = {r.field_id: [b.kind for b in r.branches] for r in drift.fuse_schemas(fields).where("table_uuid = 't'").collect()}
    assert union[3] == ["struct", "string"] and union[10] == ["date", "string"] and union[11] == ["decimal(9,2)"]


def test_records_under_the_current_schema(spark):
    meta = spark.createDataFrame([("m1", "t", 1, json.dumps([S0]), 0, "n"), ("m2", "t", 2, json.dumps([S0, S2]), 2, "n")], META)
    rows = [
        ("t", "f", 0, 0, json.dumps({"id": 1, "items": [{"x.y": 3}, None], "s": {"in": "2020-01-01"}, "d": "1.50", "odd": 5})), ("t", "f", 1, None, json.dumps({"ID": 2, "s": {"new": 9}})),
        ("t", "g", 0, None, json.dumps({"id": 7})), ("t", "f", 2, 0, "no json"), ("t", "f", 3, 0, None), ("t", "f", 4, 77, "{}"), ("zzz", "f", 0, 0, "{}"),
    ]
    records = spark.createDataFrame(rows + rows[:2], "table_uuid string, file_path string, row_pos long, schema_id int, payload string")
    entries = spark.createDataFrame([entry("t", "f", 1, 1), entry("t", "g", 1, 2)], ENTRY)
    snaps = spark.createDataFrame([("t", 1, None, 1, 0, None, 2, "x"), ("t", 2, None, 2, 0, None, None, "x")], SNAP)
    got = {(r.file_path, r.row_pos): (r.payload and json.loads(r.payload), r.branches) for r in drift.unified_records(records, meta, entries, snaps).where("table_uuid = 't'").collect()}
    assert got["f", 0] == ({"ID": 1, "items": [None, None], "s": {"in": "2020-01-01", "new": 4}, "d": "1.50"}, {"3[0]:struct": '{"x.y":3}', "odd:json": "5"})
    assert got["f", 1] == ({"ID": 2, "items": None, "s": {"in": None, "new": 9}, "d": None}, None)
    assert got["g", 0][1] == {"id:json": "7"}  # no schema id anywhere: the current schema
    assert got["f", 2] == (None, {"$raw": "no json"}) and got["f", 3] == (None, None) and got["f", 4] == (None, {"$raw": "{}"})
    assert len(got) == 6


def test_records_that_differ_at_one_position_are_all_kept(spark):
    meta = spark.createDataFrame([("m1", "t", 1, json.dumps([S0, S2]), 2, "n")], META)
    rows = [("t", "f", 0, 2, '{"ID": 1}'), ("t", "f", 0, 2, '{"ID": 2}'), ("t", "f", 0, 0, '{"ID": 1}'), ("t", "f", None, 2, '{"ID": 3}'), ("t", "f", None, 2, '{"ID": 4}'), ("t", "f", 1, None, None)]
    records = spark.createDataFrame(rows * 2, "table_uuid string, file_path string, row_pos long, schema_id int, payload string")
    got = drift.unified_records(records, meta, spark.createDataFrame([], ENTRY), spark.createDataFrame([], SNAP)).collect()
    ids = sorted((-1 if r.row_pos is None else r.row_pos, r.payload and json.loads(r.payload)["ID"] or 0, str(r.branches)) for r in got)
    assert ids == [(-1, 3, "None"), (-1, 4, "None"), (0, 0, "{'ID:json': '1'}"), (0, 1, "None"), (0, 2, "None"), (1, 0, "None")]


def test_snapshots_without_schema_take_the_last_one_before(spark):
    rng = random.Random(3)
    rows = [(t, s * 10, None, s, 0, None, rng.choice([None, None, 1, 2, 3]), "x") for t in "ab" for s in rng.sample(range(100), 40)]
    want, last = set(), {}
    for r in sorted(rows, key=lambda r: r[3]):
        last[r[0]] = r[6] if r[6] is not None else last.get(r[0])
        want.add((r[0], r[1], last[r[0]]))
    df = spark.createDataFrame(rows + rows[:5], SNAP)
    assert set(tuples(drift.snapshot_schemas(df, block=7))) == set(tuples(drift.snapshot_schemas(df))) == want


@pytest.mark.parametrize(
    ("value", "source", "target", "want"),
    [
        (5, "int", "long", 5), (2**40, "long", "int", None), ("5", "string", "int", 5), ("5.5", "string", "int", None), (5, "int", "string", "5"), (1.5, "double", "decimal(9,1)", "1.5"),
        ("1.55", "decimal(9,2)", "decimal(9,1)", None), (True, "boolean", "string", "true"), ("x", "string", "boolean", None), ("2020-01-01", "date", "timestamp", "2020-01-01T00:00:00"),
        ("2020-01-01T00:00:00", "timestamp", "date", "2020-01-01"), ("2020-01-01T01:00:00", "timestamp", "date", None), ("2020-01-01T00:00:00+00:00", "timestamptz", "timestamp", "2020-01-01T00:00:00"), (None, "int", "date", None),
        ("9" * 36 + ".12", "string", "decimal(38,2)", "9" * 36 + ".12"),
        (2**53 + 1, "long", "double", None), (2**53, "long", "double", 2.0**53), ("0.1", "decimal(9,1)", "double", 0.1), ("0.1234567890123456789", "decimal(38,19)", "double", None),
        (1 / 3, "double", "float", None), (0.5, "double", "float", 0.5), (16777217, "int", "float", None), ("x", "string", "double", None), (1e300, "double", "float", None),
    ],
)
def test_conversions_lose_nothing(value, source, target, want):
    assert drift.convert_scalar(value, source, target)[0] == want


def test_values_that_break_their_schema_are_kept():
    spill = {}
    got = drift.convert({"items": 5, "s": [1], "id": 1}, S0, S0, "", spill)
    assert got == {"id": 1, "items": None, "s": None, "d": None} and spill == {"2:json": 5, "9:json": [1]}


def test_every_value_inside_lists_and_maps_has_a_branch_of_its_own(spark):
    def nest(kind, gone):
        inner = {"type": "struct", "fields": [fld(4, "a", kind), *([fld(5, "b", "int")] if gone else [])]}
        grid = {"type": "list", "element-id": 6, "element": {"type": "list", "element-id": 7, "element": inner}}
        return [fld(1, "l", {"type": "list", "element-id": 3, "element": inner}), fld(2, "m", {"type": "map", "key-id": 8, "key": "string", "value-id": 9, "value": inner}), fld(10, "g", grid)]

    old, new = schema_json(0, nest("string", True)), schema_json(1, nest("int", False))
    payload = {
        "l": [{"a": "x", "b": 1}, {"a": "y", "b": 2}, {"a": "3"}], "m": {"k": {"a": "u", "b": 3}, "n": {"a": "v", "c": 4}, "k].4:string": {"a": "w"}},
        "g": [[{"a": "p"}, {"a": "q"}], [{"a": "r"}]], "3[0].4:string": 7, "5": 8,
    }
    meta = spark.createDataFrame([("m1", "t", 1, json.dumps([old, new]), 1, "n")], META)
    records = spark.createDataFrame([("t", "f", 0, 0, json.dumps(payload))], "table_uuid string, file_path string, row_pos long, schema_id int, payload string")
    (got,) = drift.unified_records(records, meta, spark.createDataFrame([], ENTRY), spark.createDataFrame([], SNAP)).collect()
    assert json.loads(got.payload) == {"l": [{"a": None}, {"a": None}, {"a": 3}], "m": {k: {"a": None} for k in payload["m"]}, "g": [[{"a": None}] * 2, [{"a": None}]]}
    assert got.branches == {
        "3[0].4:string": "x", "3[0].5:int": "1", "3[1].4:string": "y", "3[1].5:int": "2", "9[k].4:string": "u", "9[k].5:int": "3", "9[n].4:string": "v", "9[n].c:json": "4",
        '9["k].4:string"].4:string': "w", "6[0].7[0].4:string": "p", "6[0].7[1].4:string": "q", "6[1].7[0].4:string": "r", '"3[0].4:string":json': "7", '"5":json': "8",
    }


def test_map_entries_whose_keys_do_not_fit_are_kept():
    def table(key):
        return schema_json(0, [fld(1, "m", {"type": "map", "key-id": 2, "key": key, "value-id": 3, "value": "int"})])

    spill = {}
    got = drift.convert({"m": {"1": 10, "01": 11, "a": 12, "b": 13}}, table("string"), table("int"), "", spill)
    assert got == {"m": {"1": 10}} and spill == {"3[01]:int": 11, "3[a]:int": 12, "3[b]:int": 13}


def test_flattening_documents(spark):
    docs = [(1, '{"a": {"b": 1, "c.d": "x"}, "l": [{"v": 1.5, "k": [1, 2]}, {"v": null}], "e": []}'), (2, "nope"), (3, None), (4, "[[1],[]]"), (5, '{"l": [{"v": true}]}'), (6, "null")]
    flat = nested.flatten(spark.createDataFrame(docs, "id int, doc string"), "id", "doc")
    rows = flat.collect()
    assert len([r for r in rows if r.doc_key == "1"]) == 5 and not [r for r in rows if r.doc_key == "3"]
    table = nested.relation_table(flat, "$/l")
    assert table.columns == ["doc_key", "row_key", "parent_key", "ordinal", "v"] and sorted(r.v or "" for r in table.collect()) == ["", "1.5", "true"]
    inner = nested.relation_table(flat, "$/l/k")
    assert [(r.parent_key, r.ordinal, r.value) for r in inner.orderBy("ordinal").collect()] == [("$/l[0]", 0, 1), ("$/l[0]", 1, 2)]
    root = nested.relation_table(flat, "$")
    assert "a.b" in root.columns and "a.c\\.d" in root.columns and root.where("doc_key = '2'").first()["$error"] == "nope"
    values = ['"01234"', "1234567890123456789", '"true"', "true", "12345678901234567890123", "0.1", "0.12345678901234567890123", "1" * 50, "1e999", "3"]
    typed = nested.flatten(spark.createDataFrame([(i, f'{{"v{i}": {v}, "w": {v}}}') for i, v in enumerate(values)], "id int, doc string"), "id", "doc")
    one = nested.relation_table(typed, "$")
    kinds = {f.name: f.dataType.simpleString() for f in one.schema}
    assert [kinds[f"v{i}"] for i in range(10)] == ["string", "bigint", "string", "boolean", "decimal(38,0)", "double", "string", "string", "string", "bigint"]
    found = {r.doc_key: r for r in one.collect()}
    assert [str(found[str(i)][f"v{i}"]) for i in range(10)] == ["01234", values[1], "true", "True", values[4], "0.1", values[6], values[7], "1E+999", "3"]
    assert kinds["w"] == "string" and found["0"].w == "01234" and found["1"].w == values[1]
    deep = "[" * 900 + "1" + "]" * 900
    assert nested.flatten(spark.createDataFrame([(1, deep)], "id int, doc string"), "id", "doc").count() == 901


def test_cells_are_those_of_all_typed_tables(spark, tmp_path):
    docs = [(1, '{"a": {"b": 1, "c.d": "x"}, "l": [{"v": 1.5, "k": [1, 2]}, {"v": null}, {}], "e": [], "n": null}'), (2, '{"n": 2, "l": [{"v": 7, "k": [9007199254740993]}]}'), (3, None), (4, "[[true],[]]")]
    flat = nested.flatten(spark.createDataFrame(docs, "id int, doc string"), "id", "doc").cache()
    cells = nested.typed_cells(flat).collect()
    assert {(r.doc_key, r.row_key) for r in cells} == {(r.doc_key, r.row_key) for r in flat.collect()}
    assert [(r.row_key, r.ordinal) for r in cells if r.name is None and r.doc_key == "1"] == [("$/l[2]", 2)]
    for relation in {r.relation for r in cells}:
        table = nested.relation_table(flat, relation)
        types = {f.name: f.dataType.simpleString() for f in table.schema}
        here = [r for r in cells if r.relation == relation]
        assert all(types[r.name or "value"] == r.type for r in here if r.name is not None)
        want = {(r.doc_key, r.row_key, c, str(r[c]).replace("True", "true").replace(".0", "")) for r in table.collect() for c in table.columns[4:] if r[c] is not None}
        assert {(r.doc_key, r.row_key, r.name or "value", r.value) for r in here if r.value is not None} == want
    struct = lambda *f: {"type": "struct", "fields": list(f)}
    deep = struct(fld(5, "x", struct(fld(6, "y", "int", doc="d"))))
    schema = schema_json(0, [fld(1, "m", {"type": "map", "key-id": 2, "key": "string", "value-id": 3, "value": deep, "value-required": True})], **{"identifier-field-ids": [6]})
    spark.createDataFrame([("m1", "t", 1, json.dumps([schema]), 0, "n")], META).write.parquet(f"{tmp_path}/table_metadata.parquet")
    got = {(r.relation, r.row_key, r.parent_key, r.name, r.type, r.value) for r in pipeline.QUERIES["p6_tables"](spark, str(tmp_path)).collect()}
    value = "$/fields[0]/type.value.fields[0]"
    assert len(got) == 2 + 9 + 4 + 5 + 1
    assert {
        ("$", "$", None, "schema-id", "bigint", "0"), ("$/fields", "$/fields[0]", "$", "type.value-required", "boolean", "true"),
        ("$/fields/type.value.fields", value, "$/fields[0]", "id", "bigint", "5"), ("$/fields/type.value.fields/type.fields", f"{value}/type.fields[0]", value, "doc", "string", "d"),
        ("$/identifier-field-ids", "$/identifier-field-ids[0]", "$", "", "bigint", "6"),
    } <= got


# ---------------------------------------------------------------- 7: references


def test_orphans_against_brute_force(spark):
    rng = random.Random(6)
    spell = lambda p: rng.choice([p, p.replace("s3:", "s3n:"), p.replace("/x", "//x"), p.replace("-", "%2D")])
    listing = []
    for i in range(60):
        for at in rng.sample(range(100), rng.randrange(0, 3)):
            listing.append((spell(f"s3://a-b/x{i}"), 1, rng.randrange(50), rng.choice([None, None, 70]), at))
    listing += [(None, 1, 1, None, 1)]
    snaps = [("t", i, None, i, rng.randrange(60), rng.choice([None, f"s3://a-b/x{rng.randrange(70)}"]), 0, "x") for i in range(30)]
    log = [(rng.choice("tu"), rng.randrange(60), rng.choice([None, f"s3a://a-b/x{rng.randrange(70)}"])) for _ in range(40)]
    entries = [entry("t", rng.choice([None, f"s3://a-b/x{rng.randrange(70)}"]), rng.choice([0, 1, 1, 1, 2]), rng.choice([None, 3]), rng.randrange(32)) for _ in range(60)]
    newest = {}
    for p, _, created, deleted, at in listing:
        if p is not None and at > newest.get(canonical_path_text(p), (-1,))[0]:
            newest[canonical_path_text(p)] = (at, created, deleted)
    times = {s[1]: s[4] for s in snaps}
    refs = {}
    for s in snaps:
        refs.setdefault(("snapshots", "t", s[5]), []).append(s[4])
    for t, at, p in log:
        refs.setdefault(("metadata_log", t, p), []).append(at)
    for e in entries:
        refs.setdefault(("manifest_entries", "t", e[7]), []).append(times.get(e[4] if e[4] is not None else e[2]))
    removed = {e[7] for e in entries if e[3] == 2}
    want = set()
    for (table, t, p), ats in refs.items():
        if p is None or table == "manifest_entries" and p in removed:
            continue
        at = min((a for a in ats if a is not None), default=None)
        hit = newest.get(canonical_path_text(p))
        state = "missing" if hit is None else "deleted" if hit[2] is not None else "late" if at is not None and hit[1] > at else None
        if state:
            want.add((table, t, p, None if at is None else "1970-01", state))
    frames = spark.createDataFrame(snaps, SNAP), spark.createDataFrame(log, "table_uuid string, timestamp_ms long, metadata_file string"), spark.createDataFrame(entries, ENTRY)
    stored = spark.createDataFrame(listing, "file_path string, file_size_in_bytes long, created_ms long, deleted_ms long, listed_ms long")
    found = references.orphan_references(references.lake_references(*frames), stored, 500)
    assert set(tuples(found)) == want and found.count() == len(want)
    assert references.orphan_report(found).agg(F.sum("orphans")).first()[0] == len(want)
    none = references.orphan_references(references.lake_references(*frames), stored.limit(0), 500)
    assert {r.state for r in none.collect()} == {"missing"}


def test_equal_hashes_do_not_confuse_the_probe():
    keys, names = np.array([5, 5, 5, 9]), pa.array(["a", "b", "c", "d"])
    ref = pa.RecordBatch.from_pydict({"k": pa.array([5, 5, 9, 7, 5]), "object": ["c", "x", "d", "a", "a"], "at_ms": pa.array([1, 1, 1, 1, None], pa.int64())})
    got = references._lookup(ref, keys, names, np.array([2.0, 0, 0, 0]), np.array([np.nan, np.nan, 1, np.nan]))
    assert got.tolist() == ["deleted", "missing", "found", "missing", "found"]


def test_a_cluster_without_shared_folder_is_refused():
    from moraine.core import session

    class Option:
        def isDefined(self):
            return False

        isEmpty = isDefined

    class Context:
        master = "spark://x"

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():
                        return Option()

                return S

    class Session:
        sparkContext = Context

        class conf:
            @staticmethod
            def get(key, default=None):
                return None

    with pytest.raises(LakeError):
        session.shared_root(Session)
