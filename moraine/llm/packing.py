"""Filling fixed-capacity containers with texts, measured in tokens of a public tokenizer.

Two plans are made from the global histogram of lengths, which has at most as many entries as the
capacity; whole texts and their numbers stay on the executors:

* ``bucket_plan`` - dynamic programming chooses the bucket boundaries that minimise padding, and
  batches within the token budget form inside each bucket. A container then holds similar lengths.
* ``best_fit_plan`` - lengths in falling order, each to the container with the least sufficient
  space, many equal containers at a time. A container mixes lengths, so little space is lost.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..core.session import cut, parallelism

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splitting rule of the byte-level tokenizer; a fixed value that belongs to its vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUCKETS = 32


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of whole texts; a null text gives no row, an empty one 0 tokens.

    The vocabulary file goes to the executors through Spark's files.
    """
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoder = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(encoder.encode_ordinary(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    base = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return base.mapInArrow(run, "doc_id bigint, n_tokens bigint")


def capacities(containers: DataFrame) -> dict[str, int]:
    """Capacity by container kind; of several the least, those of no or negative capacity left out. A list
    of a few rows, which is a setting and not data."""
    rows = containers.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.min("capacity_tokens").alias("cap")).collect()
    return {r.container_kind: int(r.cap) for r in rows}


def pieces(counts: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, doc_id, piece, start_token, n_tokens): only texts above the capacity are cut,
    into full containers and one rest."""
    out = None
    for kind, cap in sorted(capacities(containers).items()):
        last = F.greatest(F.ceil(F.col("n_tokens") / cap) - 1, F.lit(0))
        part = counts.select("doc_id", "n_tokens", F.posexplode(F.sequence(F.lit(0).cast("bigint"), last))).select(
            F.lit(kind).alias("container_kind"), "doc_id", F.col("pos").alias("piece"), (F.col("col") * cap).alias("start_token"),
            F.least(F.col("n_tokens") - F.col("col") * cap, F.lit(cap)).cast("int").alias("n_tokens"),
        )
        out = part if out is None else out.unionByName(part)
    return counts.sparkSession.createDataFrame([], "container_kind string, doc_id bigint, piece int, start_token bigint, n_tokens int") if out is None else out


@dataclass(frozen=True)
class Run:
    """Items of one length with ranks from ``rank`` on: ``count`` of them, ``per`` in each container from ``first`` on."""

    length: int
    rank: int
    count: int
    first: int
    per: int
    bucket: int = 0


def optimal_buckets(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper boundaries that minimise sum(count * (boundary - length)); ``lengths`` ascending."""
    d = len(lengths)
    if d == 0:
        return []
    buckets = min(buckets, d)
    n = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    s = np.concatenate([[0], np.cumsum(counts * lengths, dtype=np.float64)])
    # best[j]: least padding of the first j lengths with the buckets so far
    best = lengths[np.arange(d)] * n[1:] - s[1:]
    best = np.concatenate([[0.0], best])
    back = [np.zeros(d + 1, dtype=np.int64)]
    for _ in range(1, buckets):
        new, cut_at = best.copy(), np.arange(d + 1)
        for j in range(1, d + 1):
            cost = best[:j] + lengths[j - 1] * (n[j] - n[:j]) - (s[j] - s[:j])
            i = int(np.argmin(cost))
            new[j], cut_at[j] = cost[i], i
        back.append(cut_at)
        best = new
    ends, j = [], d
    for cut_at in reversed(back):
        if j == 0:
            break
        ends.append(int(lengths[j - 1]))
        j = int(cut_at[j])
    return sorted(set(ends))


def bucket_plan(histogram: dict[int, int], capacity: int, buckets: int = BUCKETS) -> list[Run]:
    """Optimal length buckets; inside each, batches of real lengths within the token budget.

    Lengths of a bucket are taken in falling order; a container closes when the next one would
    exceed the capacity.
    """
    lengths = np.array(sorted(k for k in histogram if k > 0), dtype=np.int64)
    counts = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)
    runs: list[Run] = []
    container = 0
    low = 0
    for b, end in enumerate(optimal_buckets(lengths, counts, buckets)):
        space = 0  # of the container that is open; container - 1 is its number
        for length in reversed([int(x) for x in lengths if low < x <= end]):
            left, rank = histogram[length], 0
            fit = min(left, space // length)
            if fit:
                runs.append(Run(length, rank, fit, container - 1, fit, b))
                left, rank, space = left - fit, rank + fit, space - fit * length
            if left:
                per = capacity // length
                opened = -(-left // per)
                runs.append(Run(length, rank, left, container, per, b))
                container += opened
                space = capacity - length * (left - (opened - 1) * per)
        low = end
    return runs


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Best fit, longest first, on the histogram: equal containers are filled as one group."""
    runs: list[Run] = []
    groups: dict[int, list[tuple[int, int]]] = {}  # space -> [(first container, containers)]
    spaces: list[int] = []
    container = 0

    def put(space: int, first: int, n: int) -> None:
        if space <= 0 or n <= 0:
            return
        if space not in groups:
            groups[space] = []
            bisect.insort(spaces, space)
        groups[space].append((first, n))

    for length in sorted((k for k in histogram if k > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            i = bisect.bisect_left(spaces, length)
            if i == len(spaces):
                break
            space = spaces[i]
            first, n = groups[space].pop()
            if not groups[space]:
                del groups[space], spaces[i]
            per = space // length
            if left >= per:
                used = min(n, left // per)
                runs.append(Run(length, rank, used * per, first, per))
                rank, left = rank + used * per, left - used * per
                put(space - per * length, first, used)
                put(space, first + used, n - used)
            else:
                runs.append(Run(length, rank, left, first, left))
                put(space - left * length, first, 1)
                put(space, first + 1, n - 1)
                left = 0
        if left:
            per = capacity // length
            full, rest = divmod(left, per)
            if full:
                runs.append(Run(length, rank, full * per, container, per))
                put(capacity - per * length, container, full)
                container, rank = container + full, rank + full * per
            if rest:
                runs.append(Run(length, rank, rest, container, rest))
                put(capacity - rest * length, container, 1)
                container += 1
    return runs


def _ranked(items: DataFrame) -> DataFrame:
    """``items`` with ``rank``, 0-based within container kind and length.

    A length may hold a third of all items, so ranks are made in two levels: within hash salts,
    then by a running sum over the salts' counts.
    """
    salts = max(64, parallelism(items.sparkSession))
    keys = ["container_kind", "n_tokens"]
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    before = W.partitionBy(*keys).orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    base = salted.groupBy(*keys, "salt").agg(F.count(F.lit(1)).alias("c")).select(*keys, "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    inner = W.partitionBy(*keys, "salt").orderBy("doc_id", "piece")
    return salted.withColumn("rn", F.row_number().over(inner)).join(base, [*keys, "salt"]).withColumn("rank", F.col("base") + F.col("rn") - 1).drop("salt", "rn", "base")


def pack(counts: DataFrame, containers: DataFrame, plan=best_fit_plan) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, start_token, n_tokens) by the given plan.

    Every text is in exactly one container per kind, whole unless it exceeds the capacity; texts
    without tokens go to container 0 with 0 tokens. Containers of no or negative capacity take
    nothing. Deterministic for the same rows.
    """
    counts = cut(counts)
    items = pieces(counts, containers)
    caps = capacities(containers)
    # At most the sum of the capacities in rows, whatever the corpus.
    hist: dict[str, dict[int, int]] = {k: {} for k in caps}
    for kind, length, n in items.groupBy("container_kind", "n_tokens").count().collect():
        hist[kind][int(length)] = int(n)
    tables = {}
    for kind, cap in caps.items():
        runs = sorted(plan(hist[kind], cap), key=lambda r: (r.length, r.rank))
        tables[kind] = tuple(np.array([getattr(r, f) for r in runs], dtype=np.int64) for f in ("length", "rank", "first", "per", "bucket"))
    stride = 1 << 40
    schema = "container_kind string, container_id bigint, bucket int, doc_id bigint, piece int, start_token bigint, n_tokens int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = {k: t[0] * stride + t[1] for k, t in tables.items()}
        for batch in batches:
            kinds = np.array(batch.column("container_kind").to_pylist(), dtype=object)
            length = batch.column("n_tokens").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            container, bucket = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int32)
            for kind, (_, first_rank, first, per, buckets) in tables.items():
                mine = np.flatnonzero((kinds == kind) & (length > 0))
                if len(mine):
                    i = np.searchsorted(starts[kind], length[mine] * stride + rank[mine], "right") - 1
                    container[mine] = first[i] + (rank[mine] - first_rank[i]) // per[i]
                    bucket[mine] = buckets[i]
            yield pa.RecordBatch.from_arrays(
                [batch.column("container_kind"), pa.array(container), pa.array(bucket), *(batch.column(c) for c in ("doc_id", "piece", "start_token", "n_tokens"))],
                names=["container_kind", "container_id", "bucket", "doc_id", "piece", "start_token", "n_tokens"],
            )

    return _ranked(items).select("container_kind", "doc_id", "piece", "start_token", "n_tokens", "rank").mapInArrow(run, schema)


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container_kind, containers, tokens, fill): how much of the space is used."""
    used = packed.groupBy("container_kind").agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    caps = containers.where("capacity_tokens > 0").groupBy("container_kind").agg(F.min("capacity_tokens").alias("capacity_tokens"))
    return used.join(caps, "container_kind").select(
        "container_kind", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill")
    )
