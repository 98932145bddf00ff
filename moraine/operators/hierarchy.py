"""Parent-child links to full hierarchies by tree contraction.

Rounds shrink the forest: *raking* removes leaves, *compression* splices nodes with one child out
of chains. Every removal is recorded as (node, surviving ancestor, distance). Reversing the record
gives each node its root and depth. What no round can remove has an ancestry that never ends.

One round works on ranges of nodes in parallel: a task removes what it can judge alone - nodes all
of whose children lie in its range - so rounds need no coordination, and neighbours in the chosen
order (a history's sequence numbers, say) vanish together. As the
forest shrinks the ranges widen, so what was a border in one round is inside in the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..core.errors import LakeError
from ..core.session import cut, parallelism

#: Nodes in one range, about. A forest of at most this many nodes is finished in one task.
RANGE_NODES = 200_000
#: Steps from one anchor of a path to the next, see ``paths``.
STRIDE = 16
#: Rows of written-out paths that one task makes, about.
TASK_ROWS = 1_000_000


def contract(node: np.ndarray, parent: np.ndarray, weight: np.ndarray, children: np.ndarray, own: np.ndarray, extra: np.ndarray):
    """Rake and compress one range until nothing changes.

    ``parent`` is -1 for roots. ``children`` counts each node's children anywhere. ``own`` is the
    size of what was raked into a node, itself included; ``extra`` that of what was spliced out
    between it and its parent. Returns

    * the removed as (node, surviving ancestor, distance, size ref, size): the size of the subtree
      is ``size``, plus that of the surviving node ``size ref`` unless it is -1,
    * the survivors as (node, parent, weight, is root, own, extra),
    * sizes to add to nodes of other ranges, as (node, size).

    An ancestor outside the range always survives: only nodes without children elsewhere go.
    """
    n = len(node)
    order = np.argsort(node, kind="stable")
    pos = np.searchsorted(node[order], parent)
    pos_c = np.minimum(pos, max(n - 1, 0))
    local = np.where((parent != -1) & (n > 0) & (node[order][pos_c] == parent), order[pos_c], -1)
    left = children.astype(np.int64).copy()
    inside = np.bincount(local[local >= 0], minlength=n)
    outside = left - inside  # children elsewhere keep a node alive in this round
    up, dist = local.copy(), weight.astype(np.int64).copy()
    beyond = np.where(local < 0, parent, -1)  # parent outside the range, or -1
    is_root = parent == -1
    gone = np.zeros(n, dtype=bool)
    own, extra = own.astype(np.int64).copy(), extra.astype(np.int64).copy()
    sent: list[tuple[np.ndarray, np.ndarray]] = []
    size_of, size_ref = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
    log: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        leaves = np.flatnonzero(~gone & ~is_root & (left == 0))
        if len(leaves):  # rake
            gone[leaves] = True
            log.append((leaves, up[leaves].copy(), beyond[leaves].copy(), dist[leaves].copy()))
            heads, amount = up[leaves], own[leaves] + extra[leaves]
            here = heads >= 0
            left -= np.bincount(heads[here], minlength=n)
            np.add.at(own, heads[here], amount[here])
            sent.append((beyond[leaves[~here]], amount[~here]))
            size_of[leaves] = own[leaves]
        # compress: nodes with exactly one child, which lies in this range
        live = np.flatnonzero(~gone)
        child_of = np.full(n, -1, dtype=np.int64)
        kids = live[up[live] >= 0]
        child_of[up[kids]] = kids  # right where there is one child
        unary = ~gone & ~is_root & (left == 1) & (outside == 0) & (child_of >= 0)
        # no two neighbours at once: of a pair of candidates the one with the smaller coin goes
        coin = (np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(len(log) * 0x632BE5AB)) >> np.uint64(33)
        cand = np.flatnonzero(unary)
        above = up[cand]
        blocked = np.zeros(n, dtype=bool)
        pair = (above >= 0) & unary[np.maximum(above, 0)]
        low, high = cand[pair], above[pair]
        smaller = (coin[low] < coin[high]) | ((coin[low] == coin[high]) & (low < high))
        blocked[np.where(smaller, high, low)] = True
        go = cand[~blocked[cand] & (up[cand] != cand) & (child_of[cand] != cand)]
        if not len(go):
            if len(leaves):
                continue
            break
        gone[go] = True
        log.append((go, up[go].copy(), beyond[go].copy(), dist[go].copy()))
        heirs = child_of[go]
        size_of[go], size_ref[go] = own[go] + extra[heirs], heirs
        extra[heirs] += own[go] + extra[go]
        up[heirs], beyond[heirs] = up[go], beyond[go]
        dist[heirs] = dist[heirs] + dist[go]
    # Reverse the record: distances to ancestors that survive this round.
    ref, far = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=np.int64)
    target = np.full(n, -1, dtype=node.dtype)
    keep = ~gone
    target[keep] = node[keep]
    for who, head, out, step in reversed(log):
        has = head >= 0
        target[who] = np.where(has, target[np.maximum(head, 0)], out)
        far[who] = step + np.where(has, far[np.maximum(head, 0)], 0)
        # A spliced node's size refers to its heir, which may have gone later.
        heir = size_ref[who]
        gone_heir = (heir >= 0) & gone[np.maximum(heir, 0)]
        w, g = who[gone_heir], heir[gone_heir]
        size_of[w] += size_of[g]
        size_ref[w] = size_ref[g]
    # A survivor's parent may have been spliced out above it: up/beyond already skip it.
    final_parent = np.where(is_root, -1, np.where(up >= 0, node[np.maximum(up, 0)], beyond))
    gone_i, keep_i = np.flatnonzero(gone), np.flatnonzero(keep)
    refs = np.where(size_ref >= 0, node[np.maximum(size_ref, 0)], -1) if n else size_ref
    to = np.concatenate([a for a, _ in sent]) if sent else np.empty(0, np.int64)
    amounts = np.concatenate([b for _, b in sent]) if sent else np.empty(0, np.int64)
    return (
        (node[gone_i], target[gone_i], far[gone_i], refs[gone_i], size_of[gone_i]),
        (node[keep_i], final_parent[keep_i], dist[keep_i], is_root[keep_i], own[keep_i], extra[keep_i]),
        (to, amounts),
    )


def _round(core: DataFrame, ranges: int) -> DataFrame:
    """One round over ranges: rows (node, ref, far, place, own, extra, kind).

    Kind 0 is a removed node (own: its size, extra: the node whose size comes on top, or -1), 1 a
    survivor, 2 a surviving root, 3 a size to add to ``node``.
    """
    kids = core.where("parent <> -1").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"))
    counted = core.join(kids, "node", "left").withColumn("children", F.coalesce("children", F.lit(0).cast("bigint")))
    columns = ("node", "parent", "weight", "place", "own", "extra", "children")
    placed = counted.select(*columns).repartitionByRange(ranges, "place", "node")
    schema = "node bigint, ref bigint, far bigint, place bigint, own bigint, extra bigint, kind int"

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        node, parent, weight, place, own, extra, children = (t.column(c).to_numpy() for c in columns)
        (rn, rt, rf, rr, rs), (sn, sp, sd, root, so, se), (mn, ms) = contract(node, parent, weight, children, own, extra)
        order = np.argsort(node)
        at = place[order][np.searchsorted(node[order], np.concatenate([rn, sn]))]
        zero = np.zeros(len(mn), np.int64)
        out = pa.table({
            "node": np.concatenate([rn, sn, mn]), "ref": np.concatenate([rt, sp, zero]), "far": np.concatenate([rf, sd, zero]),
            "place": np.concatenate([at, zero]), "own": np.concatenate([rs, so, ms]), "extra": np.concatenate([rr, se, zero]),
            "kind": np.concatenate([np.zeros(len(rn)), np.where(root, 2, 1), np.full(len(mn), 3)]).astype(np.int32),
        })
        yield from out.to_batches()

    return placed.mapInArrow(shrink, schema)


def _with_sizes(core: DataFrame, sizes: DataFrame) -> DataFrame:
    """Survivors with the sizes added that were raked into them from other ranges."""
    more = sizes.groupBy("node").agg(F.sum("size").alias("more"))
    return core.join(more, "node", "left").withColumn("own", F.col("own") + F.coalesce("more", F.lit(0))).drop("more")


def _solved(core: DataFrame) -> DataFrame:
    """What is left when nothing can be removed: roots, and nodes of cycles."""
    root = F.col("parent") == -1
    return core.select(
        "node", F.when(root, F.col("node")).otherwise(-1).alias("root"), F.when(root, 0).otherwise(-1).cast("bigint").alias("depth"),
        F.when(root, F.col("own")).otherwise(-1).alias("size"),
    )


def roots_and_depths(links: DataFrame, range_nodes: int = RANGE_NODES, max_rounds: int = 64) -> DataFrame:
    """(node, root, depth, size) of every node of a forest given as (node, parent, place), all bigint.

    ``node`` is unique and not -1, ``parent`` is a node, or -1 for roots; ``place`` is any
    number under which relatives tend to be near; ``size`` counts a node and all its descendants.
    With a column ``weight``, the length of the link to the parent, ``depth`` is the sum of lengths. Nodes
    on or below a cycle get root, depth and size -1. The cost follows the nodes, not their depth: a
    chain of a million takes as many rounds as a star.
    """
    weight = F.col("weight") if "weight" in links.columns else F.lit(1)
    one = lambda n: F.lit(n).cast("bigint")
    core = cut(links.select("node", "parent", weight.cast("bigint").alias("weight"), "place", one(1).alias("own"), one(0).alias("extra")))
    records: list[DataFrame] = []
    size = core.count()
    solved: DataFrame | None = None
    stuck = 0
    for _ in range(max_rounds):
        ranges = max(1, -(-size // range_nodes))
        step = cut(_round(core, ranges))
        records.append(step.where("kind = 0").select("node", "ref", "far", F.col("extra").alias("size_ref"), F.col("own").alias("size")))
        core = step.where("kind in (1, 2)").select("node", F.col("ref").alias("parent"), F.col("far").alias("weight"), "place", "own", "extra")
        if ranges > 1:
            core = cut(_with_sizes(core, step.where("kind = 3").select("node", F.col("own").alias("size"))))
        if ranges == 1 or core.where("parent <> -1").isEmpty():
            solved = _solved(core)  # whatever still has a parent sits on a cycle
            break
        now = core.count()
        stuck = stuck + 1 if now > 0.9 * size else 0
        size = now
        if stuck >= 4:
            break
    if solved is None:
        solved = _finish_by_splicing(core, records, max_rounds)
    return _reversed(solved, records)


def _reversed(solved: DataFrame, records: list[DataFrame]) -> DataFrame:
    """Carry roots, depths and sizes from the survivors back through the rounds."""
    for gone in reversed(records):
        above = solved.select(F.col("node").alias("ref"), "root", "depth")
        heir = solved.select(F.col("node").alias("size_ref"), F.col("size").alias("heir_size"))
        lost = F.col("root") == -1
        back = gone.join(above, "ref").join(heir, "size_ref", "left").select(
            "node", "root", F.when(lost, -1).otherwise(F.col("depth") + F.col("far")).cast("bigint").alias("depth"),
            F.when(lost, -1).otherwise(F.col("size") + F.coalesce("heir_size", F.lit(0))).cast("bigint").alias("size"),
        )
        solved = cut(solved.unionByName(back))  # as many nodes as were left in that round
    return solved


def _finish_by_splicing(core: DataFrame, records: list[DataFrame], max_rounds: int) -> DataFrame:
    """Rounds of joins for forests in which no ordering brings relatives together.

    Of the nodes whose parent's coin shows tails, leaves are raked, and chain nodes with heads are
    spliced out; a quarter of every chain goes per round, wherever its nodes are stored.
    """
    for turn in range(8 * max_rounds):
        coin = lambda c: F.pmod(F.xxhash64(F.col(c), F.lit(turn)), F.lit(2))
        kids = core.where("parent <> -1").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("child"))
        known = core.join(kids, "node", "left")
        # A parent under tails stays in this round, so nothing is removed together with its parent.
        go = (F.col("parent") != -1) & (coin("parent") == 0) & (F.col("n").isNull() | ((F.col("n") == 1) & (coin("node") == 1)))
        known = cut(known.withColumn("go", F.coalesce(go, F.lit(False))))
        gone = known.where("go")
        if gone.isEmpty():
            if known.where("parent <> -1 and parent <> node and coalesce(n, 0) <= 1").isEmpty():
                break
            continue
        leaves, spliced = gone.where("n is null"), gone.where("n is not null")
        heirs = spliced.select(
            F.col("child").alias("node"), F.col("parent").alias("p2"), F.col("weight").alias("w2"), (F.col("own") + F.col("extra")).alias("e2"),
            F.col("node").alias("v"), F.col("own").alias("v_own"), F.col("weight").alias("v_weight"), F.col("parent").alias("v_parent"),
        )
        joined = cut(known.where("not go").join(heirs, "node", "left"))
        raked = leaves.select("node", F.col("parent").alias("ref"), F.col("weight").alias("far"), F.lit(-1).cast("bigint").alias("size_ref"), F.col("own").alias("size"))
        cuts = joined.where("v is not null").select(
            F.col("v").alias("node"), F.col("v_parent").alias("ref"), F.col("v_weight").alias("far"), F.col("node").alias("size_ref"), (F.col("v_own") + F.col("extra")).alias("size")
        )
        # An heir that goes as a leaf in the same round cannot be: its parent, spliced, showed heads.
        records.append(cut(raked.unionByName(cuts)))
        zero = F.lit(0).cast("bigint")
        core = joined.select(
            "node", F.coalesce("p2", "parent").alias("parent"), (F.col("weight") + F.coalesce("w2", zero)).alias("weight"), "place",
            "own", (F.col("extra") + F.coalesce("e2", zero)).alias("extra"),
        )
        core = cut(_with_sizes(core, leaves.select(F.col("parent").alias("node"), (F.col("own") + F.col("extra")).alias("size"))))
    else:
        raise LakeError("the contraction did not end")
    return _solved(core)


def identify(rows: DataFrame, tree: str, node: str, parent: str, place: str) -> DataFrame:
    """(tree, node_id, node, parent, place): links under dense ids that are unique over all trees.

    Repeated rows count once (of differing parents the greatest holds). Rows without a node give
    none; a null parent, and one that is not among its tree's nodes, makes a root. The result is
    written, so the ids stay what they are when executors are lost.
    """
    low = F.lit((1 << 31) - 1)
    nodes = cut(
        rows.where(F.col(node).isNotNull())
        .groupBy(F.col(tree).alias("tree"), F.col(node).alias("node_id"))
        .agg(F.max(parent).alias("parent_id"), F.max(place).alias("p"))
        .select(
            "tree", "node_id", "parent_id", F.monotonically_increasing_id().alias("node"),
            (F.shiftleft(F.xxhash64("tree").bitwiseAND(low), 32) + F.coalesce(F.col("p"), F.lit(0)).bitwiseAND(low)).alias("place"),
        )
    )
    above = nodes.select(F.col("tree").alias("t"), F.col("node_id").alias("pid"), F.col("node").alias("parent"))
    return nodes.join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent_id") == F.col("pid")), "left").select(
        "tree", "node_id", "node", F.coalesce("parent", F.lit(-1).cast("bigint")).alias("parent"), "place"
    )


def lineage(rows: DataFrame, tree: str, node: str, parent: str, place: str, range_nodes: int = RANGE_NODES) -> DataFrame:
    """(tree, node_id, root_id, depth, descendants) of every node; all -1 on or below a cycle."""
    links = cut(identify(rows, tree, node, parent, place))
    return _named(roots_and_depths(links, range_nodes), links).select("tree", "node_id", "root_id", "depth", "descendants")


def _named(solved: DataFrame, links: DataFrame) -> DataFrame:
    names = links.select("tree", "node_id", "node")
    roots = links.where("parent = -1").select(F.col("node").alias("root"), F.col("node_id").alias("root_id"))
    below = F.when(F.col("size") == -1, -1).otherwise(F.col("size") - 1).cast("bigint")
    return (
        solved.join(names, "node")
        .join(roots, "root", "left")
        .withColumn("root_id", F.coalesce("root_id", F.lit(-1).cast("bigint")))
        .withColumn("descendants", below)
    )


def spans(rows: DataFrame, tree: str, node: str, parent: str, place: str, range_nodes: int = RANGE_NODES) -> DataFrame:
    """(tree, node_id, root_id, depth, first, last): every path and all descendants, in linear space.

    Nodes of one root are numbered so that a subtree is an interval: the descendants of a node are
    the nodes of its root with ``first`` in [first, last] of the node, its path from the root is
    the nodes whose interval holds its ``first``, by depth. Written out, the paths of one chain
    of n nodes would take n * n / 2 entries. Nulls on or below a cycle.

    A second contraction gives the numbers: with links as long as 1 + the sizes of the siblings before,
    a node's number is its distance from the root. The sums over siblings are made in two levels, so
    that a node with any number of children is not one task.
    """
    links = cut(identify(rows, tree, node, parent, place))
    solved = cut(roots_and_depths(links, range_nodes))
    sized = links.join(solved.where("root <> -1").select("node", "size"), "node")
    block = F.call_function("div", F.col("node"), F.lit(4096).cast("bigint"))
    kids = sized.where("parent <> -1").select("node", "parent", "size", block.alias("block"))
    up_to = W.partitionBy("parent").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = kids.groupBy("parent", "block").agg(F.sum("size").alias("s")).withColumn("base", F.coalesce(F.sum("s").over(up_to), F.lit(0))).drop("s")
    inner = W.partitionBy("parent", "block").orderBy("node").rowsBetween(W.unboundedPreceding, -1)
    lengths = (
        kids.withColumn("here", F.coalesce(F.sum("size").over(inner), F.lit(0)))
        .join(before, ["parent", "block"])
        .select("node", (1 + F.col("base") + F.col("here")).alias("weight"))
    )
    weighted = sized.join(lengths, "node", "left").select("node", "parent", "place", F.coalesce("weight", F.lit(1)).alias("weight"))
    first = roots_and_depths(cut(weighted), range_nodes).select("node", F.col("depth").alias("first"))
    named = _named(solved, links).join(first, "node", "left")
    return named.select("tree", "node_id", "root_id", "depth", "first", (F.col("first") + F.col("size") - 1).alias("last"))


def histories(rows: DataFrame, tree: str, node: str, parent: str, place: str, wanted: DataFrame) -> DataFrame:
    """(tree, node_id, ancestor_id, distance): the full path of each wanted (tree, node_id), itself included.

    A wanted node whose ancestry never ends gives no row.
    """
    links = cut(identify(rows, tree, node, parent, place))
    good = roots_and_depths(links).where("root <> -1").select("node")
    keys = links.join(wanted.select("tree", "node_id").distinct(), ["tree", "node_id"], "left_semi").join(good, "node", "left_semi")
    found = ancestry(links, keys)
    name = lambda a, b: links.select(F.col("node").alias(a), "tree", F.col("node_id").alias(b))
    return found.join(name("node", "node_id"), "node").join(name("ancestor", "ancestor_id").drop("tree"), "ancestor").select("tree", "node_id", "ancestor_id", "distance")


def paths(rows: DataFrame, tree: str, node: str, parent: str, place: str, stride: int = STRIDE, task_rows: int = TASK_ROWS) -> DataFrame:
    """(tree, node_id, ancestor_id, distance): the full path of every node, itself included.

    Read by ancestor, these are all descendants. A node whose ancestry never ends gives one row, its
    ancestor and distance -1.

    Nodes whose depth is a multiple of ``stride`` are anchors. All nodes look up their ancestors as far as the
    first anchor, and only anchors look up all of theirs, so what is moved is about 1 / ``stride`` of the
    answer, and ``stride`` rows a node. The last join makes the answer and is not moved; it is cut by the
    rows it will make, so neither a long path nor an anchor of very many nodes is one task.
    """
    links = cut(identify(rows, tree, node, parent, place))
    placed = cut(links.join(roots_and_depths(links).select("node", "root", "depth"), "node"))
    good = placed.where("root <> -1")
    off = F.col("depth") % stride
    near = ancestry(good.withColumn("parent", F.when(off == 0, -1).otherwise(F.col("parent"))), good)
    far = ancestry(good, good.where(off == 0))
    name = good.select(F.col("node").alias("ancestor"), F.col("node_id").alias("ancestor_id"))
    local = near.join(good.select("node", "tree", "node_id", off.alias("off")), "node")
    below = local.where("distance < off").join(name, "ancestor").select("tree", "node_id", "ancestor_id", "distance")
    starts = cut(local.where("distance = off").select(F.col("ancestor").alias("anchor"), "node", "tree", "node_id", "off"))

    length = good.select(F.col("node").alias("anchor"), (F.col("depth") + 1).alias("length"))
    loads = starts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).join(length, "anchor").select("anchor", (F.col("n") * F.col("length")).alias("made"))
    loads = cut(loads.withColumn("pieces", F.ceil(F.col("made") / task_rows)))
    made = loads.agg(F.sum("made")).first()[0] or 0  # one number
    tasks = max(parallelism(rows.sparkSession), min(-(-made // task_rows), 20_000))
    lower = starts.join(loads, "anchor").withColumn("piece", F.pmod(F.xxhash64("node"), "pieces")).drop("pieces", "made", "node")
    upper = (
        far.join(name, "ancestor")
        .select(F.col("node").alias("anchor"), "ancestor_id", F.col("distance").alias("beyond"))
        .join(loads, "anchor")
        .select("anchor", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece"), "ancestor_id", "beyond")
    )
    key = ["anchor", "piece"]
    above = lower.repartition(tasks, *key).join(upper.repartition(tasks, *key), key).select("tree", "node_id", "ancestor_id", (F.col("off") + F.col("beyond")).alias("distance"))
    never = F.lit(-1).cast("bigint")
    endless = placed.where("root = -1").select("tree", "node_id", never.alias("ancestor_id"), never.alias("distance"))
    return below.unionByName(above).unionByName(endless)


def ancestry(links: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, ancestor, distance) for each wanted node, itself at distance 0, up to its root.

    Only for nodes whose ancestry ends. Doubling: jump tables of 1, 2, 4, ... steps, so the number
    of joins is the logarithm of the greatest depth; the rows are those of the answer.
    """
    jump = links.where("parent <> -1").select("node", F.col("parent").alias("far"))
    reach = cut(wanted.select("node", F.col("node").alias("ancestor"), F.lit(0).cast("bigint").alias("distance")))
    step = 1
    while True:
        longer = reach.join(jump.select(F.col("node").alias("ancestor"), "far"), "ancestor").select(
            "node", F.col("far").alias("ancestor"), (F.col("distance") + step).alias("distance")
        )
        longer = cut(longer)
        if longer.isEmpty():
            return reach
        reach = cut(reach.unionByName(longer))
        jump = cut(jump.alias("a").join(jump.alias("b"), F.col("a.far") == F.col("b.node")).select("a.node", "b.far"))
        step *= 2
