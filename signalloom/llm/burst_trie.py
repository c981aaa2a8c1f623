"""A prefix trie of conversations, built as a burst trie.

Conversations are suffixes in containers under the heads of a trie; at first one container under
the root holds all.  A container that is too large bursts: the turns that its members share
become trie nodes, and at the first turn where they part every next turn id gets a container of
its own.  What is small enough is sorted within its shard and swept into nodes.  Totals of
subtrees then flow from the containers back up the heads.

Equal conversations are one member with a count.  Tables of turns are joined by conversation and
slice of turns, so that no task has to hold a long one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import placed
from ..session import remove_folder, stage_folder, staged

#: Turns of one conversation that may meet in one task.
SLICE = 1 << 16
#: Oversized containers up to which a join broadcasts them (about 60 bytes each).
BROADCAST_HEADS = 50_000

_NOTHING = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NODE_COLUMNS = [c.split()[0] for c in _NODE.split(", ")]


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, step (from 1), a, b (the turn's id) and chars (code points) per turn.

    By turn, null first; turns of equal number in the order of their ids.  Null role or text is
    empty.  Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"),
        F.length(text).cast("long").alias("chars"),
    )
    ordered = placed(staged(turns), "conv_id", ["turn", "a", "b"])
    return staged(ordered.select("conv_id", (F.col("place") + 1).alias("step"), "a", "b", "chars"))


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"))


def _slice() -> Column:
    return F.expr(f"step div {SLICE}").alias("slice")


def _per_turn(turns: DataFrame, convs: DataFrame, n_turns: str = "n_turns") -> DataFrame:
    """Turns with the columns of their conversation, which stands once for each of its slices."""
    slices = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"{n_turns} div {SLICE}"))).alias("slice")
    return turns.select("*", _slice()).join(convs.select("*", slices), ["conv_id", "slice"]).drop("slice")


def rebuilt(turns: DataFrame, hundred: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their ``hundred``: (turns, lengths).

    Conversation c takes the first h turns of c - c % hundred (all if fewer, none if there is no
    such conversation), with h the crc32 of c modulo ``most + 1``, and then its own after its
    first h.  It may end up without turns; its length says so.
    """
    turn = F.struct("step", "a", "b", "chars")
    first = turns.where((F.col("conv_id") % hundred == 0) & (F.col("step") <= most))
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(turn)).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % hundred
    plan = lengths(turns).withColumn("h", h).withColumn("base", base).join(heads, "base", "left")
    taken = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<struct<step:long,a:long,b:long,chars:long>>"))
    plan = staged(plan.select("conv_id", "n_turns", "h", taken.alias("taken")))
    given = plan.select("conv_id", F.inline("taken"))
    own = _per_turn(turns, plan.select("conv_id", "n_turns", "h", F.size("taken").alias("n_taken"))).where("step > h")
    shifted = own.select("conv_id", (F.col("step") - F.col("h") + F.col("n_taken")).alias("step"), "a", "b", "chars")
    n = F.size("taken") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))
    return staged(given.unionByName(shifted)), plan.select("conv_id", n.cast("long").alias("n_turns"))


def _classes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct conversation: conv_id (the least), n_turns, times, ends (their digest).

    The ids of equal conversations are listed by ranges of 4,096 and stream through one digest.
    """
    prints = turns.groupBy("conv_id").agg(
        *[F.bit_xor(F.xxhash64(F.lit(seed), "step", "a", "b")).alias(name) for seed, name in ((3, "x"), (4, "y"))]
    )
    marked = convs.join(prints, "conv_id", "left").fillna(0, ["x", "y"])
    ids = F.array_sort(F.collect_list("conv_id"))
    ranges = marked.groupBy("n_turns", "x", "y", F.shiftright("conv_id", 12).alias("range")).agg(
        F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids"), F.min("conv_id").alias("least"), F.count("*").alias("n")
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found, open_ = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["n_turns"], row["x"], row["y"]) != key:
                    if open_:
                        found.append((*open_[:3], open_[3].hexdigest()))
                    key, open_ = (row["n_turns"], row["x"], row["y"]), [row["least"], row["n_turns"], 0, hashlib.sha256()]
                    open_[3].update(row["ids"].encode())
                else:
                    open_[3].update(b"," + row["ids"].encode())
                open_[2] += row["n"]
            yield table(found)
            found = []
        if open_:
            yield table([(*open_[:3], open_[3].hexdigest())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["conv_id", "n_turns", "times", "ends"])

    key = ("n_turns", "x", "y")
    by_class = ranges.repartition(*key).sortWithinPartitions(*key, "range")
    return staged(by_class.mapInArrow(digests, "conv_id long, n_turns long, times long, ends string"))


def _suffix_sums(rows: DataFrame, key: list[str], value: str, name: str) -> DataFrame:
    """The sum of ``value`` from each step of a key to its last."""
    cut = rows.withColumn("slice", _slice())
    later = Window.partitionBy(*key).orderBy(F.desc("slice"))
    totals = cut.groupBy(*key, "slice").agg(F.sum(value).alias("s"))
    totals = totals.select(*key, "slice", (F.sum("s").over(later) - F.col("s")).alias("after"))
    within = Window.partitionBy(*key, "slice").orderBy(F.desc("step"))
    summed = cut.withColumn("here", F.sum(value).over(within)).join(totals, [*key, "slice"])
    return summed.withColumn(name, F.col("here") + F.col("after")).drop("here", "after", "slice")


class _Node:
    __slots__ = ("depth", "above", "conv", "convs", "children", "leaves", "saved", "chars", "ends")

    def __init__(self, depth: int, above: _Node | None, conv: int, chars: int):
        self.depth, self.above, self.conv, self.chars = depth, above, conv, chars
        self.convs = self.children = self.leaves = self.saved = 0
        self.ends = _NOTHING


def _swept(members: list[tuple[list, int, int, list, str]], depth: int) -> list[_Node]:
    """The nodes of one container from its members (ids, conv_id, times, chars, ends); the head is last."""
    members.sort(key=lambda m: m[0])
    stack: list[_Node] = []
    closed: list[_Node] = []

    def close() -> None:
        node = stack.pop()
        node.leaves = node.leaves or 1
        node.saved += (node.convs - 1) * node.chars
        if stack:
            up = stack[-1]
            up.conv = min(up.conv, node.conv)
            up.convs += node.convs
            up.children += 1
            up.leaves += node.leaves
            up.saved += node.saved
        closed.append(node)

    before: list = []
    for ids, conv, times, chars, ends in members:
        shared = next((i for i, (p, q) in enumerate(zip(before, ids)) if p != q), min(len(before), len(ids)))
        while len(stack) > shared:
            close()
        for i in range(shared, len(ids)):
            stack.append(_Node(depth + i, stack[-1] if stack else None, conv, chars[i]))
        stack[-1].convs += times
        stack[-1].ends = ends
        before = ids
    while stack:
        close()
    return closed


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of containers whose rows stand together, a member's turns in a row."""

    def nodes(rows: list[dict]) -> pa.RecordBatch:
        members: list[tuple] = []
        last = None
        for r in rows:
            if r["conv_id"] != last:
                last = r["conv_id"]
                members.append(([], last, r["times"], [], None))
            members[-1][0].append((r["a"], r["b"]))
            members[-1][3].append(r["chars"])
            members[-1] = (*members[-1][:4], r["ends"])
        found = _swept(members, rows[0]["step"])
        key, outer = (rows[0]["c1"], rows[0]["c2"]), rows[0]["parent"]
        made = [
            (n.conv, n.depth, n.above.conv if n.above else outer, n.convs, n.children, n.leaves, n.saved, n.ends, *(key if n is found[-1] else (None, None)))
            for n in found
        ]
        kinds = [*[pa.int64()] * 7, pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*made), kinds)], names=[*NODE_COLUMNS, "c1", "c2"])

    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["c1"], row["c2"]) != key:
                if rows:
                    yield nodes(rows)
                key, rows = (row["c1"], row["c2"]), []
            rows.append(row)
    if rows:
        yield nodes(rows)


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None, capacity: int = 8192) -> DataFrame:
    """One row per node, with the columns of ``NODE_COLUMNS``.

    ``turns`` has conv_id, step, a, b and chars as :func:`numbered` gives them, ``convs`` conv_id
    and n_turns of all conversations, also those without turns.  A node of depth d is a distinct
    sequence of first d turns; the root has depth 0 and no parent.  ``conv_id`` is the least
    conversation that begins with it, so that (conv_id, depth) names a node and finds its turn in
    ``turns``.  ``saved_tokens`` and ``n_leaves`` are of the whole subtree.  No conversation: no
    node.  Containers of up to ``capacity`` turns are swept; a single conversation beyond that is
    a chain, which needs no sweep.  Turn ids are compared by 128 bits.
    """
    spark = turns.sparkSession
    made: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        made.append(stage_folder(spark))
        df.write.parquet(made[-1])
        return spark.read.schema(df.schema).parquet(made[-1])

    classes = _classes(turns, lengths(turns) if convs is None else convs)
    none = F.lit(0).cast("long")
    last = F.when(F.col("step") == F.col("n_turns"), F.col("ends")).alias("ends")
    roots = classes.select("conv_id", none.alias("step"), none.alias("a"), none.alias("b"), none.alias("chars"), F.when(F.col("n_turns") == 0, F.col("ends")).alias("ends"))
    steps = staged(_per_turn(turns, classes).select("conv_id", "step", "a", "b", "chars", last).unionByName(roots))

    unset = F.lit(None).cast("long")
    members = keep(
        classes.select("conv_id", "n_turns", "times", none.alias("depth"), unset.alias("parent"), none.alias("c1"), none.alias("c2"), unset.alias("p1"), unset.alias("p2"))
    )
    cid = ["c1", "c2"]
    rounds: list[tuple[DataFrame, DataFrame]] = []  # containers with their parents, spine nodes
    settled: list[DataFrame] = []  # members of containers that do not burst
    while True:
        containers = keep(
            members.groupBy(*cid, "p1", "p2").agg(
                F.sum(F.col("n_turns") - F.col("depth") + 1).alias("size"),
                F.count("*").alias("held"),
                F.sum("times").alias("convs"),
                F.min("conv_id").alias("least"),
            )
        )
        large = containers.where((F.col("size") > capacity) & (F.col("held") > 1)).drop("p1", "p2", "size")
        n_large = large.count()
        settled.append(members.join(large.select(*cid), cid, "left_anti") if n_large else members)
        if not n_large:
            rounds.append((containers, None))
            break
        bursting = keep(members.drop("p1", "p2").join(F.broadcast(large) if n_large <= BROADCAST_HEADS else large, cid))
        rows = _per_turn(steps, bursting).where("step >= depth")
        turn = F.struct("a", "b")
        lanes = keep(
            rows.groupBy(*cid, "step").agg(
                (F.min(turn) != F.max(turn)).alias("parted"),
                F.count("*").alias("n"),
                *[F.max(c).alias(c) for c in ("held", "convs", "least", "depth", "parent", "chars", "ends")],
            )
        )
        # the last step that all members share; distinct members part somewhere
        fork = lanes.where("parted OR n < held").groupBy(*cid).agg((F.min("step") - 1).alias("fork"))
        spine = lanes.join(fork, cid).where("step <= fork")
        rounds.append((containers, keep(_suffix_sums(spine, cid, "chars", "below"))))
        forked = bursting.join(F.broadcast(fork) if n_large <= BROADCAST_HEADS else fork, cid).where("n_turns > fork")
        at_fork = _per_turn(steps, forked).where("step = fork + 1")
        members = keep(
            at_fork.select(
                "conv_id", "n_turns", "times", F.col("step").alias("depth"), F.col("least").alias("parent"),
                F.xxhash64(F.lit(5), "c1", "c2", "a", "b").alias("n1"), F.xxhash64(F.lit(6), "c1", "c2", "a", "b").alias("n2"),
                F.col("c1").alias("p1"), F.col("c2").alias("p2"),
            ).withColumnsRenamed({"n1": "c1", "n2": "c2"})
        )

    waiting = settled[0]
    for more in settled[1:]:
        waiting = waiting.unionByName(more)
    waiting = waiting.drop("p1", "p2")
    alone = F.col("n_turns") - F.col("depth") + 1 > capacity  # no other member, or the container had burst
    small = _per_turn(steps, waiting.where(~alone)).where("step >= depth")
    small = small.select(*cid, "conv_id", "step", "a", "b", "chars", "ends", "times", "parent")
    swept = small.repartition(*cid).sortWithinPartitions(*cid, "conv_id", "step").mapInArrow(_sweep, f"{_NODE}, c1 long, c2 long")

    chains = _suffix_sums(_per_turn(steps, waiting.where(alone)).where("step >= depth"), ["conv_id"], "chars", "below")
    head = F.col("step") == F.col("depth")
    long = chains.select(
        "conv_id", F.col("step").alias("depth"), F.when(head, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.col("times").alias("n_convs"), (F.col("step") < F.col("n_turns")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("times") - 1) * F.col("below")).alias("saved_tokens"), F.coalesce("ends", F.lit(_NOTHING)).alias("ends_sha256"),
        *[F.when(head, F.col(c)).alias(c) for c in cid],
    )
    nodes = staged(swept.unionByName(long))
    totals = nodes.where("c1 IS NOT NULL").select(*cid, "n_leaves", "saved_tokens")
    spines = []
    for (containers, spine), (below, _) in reversed(list(zip(rounds, rounds[1:]))):
        children = below.join(totals, cid).groupBy(F.col("p1").alias("c1"), F.col("p2").alias("c2")).agg(
            F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("under"), F.count("*").alias("branches")
        )
        head = F.col("step") == F.col("depth")
        full = spine.join(children, cid)
        spined = staged(
            full.select(
                F.col("least").alias("conv_id"), F.col("step").alias("at"), F.when(head, F.col("parent")).otherwise(F.col("least")).alias("parent_conv_id"),
                F.col("convs").alias("n_convs"), F.when(F.col("step") == F.col("fork"), F.col("branches")).otherwise(F.lit(1)).cast("long").alias("n_children"),
                "n_leaves", (F.col("under") + (F.col("convs") - 1) * F.col("below")).alias("saved_tokens"),
                F.coalesce("ends", F.lit(_NOTHING)).alias("ends_sha256"), *[F.when(head, F.col(c)).alias(c) for c in cid],
            ).withColumnRenamed("at", "depth")
        )
        spines.append(spined)
        totals = totals.unionByName(spined.where("c1 IS NOT NULL").select(*cid, "n_leaves", "saved_tokens"))
    for path in made:
        remove_folder(spark, path)
    for spined in spines:
        nodes = nodes.unionByName(spined)
    return nodes.select(*NODE_COLUMNS)
