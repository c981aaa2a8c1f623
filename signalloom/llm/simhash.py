"""SimHash near-duplicates by a binary-trie self-join.

Fingerprints are the leaves of a binary trie.  Pairs of trie nodes are traversed together from
the root, the bits in which their paths differ are counted, and a pair is dropped as soon as
it has more than the error budget.  The upper trie is cut into nodes of bounded size and the
pairs of these are tasks; each task traverses its two subtries.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged
from .blocks import shielded
from .components import components

#: Fingerprints of one task's trie node; more once there are ``MAX_NODES`` of them.
NODE_PRINTS = 4096
MAX_NODES = 4096
#: Pairs of prints that two nodes may have to be compared directly, node pairs held at once, and
#: pairs of prints compared at once: what bounds a task's memory beside its prints.
_DIRECT, _HELD, _COMPARED = 1024, 1 << 15, 1 << 18
_STEP = 8
#: Prints of a node that travel as one value.
_PIECE = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    last = ends[min(shingle, len(ends)) - 1 :]
    counts, n, step = np.zeros(64, np.int64), len(last), 1 << 16
    for at in range(0, n, step):
        some = zip(starts[at : at + step], last[at : at + step])
        digests = np.fromiter((xxhash.xxh64_intdigest(joined[a : z - 1], seed) for a, z in some), np.uint64)
        counts += np.unpackbits(digests.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, shingle: int = 3, seed: int = 42, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the 64 bits of its word shingles as a (signed) long.

    A-Z are lower-cased, words end at ASCII blanks, repeats count; a bit is set if more than
    half of the shingles' XXH64 have it.  Fewer words than a shingle are one shingle; no
    words (null, empty or blank text) give zero.
    """

    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in batch), np.uint64, len(batch))
            yield pa.array(found.view(np.int64))

    return docs.withColumn(name, F.arrow_udf(prints, "long", F.ArrowUDFType.SCALAR_ITER)(F.col(text)))


# --- the trie ----------------------------------------------------------------------------


def trie_pairs(a: np.ndarray, b: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of all prints that differ in at most ``budget`` bits.

    Both ascend without repeats; given the same array twice, each pair comes once.  A node is
    a range of prints with a common path.  A level turns each pair of nodes into the pairs of
    their children, with one more differing bit where the children part; small pairs are
    compared print by print.
    """
    itself = a is b
    start = np.array([[0, len(a), 0, len(b), 0, 0]], np.int64)  # ranges, depth, differing bits
    stack = [start] if len(a) and len(b) else []
    while stack:
        nodes = stack.pop()
        if len(nodes) > _HELD:
            stack += np.array_split(nodes, -(-len(nodes) // _HELD))
            continue
        small = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2]) <= _DIRECT
        yield from _compare(a, b, nodes[small], budget, itself)
        nodes = nodes[~small]
        if not len(nodes):
            continue
        bit = (np.uint64(1) << (63 - nodes[:, 4]).astype(np.uint64)).astype(np.uint64)
        cut_a, cut_b = _middle(a, nodes[:, 0], nodes[:, 1], bit), _middle(b, nodes[:, 2], nodes[:, 3], bit)
        children = []
        for left, right in ((0, 0), (0, 1), (1, 0), (1, 1)):
            child = nodes.copy()
            child[:, 0 if left else 1] = cut_a
            child[:, 2 if right else 3] = cut_b
            child[:, 4] += 1
            child[:, 5] += left != right
            good = (child[:, 1] > child[:, 0]) & (child[:, 3] > child[:, 2]) & (child[:, 5] <= budget)
            if itself:
                good &= child[:, 0] <= child[:, 2]  # the mirror pair brings the same
            children.append(child[good])
        stack.append(np.concatenate(children))


def _middle(prints: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where the bit turns to one in each range."""
    base = prints[lo] & ~(bit | (bit - np.uint64(1)))
    return np.clip(np.searchsorted(prints, base | bit), lo, hi)


def _compare(a, b, nodes, budget, itself):
    sizes = (nodes[:, 1] - nodes[:, 0]) * (nodes[:, 3] - nodes[:, 2])
    ends = np.cumsum(sizes)
    at = 0
    while at < len(nodes):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _COMPARED, "right")))
        some, n = nodes[at:upto], sizes[at:upto]
        which = np.repeat(np.arange(len(some)), n)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        width = (some[:, 3] - some[:, 2])[which]
        i, j = some[which, 0] + inside // width, some[which, 2] + inside % width
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        if itself:
            near &= i < j
        if near.any():
            yield i[near], j[near]
        at = upto


def forest(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """For ``n`` nodes the least node that is reachable from each, by the pairs."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = label[i], label[j]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while True:
                short = label[label]
                if (short == label).all():
                    break
                label = short
    return label


def _leaves(prints: DataFrame, total: int) -> list[tuple[int, int]]:
    """Trie nodes ``(path, depth)`` that hold every print, each at most the wanted number if its
    prints differ in the bits that are left."""
    most = max(NODE_PRINTS, total // (MAX_NODES // 2))
    counts: dict[tuple[int, int], int] = {}
    heavy, depth = [(0, 0)], 0
    while heavy and depth < 64:
        # at most MAX_NODES / 2 nodes are heavy, so at most 2**_STEP times as many rows come back
        rows = prints if not depth else prints.where(F.shiftrightunsigned("print", 64 - depth).isin([_signed(p) for p, _ in heavy]))
        depth += _STEP
        found = rows.groupBy((F.shiftrightunsigned("print", 64 - depth) if depth < 64 else F.col("print")).alias("p")).count().collect()
        for r in found:
            counts[(r["p"] % (1 << 64), depth)] = r["count"]
        heavy = [(p % (1 << 64), depth) for p, c in ((r["p"], r["count"]) for r in found) if c > most]
    # the finest nodes that are not cut further, joined upwards while they stay small
    finest = {node: n for node, n in counts.items() if n <= most or node[1] == 64}
    totals: dict[tuple[int, int], int] = {}
    for (path, d), n in finest.items():
        for k in range(d + 1):
            node = (path >> (d - k), k)
            totals[node] = totals.get(node, 0) + n
    leaves = set()
    for path, d in finest:
        k = next((k for k in range(d + 1) if totals[(path >> (d - k), k)] <= most), d)
        leaves.add((path >> (d - k), k))
    return sorted(leaves, key=lambda node: node[0] << (64 - node[1]))


def _signed(p: int) -> int:
    return p - (1 << 64) if p >= 1 << 63 else p


def _node_pairs(leaves: list[tuple[int, int]], budget: int) -> list[tuple[int, int]]:
    """Pairs of leaves (places in the list) whose common paths differ in at most ``budget`` bits."""
    bounds = [p << (64 - d) for p, d in leaves]
    out = []

    def span(path: int, depth: int, lo: int, hi: int) -> int:
        return bisect_left(bounds, ((path << 1) | 1) << (63 - depth), lo, hi)

    stack = [(0, 0, len(leaves), 0, 0, len(leaves), 0, 0)]  # path, first, last leaf; twice; depth, differing bits
    while stack:
        pa_, la, ha, pb, lb, hb, depth, diff = stack.pop()
        if la >= ha or lb >= hb or diff > budget or lb < la:
            continue
        one_a, one_b = ha - la == 1 and leaves[la][1] <= depth, hb - lb == 1 and leaves[lb][1] <= depth
        if one_a or one_b:
            # below a leaf nothing is known of its side, so the other side's leaves are all paired
            out += [(i, j) for i in range(la, ha) for j in range(lb, hb) if i <= j and _differing(leaves[i], leaves[j]) <= budget]
            continue
        ma, mb = span(pa_, depth, la, ha), span(pb, depth, lb, hb)
        kids_a = ((2 * pa_, la, ma), (2 * pa_ + 1, ma, ha))
        kids_b = ((2 * pb, lb, mb), (2 * pb + 1, mb, hb))
        for x, ka in enumerate(kids_a):
            for y, kb in enumerate(kids_b):
                stack.append((*ka, *kb, depth + 1, diff + (x != y)))
    return sorted(set(out))


def _differing(u: tuple[int, int], v: tuple[int, int]) -> int:
    d = min(u[1], v[1])
    return ((u[0] >> (u[1] - d)) ^ (v[0] >> (v[1] - d))).bit_count()


def trie_links(prints: DataFrame, budget: int = 2) -> DataFrame:
    """``(u, v)``: links that connect what pairs within ``budget`` bits connect.

    ``prints`` holds distinct fingerprints in ``print``.  A print has at most 2,080 others
    within two bits, so work is bounded per print, and a task gives back a forest over its
    prints, not its pairs.
    """
    spark = prints.sparkSession
    total = prints.count()
    if not total:
        return spark.createDataFrame([], "u long, v long")
    leaves = _leaves(prints, total)
    pairs = _node_pairs(leaves, budget)
    bounds = np.array([p << (64 - d) for p, d in leaves], np.uint64)
    roles: list[list[int]] = [[] for _ in leaves]  # 2 * pair + side
    for n, (i, j) in enumerate(pairs):
        roles[i].append(2 * n)
        if j != i:
            roles[j].append(2 * n + 1)
    roles = spark.createDataFrame(
        [(leaf, role >> 1, role & 1) for leaf, own in enumerate(roles) for role in own], "leaf int, pair int, side int"
    )

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = batch.column(0).to_numpy()
            leaf = np.searchsorted(bounds, value.view(np.uint64), "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), batch.column(0)], names=["leaf", "print"])

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        value = np.sort(table.column("print").to_numpy().view(np.uint64))
        pieces = [value[i : i + _PIECE].tobytes() for i in range(0, len(value), _PIECE)]
        return pa.table({"leaf": pa.array([key[0].as_py()] * len(pieces), pa.int32()), "prints": pa.array(pieces, pa.binary())})

    def joined(table: pa.Table) -> pa.Table:
        sides: tuple[list, list] = ([], [])
        for side, prints in zip(table.column("side").to_pylist(), table.column("prints").to_pylist()):
            sides[side].append(np.frombuffer(prints, np.uint64))
        a = np.sort(np.concatenate(sides[0]))
        if sides[1]:
            b = np.sort(np.concatenate(sides[1]))
            label = forest(((i, j + len(a)) for i, j in trie_pairs(a, b, budget)), len(a) + len(b))
            a = np.concatenate([a, b])
        else:
            label = forest(trie_pairs(a, a, budget), len(a))
        found = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"u": a[found].view(np.int64), "v": a[label[found]].view(np.int64)})

    nodes = prints.select("print").mapInArrow(dealt, "leaf int, print long").groupBy("leaf").applyInArrow(packed, "leaf int, prints binary")
    # the roles of all nodes are bounded by MAX_NODES and the budget, not by the prints
    tasks = nodes.join(F.broadcast(roles), "leaf").select("pair", "side", "prints")
    return tasks.groupBy("pair").applyInArrow(joined, "u long, v long")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, budget: int = 2, seed: int = 42, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, print (long), component_id (the smallest doc_id that links
    reach), root (a print that names the component) and a hash of the text.

    Equal fingerprints are one node whatever their number; null ids belong to components but
    name none (null where a component has no other).  No rows: no rows.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.hash(text).alias("text_hash"), F.col(text).alias("text"))
    printed = staged(with_fingerprint(narrow, shingle, seed, name="print").drop("text"))
    prints = staged(printed.groupBy("print").agg(F.min("doc_id").alias("least")))
    linked = components(trie_links(prints, budget)).select(F.col("u").alias("print"), F.col("v").alias("root"))
    rooted = prints.join(linked, "print", "left").withColumn("root", F.coalesce("root", "print"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    owner = rooted.join(named, "root").select("print", "root", "component_id")
    return printed.join(owner, "print").select("doc_id", "print", "component_id", "root", "text_hash")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents with their own columns, of each group the one with the smallest id.

    Of a group without ids one row stays; of rows with one id in a group, one stays.
    """
    groups = near_duplicates(docs, doc_id=doc_id, text=text, **how)
    stays = (
        groups.where("doc_id = component_id OR component_id IS NULL")
        .groupBy("root")
        .agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
        .select(_row_key("first.doc_id").alias("__id"), F.col("first.text_hash").alias("__hash"))
    )
    plain, own = shielded(docs, doc_id, text)
    named = plain.withColumns({"__id": _row_key(doc_id), "__hash": F.hash(text)})
    alike = Window.partitionBy("__id", "__hash").orderBy(F.lit(0))
    kept = named.join(stays, ["__id", "__hash"], "left_semi").withColumn("__turn", F.row_number().over(alike))
    return own(kept.where("__turn = 1"))


def _row_key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("none"))
