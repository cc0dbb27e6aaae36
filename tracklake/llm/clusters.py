"""Components of verified links among nodes that share buckets.

No step lists all pairs of a bucket.  A node has a weight, and a part of it
that any other text can share at all; two nodes can reach a similarity t only
if both shared parts reach t / (1 + t) times the sum of their weights.  Nodes
without such a partner in a bucket leave it, which is exact and empties the
clouds of loosely related texts.

First, the nodes of a bucket are laid in a line, sorted by a min-hash of their
other buckets, so that nodes with much in common stand together; each is held
against the few before it.  Then, in turns, the nodes outside a bucket's
largest component are held against its other nodes, a bounded number of them
in a turn, until every two nodes that can be similar are connected or have
been held against each other.  Two nodes meet in the least of the buckets that
they share, and there alone.  A large bucket is dealt over several parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, map_batches, materialise

#: So many nodes of a bucket are held against its other nodes in one turn.
PIVOTS = 64
#: So many nodes before it in the line is each node held against.
NEIGHBOURS = 2
#: Larger buckets are laid in several lines, and dealt over parts, of about so many nodes.
LINE = 4096
#: So many links are contracted at a time.
RUN = 1 << 18


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links (a, b), each node but the least of its component, and that least one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        for i in (x, y, label[x], label[y]):
            np.minimum.at(new, i, least)
        while not np.array_equal(jumped := new[new], new):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a task as stars, a bounded number held at a time."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    for part in batches:
        a, b = np.concatenate([a, part.column("a").to_numpy()]), np.concatenate([b, part.column("b").to_numpy()])
        if len(a) >= 2 * RUN:
            a, b = spanning_stars(a, b)
            if len(a) >= RUN:
                yield batch()
                a, b = a[:0], b[:0]
    a, b = spanning_stars(a, b)
    yield batch()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for all nodes of ``edges`` (a, b), two longs.

    ``edges`` must be written already, as it is counted and read again.  Tasks
    of about RUN links contract theirs to stars.  If that took more than one
    task, large stars and small stars follow by turns, until every node has
    one link, to its component.
    """

    def stars(pairs: DataFrame, large: bool) -> DataFrame:
        if large:
            near = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
            least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
            found = near.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            near = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            least = near.groupBy("u").agg(F.min("v").alias("m"))
            joined = near.join(least, "u")
            found = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return materialise(found.where(F.col("a") != F.col("b")), "stars")

    def contracted(pairs: DataFrame) -> tuple[DataFrame, int]:
        tasks = max(1, -(-pairs.count() // RUN))
        return materialise(map_batches(pairs.coalesce(tasks), _contract, "a long, b long"), "links"), tasks

    def open_nodes(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(pairs.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or (up > 0 and root > 0)")

    pairs, tasks = contracted(edges.select("a", "b").where("a != b"))
    while tasks > 1 and not open_nodes(pairs).isEmpty():
        larger = stars(pairs, True)
        smaller = stars(larger, False)
        fresh, tasks = contracted(smaller)
        discard(pairs, larger, smaller)
        pairs = fresh
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    labels = materialise(pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots), "labels")
    discard(pairs)
    return labels


def verified_components(members: DataFrame, sets: DataFrame, similarity: float, verify: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """node, component for nodes with a verified link.

    members: node, bucket (longs, distinct), the node's total and shared
    weight.  sets: what ``verify`` needs of each node.  verify: gets distinct
    pairs (a, b) and the sets, and returns the pairs that hold.  Every two
    nodes of a bucket that can be similar are verified, or connected already,
    when this ends.
    """
    part = similarity / (1 + similarity) * (1 - 1e-6)
    can = lambda total, shared, pt, ps: F.least(shared, ps) >= part * (total + pt)
    least = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("total").alias("least")).where("n > 1").drop("n")
    able = materialise(members.join(least, "bucket").where(F.col("shared") >= part * (F.col("total") + F.col("least"))).drop("least"), "members")
    sized = able.join(able.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket")
    # a node's buckets: as many as there are bands
    nodes = sized.groupBy("node").agg(F.sum("n").alias("company"), F.collect_list("bucket").alias("buckets"))
    placed = materialise(sized.join(nodes, "node"), "able")
    discard(able)
    few = materialise(sets.join(placed.select("node").distinct(), "node", "left_semi"), "sets")

    others = F.filter("buckets", lambda x: x != F.col("bucket"))
    alike = F.array_sort(F.transform(others, lambda x: F.xxhash64(x, F.col("bucket"))))
    salt = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / LINE))
    line = Window.partitionBy("bucket", salt).orderBy("alike", "node")
    lined = placed.withColumn("alike", alike).select(
        "node", "total", "shared", F.array(*(F.lag(F.struct("node", "total", "shared"), k).over(line) for k in range(1, NEIGHBOURS + 1))).alias("near")
    )
    able_near = F.filter("near", lambda x: can(F.col("total"), F.col("shared"), x["total"], x["shared"]))
    near = lined.select("node", F.explode(able_near).alias("other"))
    near = near.select(F.least("node", "other.node").alias("a"), F.greatest("node", "other.node").alias("b")).distinct()
    links = materialise(verify(near, few), "verified")
    labels = components(links)
    discard(links)
    # nodes of a bucket that have not been held against all its others
    kept = ["bucket", "node", "total", "shared", "company", "buckets", "n"]
    waiting, earlier = placed.select(*kept), placed
    while True:
        known = waiting.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        parts = known.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("k"))
        largest = parts.groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
        known = materialise(known.join(largest.select("bucket", F.col("top.component").alias("top")), "bucket"), "open")
        discard(earlier)
        if known.isEmpty():
            discard(known, few)
            return labels
        outside = known.where(F.col("component") != F.col("top"))
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("company").desc(), "node"))
        # a turn meets each part of its bucket
        turn = materialise(outside.withColumn("rank", rank).where(F.col("rank") <= PIVOTS).select(
            F.col("bucket").alias("at"), F.col("node").alias("a"), F.col("component").alias("ca"), F.col("total").alias("pt"), F.col("shared").alias("ps"), F.col("buckets").alias("pb"), F.col("n").alias("pn"),
        ), "turn")
        turned = turn.select(F.col("at").alias("bucket"), F.col("a").alias("node"), F.lit(True).alias("turned"))
        marked = known.join(turned, ["bucket", "node"], "left")
        dealt = turn.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("pn") / LINE) - 1)))
        once = F.col("turned").isNull() | (F.col("node") < F.col("a"))
        here = F.array_min(F.array_intersect("buckets", "pb")) == F.col("at")
        meet = (F.col("bucket") == F.col("at")) & (F.col("own_salt") == F.col("salt")) & (F.col("component") != F.col("ca"))
        pairs = marked.withColumn("own_salt", salt).join(dealt, meet & once & can(*map(F.col, ("total", "shared", "pt", "ps"))) & here)
        found = materialise(verify(pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")), few), "verified")
        waiting, earlier = marked.where("turned is null").select(*kept), known
        if not found.isEmpty():
            old, labels = labels, joined_components(labels, found)
            discard(old)
        discard(found)


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after some more links between nodes of their components."""
    first = labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    second = labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    between = links.join(first, "a", "left").join(second, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    between = materialise(between, "between")
    joined = components(between)
    merged = joined.select(F.col("node").alias("component"), F.col("component").alias("into"))
    moved = labels.join(merged, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    fresh = merged.join(labels.select(F.col("node").alias("component")), "component", "left_anti").select(F.col("component").alias("node"), F.col("into").alias("component"))
    found = materialise(moved.union(fresh), "labels")
    discard(joined, between)
    return found
