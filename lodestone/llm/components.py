"""Connected components of an undirected graph of any size, by contraction.

In a round every node points to its smallest neighbour where that is smaller than itself. Pointers are doubled until
they end at nodes that don't point, so that a chain of any length folds up in one round; edges are carried over to where
their ends point and made distinct. A node that pointed leaves the graph. Of those that stay, the ones that nothing points
to then have a smaller neighbour and leave in the next round, and the others are no more than those that left: two rounds
halve the nodes at least. So rounds are logarithmic in the nodes, and doublings in the length of a round's chains. The
pointers of all rounds, followed in order, give each node's smallest reachable node. Each round's tables are written to the shared folder; nothing comes to the driver but whether a table is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import tidied
from lodestone.session import saved

#: Edges that one task folds in some 100 MB.
ONE_TASK = 1 << 20


def _ends(pointers: DataFrame) -> DataFrame:
    """Pointers (node, to) as far as they lead, by doubling; each leads to a smaller node, so none leads in a circle."""
    while True:
        on = pointers.select(F.col("node").alias("to"), F.col("to").alias("_on"))
        if pointers.join(on, "to", "left_semi").isEmpty():
            return pointers
        pointers = saved(pointers.join(on, "to", "left").select("node", F.coalesce("_on", "to").alias("to")), "pointers")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rounds over arrays, for all edges in one task."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, ends = np.unique(np.concatenate([x for pair in zip(*parts, strict=True) for x in pair]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    to = np.arange(len(nodes))
    while True:
        x, y = np.minimum(to[a], to[b]), np.maximum(to[a], to[b])
        if (x == y).all():
            break
        np.minimum.at(to, y, x)
        while (to[to] != to).any():
            to = to[to]
    for at in range(0, len(nodes), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 100_000]), pa.array(nodes[to[at : at + 100_000]])], names=["node", "component"])


def components(edges: DataFrame, on_round: Callable[[int], None] = lambda rounds: None, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for each node of edges (a, b), both long and not null; component: the smallest reachable node.

    Self-loops and repeated edges do no harm; no edges give an empty table. Up to one_task edges are folded in one task
    instead of rounds over tables, with the same result.
    """
    edges = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges")
    if edges.count() <= one_task:
        return edges.coalesce(1).mapInArrow(tidied(_folded), "node long, component long")
    members, rounds = None, 0
    while not edges.isEmpty():
        rounds += 1
        on_round(rounds)
        # partial aggregation before the shuffle: a node with very many edges sends one row a task
        down = _ends(saved(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to")), "pointers"))
        if members is None:
            nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            members = nodes.join(down, "node", "left").select("node", F.coalesce("to", "node").alias("component"))
        else:
            members = members.join(down.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        members = saved(members, "members")
        # b always points on; a where it has a smaller neighbour itself
        moved = edges.join(down.select(F.col("node").alias("b"), F.col("to").alias("_b")), "b").join(down.select(F.col("node").alias("a"), F.col("to").alias("_a")), "a", "left")
        moved = moved.select(F.coalesce("_a", "a").alias("x"), F.col("_b").alias("y"))
        edges = saved(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct(), "edges")
    if members is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members
