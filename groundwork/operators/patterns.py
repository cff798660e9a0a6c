"""Path patterns over a property graph, as joins reduced by semi-joins.

A pattern is a list of nodes and hops in turn. Before any path is formed, the edges of every hop are cut down to
those whose ends can be its nodes, forwards and then backwards, so that an edge takes part only if it lies on some
whole match of the labels and conditions. A repeated hop is a union of walks of each allowed length.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.sources.scratch import checkpointed

#: Walks are materialised hop by hop, so the number of hops is bounded.
MOST_HOPS = 32


@dataclass(frozen=True)
class Node:
    """A vertex of the match, known as ``name``; ``where`` is over the vertex columns."""

    name: str
    label: str | None = None
    where: Column | None = None


@dataclass(frozen=True)
class Hop:
    """``least`` to ``most`` edges in their direction; ``where`` is over the edge columns and holds for each edge."""

    name: str
    where: Column | None = None
    least: int = 1
    most: int = 1


def match(vertex: DataFrame, edge: DataFrame, pattern: Sequence[Node | Hop]) -> DataFrame:
    """One row per match: a column for each node (its id), and for each hop.

    ``vertex`` has id and label, ``edge`` src and dst; both may have more columns for conditions. A hop of one
    edge gives a struct of the edge's columns, a repeated hop the number of its edges. Parallel edges are
    matches of their own in a single hop; in a repeated one a walk counts once per pair of ends and length.
    """
    nodes, hops = list(pattern[::2]), list(pattern[1::2])
    if len(pattern) % 2 == 0 or not all(isinstance(x, Node) for x in nodes) or not all(isinstance(x, Hop) for x in hops):
        raise ValueError("a pattern is a node, then a hop and a node each time")
    names = [part.name for part in pattern]
    if len(set(names)) != len(names):
        raise ValueError("nodes and hops need different names")
    if not all(1 <= hop.least <= hop.most <= MOST_HOPS for hop in hops):
        raise ValueError(f"a hop has from 1 to {MOST_HOPS} edges")
    able = [_able(vertex, node) for node in nodes]
    steps = []
    reached = able[0]
    for hop, after in zip(hops, able[1:], strict=True):
        step = _step(edge, hop, reached).join(after.select(F.col("id").alias("dst")), "dst", "left_semi")
        steps.append(step)
        reached = step.select(F.col("dst").alias("id")).distinct()
    # Backwards: an edge stays only if the next hop goes on from its end.
    for i in range(len(steps) - 2, -1, -1):
        steps[i] = steps[i].join(steps[i + 1].select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    found = able[0].select(F.col("id").alias(nodes[0].name)) if not steps else None
    for node, hop, step, after in zip(nodes, hops, steps, nodes[1:], strict=False):
        part = step.select(F.col("src").alias(node.name), F.col("dst").alias(after.name), F.col("hop").alias(hop.name))
        found = part if found is None else found.join(part, node.name)
    return found.select(*names)


def _able(vertex: DataFrame, node: Node) -> DataFrame:
    rows = vertex
    if node.label is not None:
        rows = rows.where(F.col("label") == node.label)
    if node.where is not None:
        rows = rows.where(node.where)
    return rows.select("id").distinct()


def _step(edge: DataFrame, hop: Hop, reached: DataFrame) -> DataFrame:
    """(src, dst, hop) of the edges or walks that leave a reached vertex."""
    usable = edge if hop.where is None else edge.where(hop.where)
    start = reached.select(F.col("id").alias("src"))
    if hop.most == 1:
        return usable.select("src", "dst", F.struct(*[F.col(c) for c in edge.columns]).alias("hop")).join(start, "src", "left_semi")
    links = checkpointed(usable.select("src", "dst").distinct())
    walk = checkpointed(links.join(start, "src", "left_semi"))
    onward = links.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    walks = []
    for length in range(1, hop.most + 1):
        if length > 1:
            # One row per pair of ends and length: the number of walks does not multiply.
            walk = checkpointed(walk.join(onward, "dst").select("src", F.col("next").alias("dst")).distinct())
        if length >= hop.least:
            walks.append(walk.withColumn("hop", F.lit(length)))
    every = walks[0]
    for more in walks[1:]:
        every = every.unionByName(more)
    return every
