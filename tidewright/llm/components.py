"""Connected components of an edge table, without gathering it anywhere.

Each partition first shrinks its own edges to a spanning star forest with
union-find; the forests are then merged by alternating large-star and
small-star steps (both keep connectivity and move every node towards the least
node it can reach), which need O(log n) rounds.  Each round is a table in the
shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import cut, drop, with_hash


#: Edges of one file of a round's table, about.
FILE_EDGES = 500_000


class UnionFind:
    """Union-find whose root is the least member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (p := up.get(root, root)) != root:
            root = p
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _forest(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    links = UnionFind()
    for batch in found:
        for a, b in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            links.union(a, b)
    nodes = list(links.up)
    yield pd.DataFrame({"u": nodes, "v": [links.find(x) for x in nodes]}, dtype="int64")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = with_hash(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "u")
    moved = with_hash(both, "u").join(least, ["u", "_h"]).where("v > u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = with_hash(edges, "u").join(with_hash(least, "u"), ["u", "_h"]).where("v != m")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (columns ``u``, ``v``, both long), as a table.

    ``edges`` is read twice, so it is better a table or cached.  ``component`` is the least id that the node reaches.  Empty edges give an
    empty table; loops and repeated edges change nothing.
    """
    clean = edges.where("u is not null and v is not null and u != v").select("u", "v")
    files = 1 + clean.count() // FILE_EDGES
    now = cut(clean.mapInPandas(_forest, "u long, v long").distinct().coalesce(files), "forest")
    state = None
    while True:
        seen = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        files = 1 + seen[0] // FILE_EDGES
        if seen == state:  # the last round changed nothing
            break
        state = seen
        wide = cut(_large_star(now).distinct().coalesce(files), "wide")
        stepped = cut(_small_star(wide).distinct().coalesce(files), "stars")
        drop(now, wide)
        now = stepped
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    nodes = now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
    out = cut(nodes.coalesce(files), "components")
    drop(now)
    return out
