"""Connected components of a table of links, by contracting neighbourhoods to stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, shuffle_parts, stored, tidy

#: Links that a task contracts at once; more are contracted block by block, so a node may have any number of links.
BLOCK = 1_000_000


def _roots(a, b, n: int):
    """Smallest number in each number's component, of links between the numbers 0 to n - 1."""
    import numpy as np

    up = np.arange(n)
    while True:
        x, y = up[a], up[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            return up
        np.minimum.at(up, high, low)
        while not np.array_equal(up[up], up):
            up = up[up]


def _contract(links: DataFrame, dealt: bool) -> DataFrame:
    """Links (u, v) of each task as stars: every node of a component in a block points at the smallest one.

    Where the links were ``dealt`` by u, with each link in both directions, only the nodes at u answer for themselves;
    one at v is told where its neighbour points, unless that is the neighbour.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def stars(u, v):
            nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            a, b = at[: len(u)], at[len(u) :]
            root = _roots(a, b, len(nodes))
            if dealt:
                news = np.flatnonzero((root[b] != a) & (root[b] != b))
                tell = np.unique(np.concatenate([a, b[news]]))
            else:
                tell = np.arange(len(nodes))
            tell = tell[root[tell] != tell]
            return pa.RecordBatch.from_arrays([pa.array(nodes[tell]), pa.array(nodes[root[tell]])], names=["u", "v"])

        held, size = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            size += batch.num_rows
            if size >= BLOCK:
                yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
        if size:
            yield stars(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return links.mapInArrow(run, "u long, v long")


def connected(links: DataFrame, a: str = "a", b: str = "b", roots: bool = True) -> DataFrame:
    """(node, component) of every node of a link to another node; component is the smallest node reachable.

    Links to oneself and null ends are ignored, repeated links count once. Without ``roots`` the nodes that are their own
    component are left out. Each round is one exchange and a written table, and only its row count and checksum come to
    the driver. Rounds end when nothing changes, so when every component is one star.
    """
    ends = stored(links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v"), "links")
    blocks = -(-ends.count() // BLOCK)
    at = stored(_contract(ends.coalesce(max(1, blocks)), False), "links")
    discard(ends)
    before = None
    while blocks > 1:
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        after = stored(_contract(both.repartition(shuffle_parts(at.sparkSession), "u"), True), "links")
        discard(at)
        at = after
        print_of = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if print_of == before or not print_of[0]:
            break
        before = print_of
    found = at.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.union(at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()) if roots else found
