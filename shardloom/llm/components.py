"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


#: Links that one task solves, for those who ask: 4 MB of them.
FEW = 1 << 18


def connected_components(links: DataFrame, a: str = "a", b: str = "b", few: int = 0) -> DataFrame:
    """(node, root): every node that occurs in a link and the smallest node it can reach.

    Large-star links a node's larger neighbours to the smallest node around it, small-star a
    node's smaller neighbours.  Both keep components and bring them to stars in a number of rounds
    logarithmic in their size.  Each round is written to the shared folder, and only the number
    of links and a checksum of them reach the driver.  Minima are aggregated before the shuffle
    and joined back, so that the hub of a star is no task's burden.

    Links with a null end, of a node to itself, or given before, count for nothing; without links
    there are no rows.  Nodes may be of any type that has an order.

    ``few`` links or fewer, of nodes that are longs, are solved in one task instead, without rounds: every
    round is a dozen stages, whose tasks all report to the driver.
    """
    pair = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now = settle(pair, "cc")
    if few and now.count() <= few:
        return settle(now.coalesce(1).mapInArrow(_solve, "node long, root long"), "cc")
    state = None
    while True:
        count, check = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not count or (count, check) == state:
            break
        state = (count, check)
        now = settle(_small_star(_large_star(now)), "cc")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def joined(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the smallest one that pairs (i, j) lead to."""
    label = np.arange(n)
    while len(i):
        x, y = label[i], label[j]
        new = label.copy()
        np.minimum.at(new, np.maximum(x, y), np.minimum(x, y))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all rows (u, v) together."""
    ends = [np.column_stack([batch.column(k).to_numpy() for k in range(2)]) for batch in batches]
    if not ends:
        return
    nodes, place = np.unique(np.concatenate(ends), return_inverse=True)
    i, j = place.reshape(-1, 2).T
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[joined(len(nodes), i, j)])], ["node", "root"])


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = both.where("v > u").join(least, "u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    joined = links.join(least, "u")
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    kept = least.select("u", F.col("m").alias("v"))
    return moved.unionByName(kept).where("u <> v").distinct()
