"""Connected components by alternating large-star and small-star steps over a table of links.

Tasks first replace their own links by stars, block by block, which leaves fewer links and shorter paths. Each round is a grouped minimum and a join; nothing is collected but two numbers. A node with many links shows up as
one hot join key, which partial aggregation and adaptive skew joins take apart. Rounds grow with the logarithm of the
longest path.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.llm.shared import materialise

MOST_ROUNDS = 60
BLOCK_LINKS = 1 << 20


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _measure(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) as links of each node to the smallest one that it reaches by the block's links; a is the larger node."""
    held: list[np.ndarray] = []

    def contracted() -> pa.RecordBatch:
        nodes, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        held.clear()
        up, (a, b) = np.arange(len(nodes)), ends.reshape(2, -1)
        while True:  # nodes are in order, so positions compare as nodes do
            before = up.copy()
            low = np.minimum(up[a], up[b])
            for at in (up[a], up[b], a, b):
                np.minimum.at(up, at, low)
            up = up[up]
            if np.array_equal(before, up):
                break
        moved = np.flatnonzero(up != np.arange(len(up)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[up[moved]])], names=["a", "b"])

    for batch in batches:
        held.append(np.stack([np.asarray(batch.column(0)), np.asarray(batch.column(1))]))
        if sum(h.shape[1] for h in held) > BLOCK_LINKS:
            yield contracted()
    if held:
        yield contracted()


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node it reaches) of every node in links (a long, b long)."""
    own = materialise(links.where("a <> b").select("a", "b"), "links")
    held = materialise(own.mapInArrow(stars, "a long, b long").distinct(), "links")
    before = _measure(held)
    for _ in range(MOST_ROUNDS):
        # large star: larger neighbours of a node go to the smallest of the node and its neighbours
        around = _both_ways(held)
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: smaller neighbours of a node, and the node, go to the smallest of them
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("l")).select("l.*")
        held = materialise(small.where("a <> b").distinct(), "links")
        now = _measure(held)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components have not settled within {MOST_ROUNDS} rounds")
    roots = held.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return held.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
