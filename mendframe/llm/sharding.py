"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

The rows of partition p are dealt to shards as a uniformly random permutation of all rows would deal them: the counts
of each partition and shard are drawn exactly (multivariate hypergeometric, halving ranges of partitions), each partition
permutes its labels locally, rows move to their shards, and each shard permutes again. Only counts of
partitions reach the driver. A shard's final order is that of random 64-bit keys; places come from counts of key
buckets and a sort within each bucket, so that no shard has to fit a task.

The law is `rows`: shard sizes differ by one row at most. Equal texts are not kept together, as no exact row count
could then hold for a large group.

Defined cases: null text has size 1 and the CRC of no bytes; repeated rows are separate rows; an empty table gives an
empty result; extra columns stay, whatever their names, but for shard and slot. The draw is fixed by the seed and by how the materialised rows lie in partitions.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mendframe.llm.shared import materialise, own_name

SEED = 20_240_501
KEY_BUCKETS = 512
PART_BITS = 33
NUMPY_LIMIT = 10**9


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes at most one apart; the first shards take the rest."""
    return np.full(shards, rows // shards, np.int64) + (np.arange(shards) < rows % shards)


def communication_matrix(counts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """matrix[p, s] rows go from partition p to shard s: row sums are counts, column sums are sizes.

    Ranges of partitions are halved: how many rows of each shard fall to the first half is multivariate hypergeometric,
    one conditional draw a shard. So only the few ranges of very many rows need draws from large populations.
    """
    rng = np.random.default_rng(seed)
    ends = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    matrix = np.zeros((len(counts), len(sizes)), np.int64)
    open_ranges = [(0, len(counts), np.asarray(sizes, np.int64))] if len(counts) else []
    while open_ranges:
        first, last, held = open_ranges.pop()
        if last - first == 1:
            matrix[first] = held
            continue
        middle = (first + last) // 2
        rest, total = int(ends[middle] - ends[first]), int(ends[last] - ends[first])
        left = np.zeros_like(held)
        for s, have in enumerate(held.tolist()):
            total -= have
            left[s] = rest if total == 0 else _hypergeometric(rng, have, total, rest)
            rest -= int(left[s])
        open_ranges += [(middle, last, held - left), (first, middle, left)]
    return matrix


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """A hypergeometric draw; beyond numpy's limit by inversion of the weights around the mode, right to rounding."""
    if good == 0 or draws == 0:
        return 0
    return int(rng.hypergeometric(good, bad, draws)) if good + bad < NUMPY_LIMIT else _inverted(rng, good, bad, draws)


def _inverted(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Weights follow from the mode by exact ratios of neighbours; what lies beyond 12 deviations is below 1e-30."""
    every = good + bad
    mode = (draws + 1) * (good + 1) // (every + 2)
    far = int(12 * math.sqrt(draws * (good / every) * (bad / every) * ((every - draws) / max(1, every - 1)))) + 60
    low, high = max(0, draws - bad, mode - far), min(good, draws, mode + far)
    k = np.arange(low, high, dtype=np.float64)  # ratio[i]: weight of low + i + 1 by that of low + i
    ratio = (good - k) / (k + 1) * ((draws - k) / (bad - draws + k + 1))
    at = mode - low
    weights = np.concatenate([np.cumprod(1 / ratio[:at][::-1])[::-1], [1.0], np.cumprod(ratio[at:])])
    up_to = np.cumsum(weights)
    return low + min(int(np.searchsorted(up_to, rng.random() * up_to[-1], side="right")), high - low)


def shard(rows: DataFrame, shards: int = 8, seed: int = SEED, buckets: int = KEY_BUCKETS) -> DataFrame:
    """Adds shard int and slot long (gapless from 0 in each shard) to rows; columns of these names are replaced."""
    spark = rows.sparkSession
    rows = rows.drop("shard", "slot")
    spot, keyed, bucket, start = (own_name(rows, n) for n in ("part_place", "shard_key", "shard_bucket", "shard_start"))
    kept = materialise(rows.withColumn(spot, F.monotonically_increasing_id()), "shard")
    part = F.shiftright(spot, PART_BITS)
    counted = sorted((r["part"], r["n"]) for r in kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    parts = {p: i for i, (p, _) in enumerate(counted)}
    counts = np.array([n for _, n in counted], np.int64)
    matrix = communication_matrix(counts, shard_sizes(int(counts.sum()), shards), seed)
    shared = spark.sparkContext.broadcast((parts, counts, matrix))  # partitions x shards counts

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, counts, matrix = shared.value
        held, labels, keys = None, None, None
        for batch in batches:
            place = np.asarray(batch.column(batch.schema.get_field_index(spot)))
            owner, at = place >> PART_BITS, place & ((1 << PART_BITS) - 1)
            out, key = np.empty(len(place), np.int32), np.empty(len(place), np.int64)
            for p in np.unique(owner):
                if p != held:
                    i = parts[int(p)]
                    rng = np.random.default_rng([seed, i])
                    labels = rng.permutation(np.repeat(np.arange(matrix.shape[1], dtype=np.int32), matrix[i]))
                    keys = rng.integers(0, 1 << 62, int(counts[i]), dtype=np.int64)
                    held = p
                mine = owner == p
                out[mine], key[mine] = labels[at[mine]], keys[at[mine]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out), pa.array(key)], names=[*batch.schema.names, "shard", keyed])

    schema = T.StructType([*kept.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField(keyed, T.LongType())])
    dealt = kept.mapInArrow(label, schema).withColumn(bucket, F.floor(F.col(keyed) / float(1 << 62) * buckets).cast("int"))
    sizes = dealt.groupBy("shard", bucket).agg(F.count("*").alias("n"))  # shards x buckets rows
    before = W.partitionBy("shard").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("shard", bucket, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    within = W.partitionBy("shard", bucket).orderBy(keyed, spot)
    return (
        dealt.withColumn("slot", F.row_number().over(within) - 1)
        .join(F.broadcast(starts), ["shard", bucket])  # shards x buckets rows, whatever the input
        .withColumn("slot", (F.col("slot") + F.col(start)).cast("long"))
        .select(*rows.columns, "shard", "slot")
    )
