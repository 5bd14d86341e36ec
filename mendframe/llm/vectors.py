"""Near-duplicate embeddings: int8 tile products with rigorous error bounds, then double precision where needed.

Vectors are scaled to unit length; equal ones are collapsed first and come back with their numbers. A fixed set of
pivots deals similar vectors to the same tiles, and tiles whose caps (centre and angular radius) lie further apart than
the threshold angle are never compared. For two tiles the products of int8 codes are exact in float32; with the norm of
each vector's quantisation error they bound every cosine from above and below. Pairs that may reach the threshold are
recomputed in double precision from the components as stored. A pair of tiles gives link counts of its vectors and
links that span its components, not all its pairs, so that a large group of near copies costs no quadratic output.

Defined cases: null, empty and zero vectors and vectors with null or non-finite components link with nothing and keep
their row; vectors of another length than most never link with those; equal vectors link with each other; vec_id is
meant to be unique, repeated rows count as vectors of their own that share an id; vectors without
vec_id link with nothing; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mendframe.llm.components import components
from mendframe.llm.shared import materialise, small_batches, tidied

THRESHOLD = 0.95
TILE = 4096
BLOCK = 1024
PIVOTS = 1024
SLACK = 1e-6
EXACT_WIDTH = 1024
CAP_BLOCK = 256


def usable(vector):
    """Vectors that can link: not empty, without nulls or non-finite components, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows in double precision at unit length; scaling by the largest component first keeps squares in range."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def quantised(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, steps, lengths of the coded vectors, and lengths of what the codes leave out."""
    step = np.abs(rows).max(axis=1) / 127
    codes = np.rint(rows / step[:, None]).astype(np.int8)
    coded = codes * step[:, None]
    rest = rows - coded
    return codes, step, np.linalg.norm(coded, axis=1), np.linalg.norm(rest, axis=1)


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of codes held as float32, exact for any width: sums over 1024 components stay below 2^24."""
    width = left.shape[1]
    if width <= EXACT_WIDTH:
        return left @ right.T
    total = np.zeros((len(left), len(right)))
    for k in range(0, width, EXACT_WIDTH):
        total += left[:, k : k + EXACT_WIDTH] @ right[:, k : k + EXACT_WIDTH].T
    return total


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def union_pairs(self, a: np.ndarray, b: np.ndarray) -> None:
        """Minimum labels travel along the pairs until nothing changes."""
        if not len(a):
            return
        while True:
            low = np.minimum(self.up[a], self.up[b])
            before = self.up.copy()
            np.minimum.at(self.up, self.up[a], low)
            np.minimum.at(self.up, self.up[b], low)
            np.minimum.at(self.up, a, low)
            np.minimum.at(self.up, b, low)
            self.up = self.up[self.up]
            if np.array_equal(before, self.up):
                return


def compare_tiles(left: np.ndarray, right: np.ndarray | None, threshold: float, weights: tuple[np.ndarray, np.ndarray]):
    """Links between the rows of two tiles, or within one (right None).

    Returns weighted link counts of the left and of the right rows, and spanning links as two arrays of positions, those
    of the right tile after those of the left.
    """
    same = right is None
    other = left if same else right
    n, m = len(left), len(other)
    codes_l, step_l, len_l, rest_l = quantised(left)
    codes_r, step_r, len_r, rest_r = (codes_l, step_l, len_l, rest_l) if same else quantised(other)
    floats_l = codes_l.astype(np.float32)
    floats_r = floats_l if same else codes_r.astype(np.float32)
    counts_l, counts_r = np.zeros(n, np.int64), np.zeros(m, np.int64)
    forest = Forest(n if same else n + m)
    for i in range(0, n, BLOCK):
        a = slice(i, min(i + BLOCK, n))
        for j in range(i if same else 0, m, BLOCK):
            b = slice(j, min(j + BLOCK, m))
            dots = products(floats_l[a], floats_r[b])
            # no pair of the block can reach the threshold with a product below this
            most = len_l[a].max() * rest_r[b].max() + rest_l[a].max() * (len_r[b].max() + rest_r[b].max()) + SLACK
            least = (threshold - most) / (step_l[a].max() * step_r[b].max())
            at = np.flatnonzero(dots >= least)
            if not len(at):
                continue
            x, y = np.divmod(at, dots.shape[1])
            if same and i == j:
                x, y, at = x[x < y], y[x < y], at[x < y]
            bound = len_l[a][x] * rest_r[b][y] + rest_l[a][x] * (len_r[b][y] + rest_r[b][y]) + SLACK
            maybe = dots.ravel()[at].astype(np.float64) * (step_l[a][x] * step_r[b][y]) + bound >= threshold
            x, y = x[maybe], y[maybe]
            if not len(x):
                continue
            x, y = x + i, y + j
            exact = np.empty(len(x))
            for k in range(0, len(x), 65536):
                part = slice(k, k + 65536)
                exact[part] = np.einsum("ij,ij->i", left[x[part]], other[y[part]])
            x, y = x[exact >= threshold], y[exact >= threshold]
            np.add.at(counts_l, x, weights[1][y])
            np.add.at(counts_l if same else counts_r, y, weights[0][x])
            forest.union_pairs(x, y if same else n + y)
    moved = np.flatnonzero(forest.up != np.arange(len(forest.up)))
    return counts_l, counts_r, moved, forest.up[moved]


def packer(width: int, kind: np.dtype) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Makes one row of a tile's vectors."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rep")
        raw = np.frombuffer(b"".join(frame["raw"]), kind).reshape(-1, width)
        flat = unit(raw.astype(np.float64))
        centre = unit(flat.mean(axis=0, keepdims=True) + 1e-12)[0]
        radius = float(np.arccos(np.clip(flat @ centre, -1, 1)).max())
        return pd.DataFrame({
            "tile": [int(frame["cell"].iloc[0]) << 32 | int(frame["piece"].iloc[0])], "centre": [centre.tobytes()], "radius": [radius],
            "reps": [frame["rep"].to_numpy(np.int64).tobytes()], "weights": [frame["weight"].to_numpy(np.int64).tobytes()], "rows": [raw.tobytes()],
        })

    return pack


def cap_packer(frame: pd.DataFrame) -> pd.DataFrame:
    """Makes one row of up to CAP_BLOCK caps or so, with a cap around them all."""
    frame = frame.sort_values("tile")
    centres, radii = np.array([np.frombuffer(c) for c in frame["centre"]]), frame["radius"].to_numpy()
    centre = unit(centres.mean(axis=0, keepdims=True) + 1e-12)[0]
    radius = float((np.arccos(np.clip(centres @ centre, -1, 1)) + radii).max())
    return pd.DataFrame({
        "block": [int(frame["block"].iloc[0])], "centre": [centre.tobytes()], "radius": [radius],
        "tiles": [frame["tile"].to_numpy(np.int64).tobytes()], "centres": [centres.tobytes()], "radii": [radii.tobytes()],
    })


def near_tiles(tiles: DataFrame, width: int, threshold: float) -> DataFrame:
    """Pairs of tiles (left, right), each once, whose caps come within the threshold angle of each other.

    Caps lie in blocks with a cap of their own. Only block caps reach the driver, one for some CAP_BLOCK * TILE vectors
    (a million); caps of tiles meet only for blocks that are near.
    """
    spark = tiles.sparkSession
    angle = float(np.arccos(threshold)) + SLACK
    # tiles of a cell lie together: a block is some CAP_BLOCK pieces of one cell
    placed = tiles.select("tile", "centre", "radius", F.shiftright("tile", 32).alias("cell"), F.expr(f"(tile & {(1 << 32) - 1}) div {CAP_BLOCK}").alias("nth"))
    placed = placed.select("tile", "centre", "radius", F.expr("(cell << 32) | nth").alias("block"))
    blocks = materialise(placed.groupBy("block").applyInPandas(cap_packer, "block long, centre binary, radius double, tiles binary, centres binary, radii binary"), "caps")
    caps = blocks.select("block", "centre", "radius").orderBy("block").collect()
    names = np.array([r["block"] for r in caps], np.int64)
    shared = spark.sparkContext.broadcast((names, np.array([np.frombuffer(r["centre"]) for r in caps]), np.array([r["radius"] for r in caps])))

    def block_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centres, radii = shared.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                between = np.arccos(np.clip(centres[i:] @ centres[i], -1, 1))
                j = i + np.flatnonzero(between <= radii[i] + radii[i:] + angle)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), names[i])), pa.array(names[j])], names=["left", "right"])

    def tile_pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                (names, centres, radii), (others, around, reach) = (
                    (np.frombuffer(r[f"{s}_tiles"], np.int64), np.frombuffer(r[f"{s}_centres"]).reshape(-1, width), np.frombuffer(r[f"{s}_radii"])) for s in ("left", "right")
                )
                between = np.arccos(np.clip(centres @ around.T, -1, 1))
                i, j = np.nonzero(between <= radii[:, None] + reach[None, :] + angle)
                if r["left"] == r["right"]:
                    i, j = i[i <= j], j[i <= j]
                yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(others[j])], names=["left", "right"])

    near = spark.range(0, len(caps), 1, max(1, len(caps) // 16)).mapInArrow(block_pairs, "left long, right long")
    ends = [blocks.select(F.col("block").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("tiles", "centres", "radii")]) for s in ("left", "right")]
    return near.join(ends[0], "left").join(ends[1], "right").mapInArrow(tile_pairs, "left long, right long")


def link_vectors(rows: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, pivots: int = PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id and kept of rows (vec_id, embedding)."""
    spark = rows.sparkSession
    small_batches(spark)
    kind = np.dtype("f4" if "array<float>" in rows.select("embedding").dtypes[0][1] else "f8")
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = vectors.withColumn("fine", usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    fine = vectors.where("fine")
    # equal vectors share 128 bits of hashes, which stand for them in exchanges
    keys = {"key_a": F.xxhash64("embedding"), "key_b": F.xxhash64(F.lit(1), "embedding")}
    found_groups = fine.withColumns(keys).groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    groups = materialise(found_groups, "vectors")
    sizes = groups.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).collect()  # a row a width
    found = []
    for width, n in ((r["width"], r["n"]) for r in sizes):
        own = groups.where(F.size("embedding") == width)
        chosen = own.orderBy(F.xxhash64("rep"), "rep").limit(max(1, min(pivots, n // tile))).collect()  # the pivots, PIVOTS at most
        aims = unit(np.array([r["embedding"] for r in chosen]))

        def deal(batches: Iterable[pa.RecordBatch], aims=aims, width=width) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = np.asarray(batch.column(0).flatten()).astype(kind).reshape(-1, width)
                near = np.argmax(unit(raw.astype(np.float64)) @ aims.T, axis=1)
                payload = pa.array([r.tobytes() for r in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(near, pa.int32()), payload], names=["rep", "weight", "cell", "raw"])

        dealt = own.select("embedding", "rep", "weight").mapInArrow(deal, "rep long, weight long, cell int, raw binary")
        per_cell = dealt.groupBy("cell").agg(F.ceil(F.count("*") / tile).alias("pieces"))  # a row a pivot
        dealt = dealt.join(F.broadcast(per_cell), "cell").withColumn("piece", F.expr("pmod(xxhash64(rep), pieces)")).drop("pieces")

        tiles = materialise(dealt.groupBy("cell", "piece").applyInPandas(packer(width, kind), "tile long, centre binary, radius double, reps binary, weights binary, rows binary"), "tiles")
        near = materialise(near_tiles(tiles, width, threshold), "near")
        ends = [tiles.select(F.col("tile").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("reps", "weights", "rows")]) for s in ("left", "right")]
        joined = near.join(ends[0], "left").join(ends[1], "right")

        def compare(batches: Iterable[pa.RecordBatch], width=width) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    same = r["left"] == r["right"]
                    left, right = (unit(np.frombuffer(r[f"{s}_rows"], kind).reshape(-1, width).astype(np.float64)) for s in ("left", "right"))
                    reps = [np.frombuffer(r[f"{s}_reps"], np.int64) for s in ("left", "right")]
                    weights = tuple(np.frombuffer(r[f"{s}_weights"], np.int64) for s in ("left", "right"))
                    counts_l, counts_r, a, b = compare_tiles(left, None if same else right, threshold, weights)
                    every = reps[0] if same else np.concatenate(reps)
                    counts = counts_l if same else np.concatenate([counts_l, counts_r])
                    some = np.flatnonzero(counts)
                    none = np.zeros(len(some), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([every[some], every[a]])), pa.array(np.concatenate([counts[some], np.zeros(len(a), np.int64)])), pa.array(np.concatenate([none - 1, every[b]]))],
                        names=["rep", "n", "other"],
                    )

        found.append(joined.mapInArrow(tidied(compare), "rep long, n long, other long"))
    if not found:
        return vectors.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    seen = found[0]
    for more in found[1:]:
        seen = seen.unionByName(more)
    seen = materialise(seen, "vector_links")
    linked = seen.where("n > 0").groupBy(F.col("rep").alias("of")).agg(F.sum("n").alias("near"))
    roots = components(seen.where("n = 0 and other <> -1").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    per_group = groups.join(linked, groups.rep == linked.of, "left").join(roots, F.col("rep") == F.col("node"), "left").select(
        *[F.col(k).alias(f"of_{k}") for k in keys], (F.coalesce("near", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("component", "rep").alias("root")
    )
    hashed = vectors.withColumns(keys).select("vec_id", *[F.when(F.col("fine"), F.col(k)).alias(k) for k in keys])
    out = hashed.join(per_group, (F.col("key_a") == F.col("of_key_a")) & (F.col("key_b") == F.col("of_key_b")), "left")
    root = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), root.eqNullSafe(F.col("vec_id")).alias("kept"))
