"""Nearest neighbours by cosine: stable projections in a kd-tree, verified until a chi-square test holds.

Unit vectors are projected on a few Gaussian directions.  Squared projected
distance over squared true distance follows a chi-square law, so once all
unseen projections are far enough, a better neighbour among them is unlikely.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Projected dimensions (even, for the closed form of the law), chance that the test keeps a
#: true neighbour, vectors in a leaf and in an index block, queries in a block.
DIRECTIONS, SURE, LEAF, BLOCK_ROWS, BLOCK_QUERIES = 8, 0.99, 32, 8192, 512
SEED = 7


def chi_square(x: float, directions: int = DIRECTIONS) -> float:
    """Distribution function of the law, for an even number of dimensions."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**i / math.factorial(i) for i in range(directions // 2))


def stop_ratio(sure: float, directions: int = DIRECTIONS) -> float:
    """Ratio of squared projected to squared true distance that is exceeded with chance 1 - sure."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, directions) < sure else (low, middle)
    return high


class Tree:
    """A kd-tree over projections; leaves are runs of ``order`` with bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order, self.cuts = np.arange(len(points)), [0]
        pending = [(0, len(points))]
        while pending:
            start, stop = pending.pop()
            part = self.order[start:stop]
            if stop - start <= leaf:
                self.cuts.append(stop)
                continue
            axis = np.argmax(np.ptp(points[part], axis=0))
            middle = (stop - start) // 2
            self.order[start:stop] = part[np.argpartition(points[part, axis], middle)]
            # The lower half is next, so leaves come in order.
            pending += [(start + middle, stop), (start, start + middle)]
        self.cuts = np.array(self.cuts)
        ordered = points[self.order]
        self.low = np.minimum.reduceat(ordered, self.cuts[:-1])
        self.high = np.maximum.reduceat(ordered, self.cuts[:-1])

    def nearness(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of each leaf's box."""
        gap = np.maximum(0, np.maximum(self.low - point, point - self.high))
        return np.einsum("ij,ij->i", gap, gap)


def search(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, queries: np.ndarray, own: np.ndarray, count: int, sure: float = SURE) -> list[list[tuple[float, int]]]:
    """For each query up to ``count`` (cosine, place in ``ids``), best first, ties to the smaller id."""
    norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    unit = vectors / norm[:, None]
    directions = np.random.default_rng(SEED).standard_normal((vectors.shape[1], DIRECTIONS))
    tree, ratio = Tree(unit @ directions), stop_ratio(sure)
    vectors, norm, ids, rows = vectors[tree.order], norm[tree.order], ids[tree.order], rows[tree.order]
    found = []
    for query, row in zip(queries, own, strict=True):
        size = math.sqrt(np.einsum("i,i->", query, query))
        near = tree.nearness(query / size @ directions)
        ranked = np.argsort(near, kind="stable")
        cosine, place, at, step = np.zeros(0), np.zeros(0, np.int64), 0, 2
        while at < len(ranked):
            if len(cosine) == count:
                # Squared distance of unit vectors; rounding must not hide an equal one.
                farthest = max(0.0, 2 - 2 * cosine[-1]) + 1e-12
                if near[ranked[at]] > ratio * farthest:
                    break
            leaves = ranked[at : at + step]
            at, step = at + step, min(step * 2, 32)
            picked = np.concatenate([np.arange(tree.cuts[x], tree.cuts[x + 1]) for x in leaves])
            picked = picked[rows[picked] != row]
            exact = np.einsum("ij,j->i", vectors[picked], query) / (norm[picked] * size)
            cosine, place = np.r_[cosine, exact], np.r_[place, picked]
            best = np.lexsort((ids[place], -cosine))[:count]
            cosine, place = cosine[best], place[best]
        found.append([(float(c), int(tree.order[p])) for c, p in zip(cosine, place, strict=True)])
    return found


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    width = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, count: int = 5, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query, rank, neighbour, score: up to ``count`` rows for each row whose key ``every`` divides.

    Every other row of the table is a candidate, also one with the same key or
    vector.  Index and queries are dealt in blocks by hash; each pair of blocks
    is one task's work, and the blocks' results are ranked together.  Vectors
    that are null, empty, zero or hold null or non-finite components take no
    part; vectors of different lengths never meet; ties go to the smaller key,
    null keys last (and never queries).  Other columns are ignored.
    """
    wide = F.transform(F.col(vector), lambda x: x.cast("double"))
    base = vectors.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("key"), wide.alias("vector"))
    good = F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    base = base.where(good)
    sizes = base.agg(F.count("*"), F.count_if(F.col("key") % every == 0)).first()
    index_blocks, query_blocks = max(1, math.ceil(sizes[0] / block_rows)), max(1, math.ceil(sizes[1] / block_queries))

    def dealt(frame: DataFrame, own: str, blocks: int, other: str, times: int) -> DataFrame:
        return frame.withColumn("width", F.size("vector")).withColumn(own, F.pmod(F.xxhash64("row"), F.lit(blocks))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long"))))

    index = dealt(base, "i", index_blocks, "q", query_blocks)
    queries = dealt(base.where(F.col("key") % every == 0), "q", query_blocks, "i", index_blocks)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            keys = left.column("key").fill_null(np.iinfo(np.int64).max).to_numpy()
            null = left.column("key").is_null().to_numpy()
            asked, rows = right.column("key").to_numpy(), right.column("row").to_numpy()
            found = search(_matrix(left.column("vector")), keys, left.column("row").to_numpy(), _matrix(right.column("vector")), rows, count)
            out = [(int(rows[n]), int(asked[n]), None if null[p] else int(keys[p]), c) for n, hits in enumerate(found) for c, p in hits]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table({n: pa.array(c, k) for n, c, k in zip(("row", "query", "neighbour", "score"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)})

    keys = ("i", "q", "width")
    found = index.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(run, "row long, query long, neighbour long, score double")
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("neighbour"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).select("query", "rank", "neighbour", "score")
