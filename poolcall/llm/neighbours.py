"""Approximate nearest neighbours: stable low-dimensional projections, kd-trees and a chi-square stopping test."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from poolcall.llm.common import arrow_schema, record_batch
from poolcall.session import cut

DIMENSIONS = 12  # of the projection; even, so the chi-square distribution has a closed form
CONFIDENCE = 0.98
CELL_ROWS = 2048
FIT_ROWS = 16_384  # vectors that place the splits between cells, about; every vector is indexed
LEAF_ROWS = 64
SEED = 20


def chi_square(x: float, m: int) -> float:
    """P(chi-square with ``m`` degrees, even, is at most ``x``)."""
    term, total = 1.0, 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_bound(p: float, m: int) -> float:
    low, high = 0.0, 10.0 * m + 200
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if chi_square(mid, m) >= p else (mid, high)
    return high


def split_tree(points: np.ndarray, depth: int, least: int = 8) -> list:
    """Nested (dimension, value, below, above); a leaf is None. Splits halve the widest dimension of the sample."""
    if not depth or len(points) < 2 * least:
        return None
    d = int(np.argmax(points.max(0) - points.min(0)))
    v = float(np.median(points[:, d]))
    left = points[:, d] < v
    if not left.any() or left.all():
        return None
    return (d, v, split_tree(points[left], depth - 1, least), split_tree(points[~left], depth - 1, least))


def leaves_of(tree, m: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Low and high corners of each cell, in the order of :func:`cell_of`."""
    def walk(t, low, high):
        if t is None:
            return [(low, high)]
        d, v, a, b = t
        mid_high, mid_low = high.copy(), low.copy()
        mid_high[d] = mid_low[d] = v
        return walk(a, low, mid_high) + walk(b, mid_low, high)
    return walk(tree, np.full(m, -np.inf), np.full(m, np.inf))


def cell_of(tree, points: np.ndarray) -> np.ndarray:
    def walk(t, rows, first):
        if t is None:
            out[rows] = first
            return first + 1
        d, v, a, b = t
        left = points[rows, d] < v
        return walk(b, rows[~left], walk(a, rows[left], first))
    out = np.zeros(len(points), np.int64)
    walk(tree, np.arange(len(points)), 0)
    return out


def box_distances(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances from a point to boxes."""
    return (np.maximum(np.maximum(low - q, q - high), 0) ** 2).sum(1)


class Block:
    """A kd-tree over the projections of one block of vectors, with the vectors themselves."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], projection: np.ndarray):
        self.vectors, self.ids = vectors, ids
        self.norms = np.sqrt((vectors * vectors).sum(1))
        self.points = (vectors / self.norms[:, None]) @ projection
        self.leaves = []
        stack = [np.arange(len(vectors))]
        while stack:
            rows = stack.pop()
            p = self.points[rows]
            if len(rows) <= LEAF_ROWS:
                self.leaves.append(rows)
                continue
            order = np.argsort(p[:, int(np.argmax(p.max(0) - p.min(0)))], kind="stable")
            stack += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
        self.low = np.array([self.points[r].min(0) for r in self.leaves])
        self.high = np.array([self.points[r].max(0) for r in self.leaves])

    def search(self, q: np.ndarray, projection: np.ndarray, k: int, bound: float, known: float = -2.0) -> list[tuple[float, int]]:
        """The ``k`` best (score, vec_id) of the block, ties to the smaller id.

        Leaves come by their distance in the projection. The search ends when, for the score that the k-th best so far has
        (``known`` counts as well), the chi-square test holds for all that is left: a vector as near as that would be
        projected this far away with a probability below one minus the confidence."""
        size = math.sqrt(float(q @ q))
        point = (q / size) @ projection
        far = box_distances(self.low, self.high, point)
        best: list[tuple[float, int]] = []
        for leaf in np.argsort(far, kind="stable").tolist():
            floor = max(known, best[k - 1][0] if len(best) >= k else -2.0)
            reach = bound * max(0.0, 2 - 2 * floor) if floor > -2 else math.inf
            if far[leaf] > reach + 1e-9:
                break
            rows = self.leaves[leaf]
            rows = rows[((self.points[rows] - point) ** 2).sum(1) <= reach + 1e-9]
            scores = (self.vectors[rows] @ q) / (self.norms[rows] * size)
            good = scores >= floor - 1e-9  # the same score may differ in the last digits between searches
            if good.any():
                best += [(float(s), i) for s, r in zip(scores[good], rows[good]) for i in self.ids[r]]
                best.sort(key=lambda x: (-x[0], x[1]))
                del best[k:]
        return best


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part, as doubles: an id, and a vector without null or non-finite components that is not zero."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))


def _stacked(column) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in column])


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, dimensions: int = DIMENSIONS, confidence: float = CONFIDENCE, cell_rows: int = CELL_ROWS,
            fit_rows: int = FIT_ROWS) -> DataFrame:
    """For each vec_id divisible by ``every`` the ``k`` nearest other rows by cosine: ``(query_id, rank, vec_id, score)``.

    ``vectors(vec_id, embedding)``; see :func:`usable` for rows that take no part. All vectors have the length of the
    commonest; rows of another length take no part. Ties go to the smaller vec_id; with fewer than ``k`` candidates all are returned.

    Equal vectors are one entry with its ``k + 1`` smallest ids, kept by a limit before the shuffle, so a very common
    vector is no hot key. Entries lie in cells of a kd-tree over the projection whose splits are placed by a bounded sample; a cell
    larger than ``cell_rows`` is dealt over blocks. A query first searches one block of its own cell. Its k-th score there bounds, by
    the chi-square test, how far in the projection a nearer vector may lie, and it then visits the blocks within."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out = "query_id bigint, rank int, vec_id bigint, score double"
    if common is None:
        return spark.createDataFrame([], out)
    width = common["d"]
    rows = rows.filter(F.size("v") == width)
    by_vector = W.partitionBy("v").orderBy("vec_id")
    entries = cut(rows.withColumn("n", F.row_number().over(by_vector)).filter(F.col("n") <= k + 1)
                  .groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).withColumn("entry", F.xxhash64("v", F.col("ids")[0])))
    asked = rows.filter(F.col("vec_id") % every == 0)
    named = cut(asked.distinct().join(entries.select("v", "entry"), "v").select(F.col("vec_id").alias("query_id"), "entry"))
    asking = entries.join(named.select("entry").distinct(), "entry", "left_semi").select("entry", "v")
    total = entries.count()
    projection = np.random.default_rng(SEED).standard_normal((width, dimensions))
    bound = chi_square_bound(confidence, dimensions)

    def place(v: np.ndarray) -> np.ndarray:
        return (v / np.sqrt((v * v).sum(1))[:, None]) @ projection

    span = 1 << 20
    sample = entries.filter(F.pmod(F.xxhash64(F.lit(4), "entry"), F.lit(span)) < min(span, -(-span * fit_rows // max(1, total)))).select("v").collect()
    tree = split_tree(place(_stacked([r["v"] for r in sample])), max(0, math.ceil(math.log2(max(1, total / cell_rows))))) if sample else None
    boxes = leaves_of(tree, dimensions)
    low, high = np.stack([b[0] for b in boxes]), np.stack([b[1] for b in boxes])
    blocks = max(1, -(-total // (len(boxes) * cell_rows)))

    put = "entry bigint, v array<double>, ids array<bigint>, cell bigint"
    put_schema = arrow_schema(put)

    def to_cells(batches):
        for b in batches:
            if b.num_rows:
                v = b.column(1).to_pylist()
                yield record_batch([b.column(0), v, b.column(2), cell_of(tree, place(_stacked(v)))], put_schema)

    indexed = cut(entries.select("entry", "v", "ids").mapInArrow(to_cells, put).withColumn("block", F.pmod(F.xxhash64(F.lit(6), "entry"), F.lit(blocks))))
    first = indexed.join(named.select("entry").distinct(), "entry", "left_semi").select(
        F.col("entry").alias("asker"), F.col("v").alias("vector"), F.lit(-2.0).alias("known"), F.col("cell").alias("at_cell"), F.col("block").alias("at_block"))

    def search(block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        made = []
        if len(block) and len(queries):
            index = Block(_stacked(block["v"]), [list(map(int, x)) for x in block["ids"]], projection)
            for entry, v, known in zip(queries["asker"], queries["vector"], queries["known"]):
                made += [(entry, s, i) for s, i in index.search(np.asarray(v, float), projection, k + 1, bound, known)]
        return pd.DataFrame(made, columns=["entry", "score", "vec_id"])

    found = "entry bigint, score double, vec_id bigint"
    home = cut(indexed.groupBy("cell", "block").cogroup(first.groupBy("at_cell", "at_block")).applyInPandas(search, found))
    reached = home.groupBy("entry").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
    known = asking.join(reached, "entry", "left").select("entry", "v", F.when(F.col("n") > k, F.col("worst")).otherwise(F.lit(-2.0)).alias("known"))
    visit = "asker bigint, vector array<double>, known double, at_cell bigint, at_block bigint"
    visit_schema = arrow_schema(visit)

    def visits(batches):
        for b in batches:
            e, v, s = [], [], []
            cells = []
            for entry, vec, score in zip(*(c.to_pylist() for c in b.columns)):
                reach = bound * max(0.0, 2 - 2 * score) if score > -2 else math.inf
                near = np.flatnonzero(box_distances(low, high, place(np.asarray([vec]))[0]) <= reach + 1e-9).tolist()
                for c in near:
                    for blk in range(blocks):
                        e.append(entry), v.append(vec), s.append(score), cells.append((c, blk))
            if e:
                yield record_batch([e, v, s, [c for c, _ in cells], [c for _, c in cells]], visit_schema)

    calls = known.mapInArrow(visits, visit)
    hits = indexed.groupBy("cell", "block").cogroup(calls.groupBy("at_cell", "at_block")).applyInPandas(search, found)
    order = [F.desc("score"), F.asc("vec_id")]
    hits = hits.unionAll(home).groupBy("entry", "vec_id").agg(F.max("score").alias("score"))  # what the first search found beyond the bound counts too
    best = hits.withColumn("n", F.row_number().over(W.partitionBy("entry").orderBy(*order))).filter(F.col("n") <= k + 1).drop("n")
    mine = named.join(best, "entry").filter("vec_id <> query_id")
    ranked = mine.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("int")).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
