"""Exact top-k inner products by best-first search of M-trees.

Inner products become distances: with ``B`` the largest squared length, a
vector x is seen as (x, sqrt(B - |x|^2)) and a query q as (q, 0); their squared
distance is |q|^2 + B - 2 q.x, so the nearest vector has the largest product.

The tree is paged.  Its top page is a table of at most ``TOP`` routing vectors
with the covering radius and size of their subtrees; every vector is in the
subtree of the nearest one.  A subtree of more than ``PAGE_ROWS`` vectors is cut
into shares by hash.  A share is one task's group: it builds an M-tree whose
leaf pages hold ``LEAF`` vectors, with the routing vector, covering radius and
distance to the parent of every page and the distance to the page's routing
vector of every vector.

A query first searches one share of its nearest subtree, which bounds its k-th
distance, then all others whose radius does not rule them out.  Inside a share
pages are taken best first; a page or vector is skipped without computing a
distance if the stored distances and the triangle inequality place it beyond
the k-th best.  Scores are exact integers; comparisons of distances leave
``SLACK`` for rounding.  The queries that visit a share are counted first and dealt in
blocks of ``QUERY_ROWS``, so no group grows with the input, and a share is copied
only as often as it has blocks of visitors; shares without visitors are not moved.

Of equal vectors only those with the k + 1 smallest ids, and k rows of each id,
can be among the best k; the others are left out before the search.

Defined cases: vectors that are null or hold null or non-finite components take
no part, neither does a null ``vec_id``; shorter vectors count as filled up with
zeros; rows with the same ``vec_id`` are no candidates for each other; an empty
table gives no rows.  Products that could reach 2**53 are an error.  Extra columns are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.session import fresh_path

K = 5
TOP = 4096
PAGE_ROWS = 1024
LEAF = 64
QUERY_ROWS = 4096
SLACK = 1e-6


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of integer lists as rows of ``width`` numbers."""
    n = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    flat = column.values.to_numpy()[column.offsets[0].as_py() :] if len(column) else np.empty(0)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = flat[: len(row)]
    return out


def lifted(x: np.ndarray, bound: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(0.0, bound - (x * x).sum(1, keepdims=True)))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


class MTree:
    """Pages of vectors below one root page.  ``points``: lifted vectors."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        n = len(points)
        pages = -(-n // LEAF)
        # routing vectors far from each other, beginning with the one furthest from the middle
        middle = points.mean(0, keepdims=True)
        chosen = [int(distances(points, middle)[:, 0].argmax())]
        near = distances(points, points[chosen])[:, 0]
        while len(chosen) < pages and near.max() > 0:
            chosen.append(int(near.argmax()))
            near = np.minimum(near, distances(points, points[chosen[-1:]])[:, 0])
        self.routing = points[chosen]
        all_ = distances(points, self.routing)
        page = all_.argmin(1)
        self.root = self.routing[:1]
        self.to_parent = distances(self.routing, self.root)[:, 0]
        self.leaves = []
        for p in range(len(chosen)):
            at = np.flatnonzero(page == p)
            order = at[np.argsort(all_[at, p], kind="stable")]
            self.leaves.append((points[order], ids[order], vectors[order], all_[order, p]))
        self.radius = np.array([leaf[3].max() if len(leaf[3]) else 0.0 for leaf in self.leaves])

    def search(self, query: np.ndarray, own: int, k: int, limit: float) -> list[tuple[int, int]]:
        """(score, id) of the best k vectors of other ids within ``limit`` of a lifted query."""
        best: list[tuple[float, int, int]] = []  # (-distance, -id, score), a heap with the worst on top
        to_root = float(np.sqrt(((query - self.root[0]) ** 2).sum()))
        bound = np.abs(to_root - self.to_parent) - self.radius  # no distance to the pages is computed yet
        queue = [(max(0.0, float(b)), p, False) for p, b in enumerate(bound) if b <= limit + SLACK and len(self.leaves[p][1])]
        heapq.heapify(queue)
        to_page = {}
        while queue:
            low, p, known = heapq.heappop(queue)
            if low > limit + SLACK:
                break
            if not known:
                d = to_page[p] = float(np.sqrt(((query - self.routing[p]) ** 2).sum()))
                heapq.heappush(queue, (max(low, d - self.radius[p]), p, True))
                continue
            points, ids, vectors, to_routing = self.leaves[p]
            a, b = np.searchsorted(to_routing, [to_page[p] - limit - SLACK, to_page[p] + limit + SLACK])
            if a == b:
                continue
            score = vectors[a:b] @ query[:-1]
            d = np.sqrt(np.maximum(0.0, ((query - points[a:b]) ** 2).sum(1)))
            for i in np.flatnonzero(d <= limit + SLACK).tolist():
                if ids[a + i] == own:
                    continue
                entry = (int(score[i]), -int(ids[a + i]))
                if len(best) < k:
                    heapq.heappush(best, (*entry, d[i]))
                elif entry > best[0][:2]:
                    heapq.heapreplace(best, (*entry, d[i]))
                if len(best) == k:
                    limit = min(limit, max(x[2] for x in best))
        return [(s, -i) for s, i, _ in sorted(best, reverse=True)]


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): vectors with components floor(256 * x)."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & good)
    return rows.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(256 * x.cast("double"))).alias("v"))


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query (vec_id, v)."""
    path = fresh_path(spark, "vectors")
    one = Window.partitionBy("v", "vec_id").orderBy("vec_id")
    first = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.withColumn("r", F.row_number().over(one)).where(F.col("r") <= k)
    few.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= k + 1).drop("r").write.parquet(path)
    rows = spark.read.parquet(path)
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, bound, width = rows.agg(F.count("*"), F.max(square), F.max(F.size("v"))).first()
    n_queries, q_width, q_bound = queries.agg(F.count("*"), F.max(F.size("v")), F.max(square)).first()
    result = "query_id long, vec_id long, score long"
    if not n or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if bound * q_bound >= 2.0**106:
        raise ValueError("inner products may reach 2**53, beyond which they are not exact")
    width = max(width, q_width)
    top = min(TOP, -(-2 * n // PAGE_ROWS))
    chosen = rows.orderBy(F.xxhash64("v"), "vec_id").limit(top).select("v").distinct().collect()
    routing = lifted(np.array([r["v"] + [0] * (width - len(r["v"])) for r in chosen], float), bound)

    def assign(batches):
        for batch in batches:
            d = distances(lifted(matrix(batch.column("v"), width), bound), routing)
            cell = d.argmin(1)
            yield pa.record_batch([pa.array(cell), pa.array(d[np.arange(len(d)), cell]), batch.column("vec_id"), batch.column("v")], ["cell", "d", "vec_id", "v"])

    path = fresh_path(spark, "cells")
    rows.mapInArrow(assign, "cell long, d double, vec_id long, v array<long>").write.parquet(path)
    cells = spark.read.parquet(path)
    size, radius = np.zeros(len(routing), np.int64), np.zeros(len(routing))
    for cell, m, r in cells.groupBy("cell").agg(F.count("*"), F.max("d")).collect():  # a row per routing vector
        size[cell], radius[cell] = m, r
    shares = np.maximum(1, -(-size // PAGE_ROWS))
    n_shares = F.element_at(F.array(*[F.lit(int(s)) for s in shares]), (F.col("cell") + 1).cast("int"))
    cells = cells.select("cell", F.pmod(F.xxhash64("vec_id"), n_shares).alias("share"), "vec_id", "v")
    asked = queries.select("vec_id", "v")
    places = pa.schema([("cell", pa.int64()), ("share", pa.int64()), ("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("limit", pa.float64())])

    def deal(visit):
        """Rows (cell, share, vec_id, v, limit) for the shares that ``visit(row of distances, limit)`` names."""

        def run(batches):
            for batch in batches:
                q = np.hstack([matrix(batch.column("v"), width), np.zeros((batch.num_rows, 1))])
                limits = batch.column("limit").to_numpy()
                d = distances(q, routing)
                for i in range(batch.num_rows):
                    cell, share = visit(d[i], limits[i])
                    row = pa.array(np.full(len(cell), i))
                    cols = [batch.column(c).take(row) for c in ("vec_id", "v", "limit")]
                    yield pa.record_batch([pa.array(cell), pa.array(share), *cols], schema=places)

        return run

    def nearest(d, limit):
        full = np.flatnonzero(size)
        return full[[d[full].argmin()]], np.array([0])

    def others(d, limit):
        first_cell = nearest(d, limit)[0][0]
        near = np.flatnonzero((d - radius <= limit + SLACK) & (size > 0))
        cell = np.repeat(near, shares[near])
        share = np.arange(len(cell)) - np.repeat(np.cumsum(shares[near]) - shares[near], shares[near])
        rest = (cell != first_cell) | (share != 0)
        return cell[rest], share[rest]

    def look(own: pa.Table, asking: pa.Table) -> pa.Table:
        out = []
        if own.num_rows and asking.num_rows:
            x = matrix(own.column("v").combine_chunks(), width)
            tree = MTree(lifted(x, bound), own.column("vec_id").to_numpy(), x)
            q = np.hstack([matrix(asking.column("v").combine_chunks(), width), np.zeros((asking.num_rows, 1))])
            for i, (query, limit) in enumerate(zip(asking.column("vec_id").to_pylist(), asking.column("limit").to_pylist(), strict=True)):
                out += [(query, v, s) for s, v in tree.search(q[i], query, k, limit)]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3, ["query_id", "vec_id", "score"])

    place = ["cell", "share"]
    key = [*place, "block"]

    def visit(queries_: DataFrame, how) -> DataFrame:
        dealt = queries_.mapInArrow(deal(how), "cell long, share long, vec_id long, v array<long>, limit double")
        path = fresh_path(spark, "visits")
        blocks = F.ceil(F.count("*") / F.lit(float(QUERY_ROWS))).cast("int").alias("blocks")
        dealt.groupBy(*place).agg(blocks).write.parquet(path)  # a row per share that has visitors
        visited = spark.read.parquet(path)
        own = cells.join(visited, place).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        asking = dealt.join(visited, place).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
        own, asking = own.drop("blocks"), asking.drop("blocks")
        return own.groupBy(*key).cogroup(asking.groupBy(*key)).applyInArrow(look, result)

    path = fresh_path(spark, "first-search")
    visit(asked.withColumn("limit", F.lit(float("inf"))), nearest).write.parquet(path)
    found = spark.read.parquet(path)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    last = found.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("worst"))
    own = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    limit = F.sqrt(F.greatest(own + F.lit(float(bound)) - 2.0 * F.col("worst"), F.lit(0.0)))
    asked = asked.join(last, "vec_id", "left").select("vec_id", "v", F.coalesce(limit, F.lit(float("inf"))).alias("limit"))
    everything = found.union(visit(asked, others))
    ranked = everything.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op2_metric_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best vectors of all ``embeddings`` for each whose id is divisible by 50."""
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(spark, vectors, vectors.where("vec_id % 50 = 0").dropDuplicates(["vec_id", "v"]))


SQL = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
