"""Near-duplicate vectors by tiled comparison in the order of principal axes.

Two rows of one label link if the cosine of their vectors is at least
``COSINE``.  Unit vectors are turned onto the principal axes of all vectors, so
that their first coordinates hold as much of them as any can.  A turn changes no
product.  Tiles are compared a few coordinates at a time: the product so far plus
the product of the two lengths that are left (the suffix norms) bounds the
cosine, and a pair is given up as soon as the bound is below the threshold.

Which tiles meet.  A linked pair is at most ``reach`` = sqrt(2 - 2 COSINE) apart.
A label of more than ``TILE`` rows is halved at the median of the first axis, the
halves at that of the second, and so on, until cells hold about ``TILE`` rows.  A row is at
home in its cell and visits every later cell that a step of ``reach`` may enter;
the squared distances to the cuts crossed add up, so most cells are ruled out.
Each pair meets once, in the later cell.  Cells that cuts do not thin out (many
near copies) are dealt into shares by hash, and the rows that visit a share into chunks, so a
task never holds more than about ``TILE`` rows at home and ``GUESTS`` visitors.

What leaves a tile is a row per linked vector: how many it links to, and the smallest
vector of its group within the tile.  Those groups join into components; the
pairs are never written.  Equal vectors are one vector with a number of
copies throughout, so thousands of copies of one cost what one does.

Cuts and axes only decide where and how early a pair is tested: any others give the
same links.  Pairs within ``DOUBT`` of the threshold are decided by the cosine of
the given vectors as doubles.

Defined cases: a row whose label or vector is null, whose vector is empty, zero or
holds null, NaN or infinity links with nothing; vectors of different lengths do not link;
a row without ``vec_id`` has no links and null as its component and ``kept``; rows that share a
``vec_id`` are vectors of their own, and all carry their own component; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm.components import components
from txrisk.llm.metric_tree import matrix
from txrisk.session import fresh_path

COSINE = 0.98
TILE = 2048
GUESTS = 4096
LEAD = 8  # coordinates of the first step; each further step doubles them
BLOCK = 256  # rows of a tile that are compared at a time
DENSE = 0.05  # beyond this share of open pairs a step takes all products of the block
MOST_CUTS = 24
SLACK = 1e-9  # rounding of a bound
DOUBT = 1e-9


def _kept(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(spark, f"cosine-{name}")
    df.write.parquet(path)
    return spark.read.parquet(path)


def units(v: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component first becomes one, so that squares stay in range."""
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def classed(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v, size, h1, h2): ``v`` without negative zeros, null where a row takes no part; ``h1``, ``h2`` name it."""
    value = F.col("embedding")
    kind = embeddings.schema["embedding"].dataType.elementType.simpleString()
    kind = kind if kind in ("float", "double") else "double"  # stored as it came; products are in doubles
    fine = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fine &= F.exists(value, lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    v = F.when(F.coalesce(fine, F.lit(False)), F.transform(value, lambda x: x.cast(kind) + F.lit(0).cast(kind)))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "label", v.alias("v"))
    named = {"size": F.size("v"), "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")}
    return rows.withColumns(named)


def axes(vectors: DataFrame, width: int) -> np.ndarray:
    """The principal axes of all unit vectors as columns, largest first (``width`` x ``width``).

    Every task sums up its vectors' products; the sums of all tasks meet as one row per pair of coordinates.
    """
    upper = np.triu_indices(width)

    def run(batches):
        total = np.zeros((width, width))
        for batch in batches:
            x = units(matrix(batch.column("v"), width))
            total += x.T @ x
        yield pa.record_batch([pa.array(np.arange(len(upper[0]))), pa.array(total[upper])], ["at", "x"])

    sums = vectors.select("v").mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
    moment = np.zeros((width, width))
    at = sums.column("at").to_numpy()
    moment[upper[0][at], upper[1][at]] = moment[upper[1][at], upper[0][at]] = sums.column("x").to_numpy()
    return np.linalg.eigh(moment)[1][:, ::-1]


def reachable(x: np.ndarray, cuts: np.ndarray, depth: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home cell of each row, rows that visit, cells that they visit): later cells within ``reach``."""
    over = x[:, : len(cuts)] > cuts
    place = np.arange(len(cuts))
    used = place < depth[:, None]
    home = ((over & used) << place).sum(1)
    gap = np.where(used, (x[:, : len(cuts)] - cuts) ** 2, np.inf)
    row, cell, far = np.arange(len(x)), home.copy(), np.zeros(len(x))
    for k in range(len(cuts)):
        step = far + gap[row, k]
        on = step <= reach**2 + SLACK
        row, cell, far = np.concatenate([row, row[on]]), np.concatenate([cell, cell[on] ^ (1 << k)]), np.concatenate([far, step[on]])
    later = cell > home[row]
    return home, row[later], cell[later]


def linked(a: np.ndarray, b: np.ndarray, va: np.ndarray, vb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) whose cosine is at least the threshold.

    ``a`` and ``b`` are turned unit vectors, ``va`` and ``vb`` the vectors as given.
    """
    d = a.shape[1]
    edges = [0, min(LEAD, d)]
    while edges[-1] < d:
        edges.append(min(2 * edges[-1], d))
    rest = lambda x: [np.sqrt((x[:, e:] ** 2).sum(1)) for e in edges]
    ra, rb = rest(a), rest(b)
    p = a[:, : edges[1]] @ b[:, : edges[1]].T
    i, j = np.nonzero(p + ra[1][:, None] * rb[1] >= threshold - SLACK)
    s = p[i, j]
    for k, (low, high) in enumerate(zip(edges[1:], edges[2:], strict=False), 2):
        if len(i) == 0:
            return i, j
        if len(i) > DENSE * p.size:
            s = s + (a[:, low:high] @ b[:, low:high].T)[i, j]
        else:
            s = s + np.einsum("ij,ij->i", a[i, low:high], b[j, low:high])
        on = s + ra[k][i] * rb[k][j] >= threshold - SLACK
        i, j, s = i[on], j[on], s[on]
    good = s >= threshold
    doubt = np.flatnonzero(np.abs(s - threshold) <= DOUBT)
    if len(doubt):
        x, y = va[i[doubt]], vb[j[doubt]]
        good[doubt] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1))) >= threshold
    return i[good], j[good]


def groups_within(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest row of each row's group under the pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        for i, j in pairs:
            low = np.minimum(root[i], root[j])
            np.minimum.at(root, i, low)
            np.minimum.at(root, j, low)
            np.minimum.at(root, before[i], low)
            np.minimum.at(root, before[j], low)
        root = root[root]
        if (root == before).all():
            return root


def compare(turn: np.ndarray, threshold: float):
    """Of a tile's rows: (node, rows that it links to, smallest node of its group), for nodes with a link."""
    width = len(turn)

    def run(tile: pa.Table) -> pa.Table:
        order = np.argsort(tile.column("node").to_numpy())
        tile = tile.take(pa.array(order))
        v = matrix(tile.column("v").combine_chunks(), width)
        x = units(v) @ turn
        node, copies, guest = (tile.column(c).to_numpy() for c in ("node", "copies", "guest"))
        home, away = np.flatnonzero(~guest), np.flatnonzero(guest)
        inner = tile.column("chunk")[0].as_py() == 0 if tile.num_rows else False
        n, pairs = np.zeros(len(node), np.int64), []
        for at in range(0, len(home), BLOCK):
            some = home[at : at + BLOCK]
            others = np.concatenate([home[at:], away]) if inner else away
            i, j = linked(x[some], x[others], v[some], v[others], threshold)
            i, j = some[i], others[j]
            once = guest[j] | (i < j)
            i, j = i[once], j[once]
            n += np.bincount(i, copies[j], len(n)).astype(np.int64) + np.bincount(j, copies[i], len(n)).astype(np.int64)
            # a row's links within a block are one star: enough for the groups
            pairs.append(_stars(i, j))
        root = groups_within(len(node), [(i, j) for i, j in pairs if len(i)])
        has = np.flatnonzero(n)
        return pa.table({"node": node[has], "n": n[has], "root": node[root[has]]})

    return run


def _stars(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer pairs with the same groups: of pairs of rows of a small block with many, a forest."""
    if len(i) < 4 * BLOCK:
        return i, j
    rows, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    root = groups_within(len(rows), [(at[: len(i)], at[len(i) :])])
    return rows[root], rows


def places(nodes: DataFrame, turn: np.ndarray, cuts: np.ndarray, reach: float) -> DataFrame:
    """(node, label, size, copies, v, cell, guest): every row in its home cell and in the cells that it visits."""
    width = len(turn)
    names = ["node", "label", "size", "copies", "v"]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                x = units(matrix(batch.column("v"), width)) @ turn
                home, row, cell = reachable(x, cuts, batch.column("depth").to_numpy(), reach)
                row = np.concatenate([np.arange(len(home)), row])
                cell = np.concatenate([home, cell])
                cols = [batch.column(c).take(pa.array(row)) for c in names]
                guest = pa.array(np.arange(len(row)) >= len(home))
                yield pa.record_batch([*cols, pa.array(cell.astype(np.int64)), guest], [*names, "cell", "guest"])

    fields = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    schema = ", ".join([*[f"{n} {fields[n]}" for n in names], "cell long", "guest boolean"])
    return nodes.select(*names, "depth").mapInArrow(run, schema)


def medians(nodes: DataFrame, turn: np.ndarray, n: int) -> np.ndarray:
    """The middle of all rows on each of the first ``n`` axes."""
    if n == 0:
        return np.empty(0)
    width = len(turn)

    def run(batches):
        for batch in batches:
            x = units(matrix(batch.column("v"), width)) @ turn[:, :n]
            yield pa.record_batch([pa.array(c) for c in x.T], [f"c{k}" for k in range(n)])

    found = nodes.select("v").mapInArrow(run, ", ".join(f"c{k} double" for k in range(n)))
    return np.array(found.agg(*[F.percentile_approx(f"c{k}", 0.5, 1000) for k in range(n)]).first(), float)


def tiles(spark: SparkSession, nodes: DataFrame, turn: np.ndarray, threshold: float) -> DataFrame:
    """The rows of :func:`places` dealt into tiles (label, size, cell, share, chunk)."""
    rows = nodes.groupBy("label", "size").agg(F.count("*").alias("rows"))
    deep = F.least(F.ceil(F.log2(F.col("rows") / F.lit(float(TILE)))), F.lit(min(MOST_CUTS, len(turn))), F.col("size"))
    depths = _kept(spark, rows.select(F.col("label").alias("l0"), F.col("size").alias("s0"), F.greatest(deep, F.lit(0)).cast("int").alias("depth")), "depths")
    most = depths.agg(F.max("depth")).first()[0]
    placed = nodes.join(depths, (F.col("label") == F.col("l0")) & (F.col("size") == F.col("s0"))).drop("l0", "s0")
    placed = places(placed, turn, medians(nodes, turn, most), float(np.sqrt(2 - 2 * threshold)))
    if most == 0:  # every label is one tile, at most ``TILE`` rows
        return placed.withColumns({"share": F.lit(0), "chunk": F.lit(0)})
    placed = _kept(spark, placed, "placed")
    cells = placed.groupBy("label", "size", "cell").agg(F.count_if(~F.col("guest")).alias("home"), F.count_if("guest").alias("visits"))
    shares = F.greatest(F.ceil(F.col("home") / F.lit(float(TILE))), F.lit(1)).cast("int")
    visits = F.col("visits") + F.when(shares > 1, F.col("home")).otherwise(0)
    chunks = F.greatest(F.ceil(visits / F.lit(float(GUESTS))), F.lit(1)).cast("int")
    cells = cells.where("home > 0").select(
        F.col("label").alias("l0"), F.col("size").alias("s0"), F.col("cell").alias("c0"), shares.alias("shares"), chunks.alias("chunks")
    )
    same = (F.col("label") == F.col("l0")) & (F.col("size") == F.col("s0")) & (F.col("cell") == F.col("c0"))
    placed = placed.join(_kept(spark, cells, "cells"), same).drop("l0", "s0", "c0")
    own = F.pmod(F.xxhash64("node"), F.col("shares")).cast("int")
    mine = F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("chunks")).cast("int")
    spot = lambda share, chunk, guest: F.struct(share.alias("share"), chunk.alias("chunk"), guest.alias("guest"))
    every = F.sequence(F.lit(0), F.col("shares") - 1)
    at_home = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: spot(own, c, F.lit(False)))
    above = F.transform(F.filter(every, lambda s: s > own), lambda s: spot(s, mine, F.lit(True)))
    abroad = F.transform(every, lambda s: spot(s, mine, F.lit(True)))
    spots = F.when(F.col("guest"), abroad).otherwise(F.concat(at_home, above))
    return placed.withColumn("spot", F.explode(spots)).select("node", "label", "size", "copies", "v", "cell", "spot.*")


def near_duplicates(spark: SparkSession, embeddings: DataFrame, threshold: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label)."""
    found = classed(embeddings)
    alike = found.where("v is not null").groupBy("label", "size", "h1", "h2", "v")
    nodes = alike.agg(F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    nodes = _kept(spark, nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n, width = nodes.agg(F.count("*"), F.max("size")).first()
    schema = "node long, n long, root long"
    if n > 1:
        turn = axes(nodes, width)
        dealt = tiles(spark, nodes, turn, threshold)
        met = dealt.groupBy("label", "size", "cell", "share", "chunk").applyInArrow(compare(turn, threshold), schema)
        met = _kept(spark, met, "met")
    else:
        met = spark.createDataFrame([], schema)
    links = met.groupBy("node").agg(F.sum("n").alias("linked"))
    root = components(spark, met.select(F.col("node").alias("x"), F.col("root").alias("y")))
    whose = nodes.select("node", "label", "size", "h1", "h2", "copies", "first").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whose = _kept(spark, whose.join(links, "node", "left"), "whose")
    least = _kept(spark, whose.groupBy(F.col("root").alias("r0")).agg(F.min("first").alias("component_id")), "least")
    named = whose.join(least, F.col("root") == F.col("r0")).select(
        F.col("label").alias("l0"), F.col("h1").alias("g1"), F.col("h2").alias("g2"),
        (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id",
    )
    named = _kept(spark, named, "named")  # written first, as is the one before: Spark splits hot keys of a join of tables
    out = found.select("vec_id", "label", F.col("v").isNotNull().alias("part"), "h1", "h2")
    mine = F.col("part") & (F.col("label") == F.col("l0")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    out = out.join(named, mine, "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op13_pca_tiled_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all ``embeddings`` within their labels."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.y, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(c.y, vec_id)) AS kept
FROM embeddings e LEFT JOIN n ON n.x = e.vec_id LEFT JOIN c ON c.x = e.vec_id
"""
