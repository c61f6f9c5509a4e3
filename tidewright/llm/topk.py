"""Exact top-k search by an M-tree over pages of vectors, best node first."""

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytetext import give_back, tidy
from .store import save

TOP = 10
SCALE = 1024
#: Numbers in the vectors of a page, and queries that search a page together.
PAGE_NUMBERS, QUERY_ROWS = 1 << 19, 4096
#: Routing objects of the pages for one length of vector at most; they are a sample that comes to the driver. Larger pages are cut into parts.
PIVOTS = 1024
#: Vectors of a leaf, and children of an inner node.
LEAF, FAN = 256, 32
#: Squared length from which integer scores could overflow.
TOO_LONG = 2.0**62


class MTree:
    """A bulk-loaded M-tree over points of Euclidean space, kept as plain arrays so that it can be stored.

    A node keeps the distance of each entry to the node's own routing object,
    and for inner nodes the covering radius of each child. By the triangle
    inequality |d(q, parent) - d(parent, x)| bounds d(q, x) from below, so most
    distances are never computed.
    """

    def __init__(self, points: np.ndarray, seed: int = 3):
        self.points, self.rng = points, np.random.default_rng(seed)
        self.pivot = points.mean(axis=0)
        self.root = self._build(np.arange(len(points)), self.pivot)
        self.radius = float(np.linalg.norm(points - self.pivot, axis=1).max())
        del self.rng

    def _build(self, rows: np.ndarray, pivot: np.ndarray) -> dict:
        own = self.points[rows]
        if len(rows) <= LEAF:
            return {"rows": rows, "far": np.linalg.norm(own - pivot, axis=1)}
        centres = own[self.rng.choice(len(rows), min(FAN, 2 * math.ceil(len(rows) / LEAF)), replace=False)]
        for last in (False, False, True):
            nearest = np.argmin((centres**2).sum(axis=1) - 2 * own @ centres.T, axis=1)
            kinds = np.unique(nearest)
            if len(kinds) < 2:  # equal points
                nearest = np.arange(len(rows)) // LEAF
                kinds = np.unique(nearest)
            centres = np.stack([own[nearest == c].mean(axis=0) for c in kinds])
        parts = [rows[nearest == c] for c in kinds]
        radii = np.array([np.linalg.norm(self.points[p] - c, axis=1).max() for p, c in zip(parts, centres)])
        return {"centres": centres, "radii": radii, "far": np.linalg.norm(centres - pivot, axis=1), "children": [self._build(p, c) for p, c in zip(parts, centres)]}

    def nearest(self, query: np.ndarray, limit: float, offer) -> None:
        """Visit leaves in the order of their lower bounds; offer(rows) takes points and returns the distance beyond which none is wanted, limit at first."""
        ticket, slack = 0, 1e-9 * (1 + float(np.linalg.norm(query)) + self.radius + float(np.linalg.norm(self.pivot)))
        heap = [(0.0, 0, self.root, float(np.linalg.norm(query - self.pivot)))]
        while heap:
            bound, _, node, to_pivot = heapq.heappop(heap)
            if bound > limit + slack:
                return
            apart = np.abs(to_pivot - node["far"])
            if "rows" in node:
                rows = node["rows"][apart <= limit + slack]
                if len(rows):
                    limit = offer(rows)
                continue
            at = np.flatnonzero(apart - node["radii"] <= limit + slack)
            distance = np.linalg.norm(node["centres"][at] - query, axis=1)
            bounds = np.maximum(0, distance - node["radii"][at])
            for i, d, b in zip(at.tolist(), distance.tolist(), bounds.tolist()):
                if b <= limit + slack:
                    ticket += 1
                    heapq.heappush(heap, (b, ticket, node["children"][i], d))


def lifted(vectors: np.ndarray, most: float) -> np.ndarray:
    """One more component makes all vectors of squared length up to most equally long; then the largest inner product is the smallest distance."""
    points = vectors.astype(np.float64)
    return np.column_stack([points, np.sqrt(np.maximum(0, most - (points**2).sum(axis=1)))])


def reach(size: float, most: float, score: int) -> float:
    """How far from a query of squared length size a point may be whose inner product is score at least, and a little more for rounding."""
    return math.sqrt(max(0.0, size + most - 2.0 * score) + 1e-9 * (size + most))


def build(ids: np.ndarray, vectors: np.ndarray, most: float) -> bytes:
    order = np.argsort(ids, kind="stable")
    return pickle.dumps((ids[order], vectors[order], MTree(lifted(vectors[order], most))), protocol=5)


def search(tree: bytes, most: float, query_ids: np.ndarray, queries: np.ndarray, least: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, id, score): the k best inner products of each query in one page, ties to smaller ids and none to its own id.

    least: the k-th score that a query has already, or None; what can't reach it is left out. Scores are exact integers: sums of products stay
    below the product of the lengths, so doubles hold them up to 2**53, and 64-bit integers beyond.
    """
    ids, vectors, mtree = pickle.loads(tree)
    exact = vectors.astype(np.float64) if most < 2.0**53 else vectors
    out = [], [], []
    for place, (q, vector, known) in enumerate(zip(query_ids.tolist(), queries, least)):
        best: list[tuple[int, int]] = []  # (score, -id), worst first
        point = vector.astype(np.float64)
        size, other = float(point @ point), point if most < 2.0**53 else vector

        def limit():
            worst = best[0][0] if len(best) == k else None
            worst = known if worst is None else worst if known is None else max(worst, known)
            return math.inf if worst is None else reach(size, most, worst)

        def offer(rows):
            rows = rows[ids[rows] != q]
            scores = (exact[rows] @ other).astype(np.int64)
            if len(best) == k:
                good = scores >= best[0][0]
                rows, scores = rows[good], scores[good]
            elif len(rows) > k:
                good = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                rows, scores = rows[good], scores[good]
            for score, i in zip(scores.tolist(), ids[rows].tolist()):
                if len(best) < k:
                    heapq.heappush(best, (score, -i))
                elif (score, -i) > best[0]:
                    heapq.heapreplace(best, (score, -i))
            return limit()

        mtree.nearest(np.append(point, 0.0), limit(), offer)
        for score, i in best:
            out[0].append(place), out[1].append(-i), out[2].append(score)
    return tuple(np.array(x, np.int64) for x in out)


def usable(column: str):
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(True))


def _stacked(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def top_k(vectors: DataFrame, is_query, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """(vec_id, embedding) to query_id, rank, vec_id, score: each query's k highest integer inner products among all other ids.

    Components become floor(scale * x). Each row goes to the page of its nearest
    pivot (a sample of PIVOTS rows at most; it only shapes the pages), and each
    page gets one stored M-tree. A query first searches the page of its own
    nearest pivot; after that only the pages whose covering radius lets them
    beat its k-th score so far. The best of these pages are merged by query.
    Vectors that are null, empty, or hold null or non-finite components, take no
    part; those of other length than the query aren't compared with it; rows of
    equal vec_id are each a candidate, but never of a query of that id, and each
    asks for itself. Components so large that a score could pass 64 bits (squared
    length of 2**62 or more after scaling) raise an error. No vector, no row.
    """
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable("embedding") & F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    too_long = F.raise_error(F.lit("embedding too large for 64-bit integer scores")).cast("double")
    rows = rows.select("vec_id", whole.alias("v"), F.size("embedding").alias("dim")).withColumn("norm", F.when(norm < TOO_LONG, norm).otherwise(too_long))
    rows = save(rows.withColumn("asks", F.coalesce(is_query, F.lit(False))), "topk_rows")
    shapes, pivots = {}, {}
    for dim, n, most in rows.groupBy("dim").agg(F.count("*"), F.max("norm")).collect():  # one row for each length of vector
        shapes[dim] = (most, max(256, PAGE_NUMBERS // dim))
        sample = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(PIVOTS, -(-n // shapes[dim][1])))
        pivots[dim] = lifted(np.array([r.v for r in sample.select("v").collect()], np.float64).reshape(-1, dim), most)
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(pivots)

    def distances(dim, v):
        own, centres = lifted(v, shapes[dim][0]), shared.value[dim]
        return np.sqrt(np.maximum(0, (own**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * own @ centres.T))

    def by_dim(batch):
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            own = batch.filter(pa.array(dims == dim))
            yield dim, own, _stacked(own.column("v")).astype(np.float64)

    @tidy
    def to_page(batches):
        for batch in batches:
            for dim, own, v in by_dim(batch):
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("v"), own.column("dim"), pa.array(distances(dim, v).argmin(axis=1).astype(np.int32))], ["vec_id", "v", "dim", "page"])

    paged = save(rows.select("vec_id", "v", "dim").mapInArrow(to_page, "vec_id long, v array<long>, dim int, page int"), "topk_pages")
    parts = {(d, p): -(-n // shapes[d][1]) for d, p, n in paged.groupBy("dim", "page").count().collect()}  # PIVOTS rows for each length at most
    named = spark.createDataFrame([(d, p, n) for (d, p), n in parts.items()], "dim int, page int, parts int")
    part = F.floor(F.rand(11) * F.col("parts")).cast("int")
    paged = save(paged.join(F.broadcast(named), ["dim", "page"]).withColumn("part", part), "topk_parts")
    page = ["dim", "page", "part"]

    def plant(table: pa.Table) -> pa.Table:
        dim, number, piece = (table.column(c)[0].as_py() for c in page)
        v = _stacked(table.column("v"))
        far = float(np.linalg.norm(lifted(v, shapes[dim][0]) - shared.value[dim][number], axis=1).max())
        out = pa.table({"dim": pa.array([dim], pa.int32()), "page": pa.array([number], pa.int32()), "part": pa.array([piece], pa.int32()), "radius": [far], "tree": pa.array([build(table.column("vec_id").to_numpy(), v, shapes[dim][0])], pa.binary())})
        give_back()
        return out

    trees = save(paged.groupBy(*page).applyInArrow(plant, "dim int, page int, part int, radius double, tree binary"), "topk_trees")
    radii: dict = {d: np.full(len(c), -np.inf) for d, c in pivots.items()}
    sizes: dict = {d: np.zeros(len(c), np.int64) for d, c in pivots.items()}
    for d, p, radius in trees.groupBy("dim", "page").agg(F.max("radius")).collect():
        radii[d][p], sizes[d][p] = radius, parts[d, p]
    asked = save(rows.where("asks").select(F.monotonically_increasing_id().alias("q"), "vec_id", "v", "dim", "norm"), "topk_asked")

    def routed(queries: DataFrame, first: bool) -> DataFrame:
        """A row for each query and part of a page that it must search: the page of the nearest pivot, or all others within reach of its k-th score (least)."""

        @tidy
        def route(batches):
            for batch in batches:
                for dim, own, v in by_dim(batch):
                    d = distances(dim, v)
                    home = d.argmin(axis=1)
                    if first:
                        want = np.zeros(d.shape, bool)
                    else:
                        sizes_, most = own.column("norm").to_numpy(), shapes[dim][0]
                        bound = np.array([math.inf if s is None else reach(x, most, s) for x, s in zip(sizes_.tolist(), own.column("least").to_pylist())])
                        want = d - radii[dim] <= (bound * (1 + 1e-9) + 1e-9 * (1 + d.max(axis=1, initial=0.0)))[:, None]
                    want[np.arange(len(d)), home] = first
                    i, p = np.nonzero(want & (sizes[dim] > 0))
                    times = sizes[dim][p]
                    at, numbers = pa.array(np.repeat(i, times)), np.repeat(p, times)
                    piece = np.arange(len(numbers)) - np.repeat(np.cumsum(times) - times, times)
                    columns = [own.column(c).take(at) for c in ("q", "vec_id", "v", "dim", "least")]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers.astype(np.int32)), pa.array(piece.astype(np.int32))], ["q", "vec_id", "v", "dim", "least", "page", "part"])

        return queries.mapInArrow(route, "q long, vec_id long, v array<long>, dim int, least long, page int, part int")

    def searched(queries: DataFrame, name: str) -> DataFrame:
        queries = save(queries, f"{name}_queries")
        blocks = save(queries.groupBy(*page).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks")), f"{name}_blocks")
        left = trees.join(blocks, page).select(*page, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "tree")
        right = queries.join(blocks, page).withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int"))

        def meet(tree: pa.Table, asking: pa.Table) -> pa.Table:
            if not len(tree) or not len(asking):
                return pa.table({c: pa.array([], pa.int64()) for c in ("q", "query_id", "vec_id", "score")})
            dim, names, ids = tree.column("dim")[0].as_py(), asking.column("q").to_numpy(), asking.column("vec_id").to_numpy()
            place, found, score = search(tree.column("tree")[0].as_py(), shapes[dim][0], ids, _stacked(asking.column("v")), asking.column("least").to_pylist(), k)
            give_back()
            return pa.table({"q": names[place], "query_id": ids[place], "vec_id": found, "score": score})

        keys = [*page, "block"]
        return save(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "q long, query_id long, vec_id long, score long"), name)

    near = searched(routed(asked.withColumn("least", F.lit(None).cast("long")), True), "topk_near")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))
    kth = near.withColumn("rank", rank).where(F.col("rank") == k).select(F.col("q").alias("_q"), F.col("score").alias("least"))
    rest = searched(routed(asked.join(kth, F.col("q") == F.col("_q"), "left").drop("_q"), False), "topk_rest")
    return near.unionByName(rest).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


OP6_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 10
"""
