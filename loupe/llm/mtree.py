"""Exact top-k inner-product search with an M-tree.

Vectors become integers floor(scale * x).  The tree has routing objects chosen from a
bounded sample (a node splits while the vectors expected in it exceed a slice, so the tree
grows with the table), their pages (rows of an index table:
routing object, covering radius, distance to the parent routing object, and the
entries with their distances to the page's object), and the entries.  Every vector is
indexed.  For a query q, an object c and anything x within distance r of c,
q.x <= q.c + |q| r, so stored distances bound a score before it is computed: a routing
object's and a page's by its parent's product, then by its own, then each entry's.

Queries are searched best first in two passes.  The first takes each query down the
tree by the best bound, visits that leaf's pages in the order of their bounds, and so
finds k candidates whose worst score cuts; the second takes it to the leaves whose
bound reaches that score, again best page first, and stops at the first page that
can't.  Leaves with many vectors are dealt into slices of bounded size, so copies of one
vector don't meet in one task; queries of a slice come in blocks.

Scores are exact: floats where all products stay under 2^53, 64-bit integers under 2^63,
Python's integers beyond, cut to a long's range.  Bounds get a slack for their rounding.

Vectors that are null, or that hold nulls or non-finite numbers take no part; each
dimension is searched among itself, one after the other (empty vectors all have the score 0).  Rows with a null id take no part.  Ties
go to the smaller id; repeated rows with one id count as separate candidates, except
that a query never meets rows of its own id.  Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import dataclasses
import functools
import heapq
import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import scratch, stored

SCALE = 256
#: Routing objects of the top node and of the others, drawn from a sample of at most so many vectors.
NODES, FAN, SAMPLE = 128, 16, 20_000
PAGE, SLICE, QUERY_BLOCK = 64, 4096, 2048
_LARGEST = (1 << 63) - 1


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dim)


def integer_vectors(table: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """id and v (array<double> of whole numbers) of the rows that take part."""
    x = F.col(vec_col)
    sound = x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    rows = table.where(F.col(id_col).isNotNull() & sound)
    top = F.lit(sys.float_info.max)

    def whole(e: Column) -> Column:
        y = F.greatest(F.least(e.cast("double") * scale, top), -top)
        return F.when(F.abs(y) < 1 << 53, F.floor(y).cast("double")).otherwise(y)  # larger ones are whole, and may not fit a long

    return rows.select(F.col(id_col).cast("long").alias("id"), F.transform(x, whole).alias("v"))


def _choose(vectors: np.ndarray, n: int) -> np.ndarray:
    """n far-apart objects: each next one is the farthest from those before."""
    chosen = [0]
    gap = ((vectors - vectors[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(vectors)):
        far = int(gap.argmax())
        if gap[far] <= 0:
            break
        chosen.append(far)
        gap = np.minimum(gap, ((vectors - vectors[far]) ** 2).sum(1))
    return vectors[chosen]


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances."""
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x @ c.T, 0))


@dataclasses.dataclass
class Routes:
    """The routing objects; node k's parent is ``parent[k]`` (-1: the top), leaves have no children."""

    objects: np.ndarray
    parent: np.ndarray
    d_parent: np.ndarray
    children: dict[int, np.ndarray]
    scale: Scale

    @classmethod
    def choose(cls, sample: np.ndarray, n: int, scale: Scale) -> Routes:
        """A node splits while more than SLICE of the n vectors are expected in it and the sample still tells them apart."""
        objects, parent, d_parent, children = [], [], [], {}
        todo = [(-1, np.arange(len(sample)))]
        while todo:
            above, rows = todo.pop(0)
            chosen = _choose(sample[rows], NODES if above < 0 else FAN)
            if above >= 0 and len(chosen) < 2:
                continue
            children[above] = np.arange(len(objects), len(objects) + len(chosen))
            d_parent += _distances(chosen, objects[above][None])[:, 0].tolist() if above >= 0 else [0.0] * len(chosen)
            near = _distances(sample[rows], chosen).argmin(1)
            for k, node in enumerate(children[above].tolist()):
                mine = rows[near == k]
                if len(mine) * n > SLICE * len(sample) and len(mine) >= 2 * FAN:
                    todo.append((node, mine))
            objects += list(chosen)
            parent += [above] * len(chosen)
        return cls(np.array(objects), np.array(parent), np.array(d_parent), children, scale)

    def path(self, node: int) -> list[int]:
        """The node and those above it, the top one first."""
        return [] if node < 0 else [*self.path(int(self.parent[node])), node]

    def descend(self, x: np.ndarray) -> tuple[np.ndarray, list[list[float]]]:
        """Each vector's leaf, going to the nearest object, and its distances to the objects on the way."""
        node, ways = np.full(len(x), -1), [[] for _ in range(len(x))]
        todo = [(-1, np.arange(len(x)))]
        while todo:
            above, rows = todo.pop()
            below = self.children[above]
            d = _distances(x[rows], self.objects[below])
            best = d.argmin(1)
            node[rows] = below[best]
            for row, gap in zip(rows.tolist(), d[np.arange(len(rows)), best].tolist(), strict=True):
                ways[row].append(gap)
            todo += [(k, rows[best == j]) for j, k in enumerate(below.tolist()) if k in self.children and (best == j).any()]
        return node, ways


@dataclasses.dataclass
class Scale:
    """How numbers of a table are handled: geometry works on vectors times 2^-shift, scores on the numbers themselves."""

    dim: int
    largest: float

    @property
    def shift(self) -> int:
        return max(0, math.frexp(self.largest)[1] - 31)

    def small(self, v: np.ndarray) -> np.ndarray:
        return np.ldexp(v, -self.shift)

    def cut(self, floor: float) -> float:
        """A score in the geometry's unit, rounded down."""
        return floor if math.isinf(floor) else math.floor(floor) / (1 << 2 * self.shift) if self.shift < 400 else -math.inf

    def slack(self, norm: np.ndarray) -> np.ndarray:
        """What rounding may take from a bound of queries with this norm: scores are whole, and squares under 2^53 exact."""
        top = math.ldexp(self.largest, -self.shift)
        exact = self.shift == 0 and 4 * self.dim * top * top < 1 << 53
        return np.full(len(norm), 0.5) if exact else 0.5 + 1e-6 * norm * math.sqrt(self.dim) * top

    def scores(self, vectors: np.ndarray, q: np.ndarray) -> list[int]:
        products = self.dim * self.largest**2 if self.largest < 1e150 else math.inf
        if products < 1 << 53:
            return (vectors @ q).astype(np.int64).tolist()
        if products < _LARGEST:
            return (vectors.astype(np.int64) @ q.astype(np.int64)).tolist()
        mine = list(map(int, q.tolist()))
        return [max(-_LARGEST, min(_LARGEST, sum(int(a) * b for a, b in zip(row, mine, strict=True)))) for row in vectors.tolist()]


def _assign(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes: Routes = handle.value
        for batch in batches:
            if batch.num_rows:
                node, ways = routes.descend(routes.scale.small(_vectors(batch.column(1), routes.scale.dim)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node.astype(np.int32)), pa.array(ways, pa.list_(pa.float64()))], names=["id", "v", "node", "ways"])

    return run


_PAGE = "node int, slice int, page int, n int, d_parent double, radius double, object binary, ids binary, vectors binary, distances binary"


def _build_pages(handle):
    """Pages of one slice: entries near each other, found by splitting at the object farthest from the page's own."""

    def run(table: pa.Table) -> pa.Table:
        table, routes = table.combine_chunks(), handle.value
        ids, whole = table.column("id").to_numpy(), _vectors(table.column("v").combine_chunks(), routes.scale.dim)
        v = routes.scale.small(whole)
        parent = routes.objects[table.column("node")[0].as_py()]
        groups, done = [np.lexsort((ids,))], []
        while groups:
            g = groups.pop()
            if len(g) <= PAGE:
                done.append(g)
                continue
            a = v[g[0]]
            far = g[int(((v[g] - a) ** 2).sum(1).argmax())]
            pair = np.stack([v[far], v[g[int(((v[g] - v[far]) ** 2).sum(1).argmax())]]])
            side = np.diff(_distances(v[g], pair), axis=1)[:, 0]
            near = np.argsort(side, kind="stable")  # halves, so ties (copies) can't make a page too large
            groups += [g[near[: len(g) // 2]], g[near[len(g) // 2 :]]]
        rows = []
        for number, g in enumerate(done):
            center = v[g].mean(0)
            g = g[np.argsort(((v[g] - center) ** 2).sum(1), kind="stable")]
            obj = v[g[0]]  # the entry nearest to the middle
            d = _distances(v[g], obj[None])[:, 0]
            rows.append((number, len(g), float(_distances(obj[None], parent[None])[0, 0]), float(d.max()), obj.tobytes(), ids[g].tobytes(), whole[g].tobytes(), d.tobytes()))
        node, part = table.column("node")[0].as_py(), table.column("slice")[0].as_py()
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int32(), pa.int32(), pa.float64(), pa.float64(), *[pa.binary()] * 4]
        return pa.table([pa.array([node] * len(rows), pa.int32()), pa.array([part] * len(rows), pa.int32()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["node", "slice", "page", "n", "d_parent", "radius", "object", "ids", "vectors", "distances"])

    return run


def build_index(vectors: DataFrame, n: int, scale: Scale) -> tuple[DataFrame, Routes, np.ndarray, dict[int, int]]:
    """The page table (every vector is in one page), the routing objects, their covering radii and the leaves' numbers of slices."""
    spark = vectors.sparkSession
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()  # fits routing objects only
    routes = Routes.choose(scale.small(np.stack([np.asarray(x) for x in sample["v"].to_pylist()])), n, scale)
    handle = spark.sparkContext.broadcast(routes)
    assigned = stored(vectors.mapInArrow(_assign(handle), "id long, v array<double>, node int, ways array<double>"), "mtree-assigned")
    depth = max(len(routes.path(k)) for k in range(len(routes.parent)))
    slices = F.ceil(F.count("*") / SLICE).cast("int").alias("slices")
    leaves = stored(assigned.groupBy("node").agg(slices, *(F.max(F.get("ways", F.lit(k))).alias(f"far{k}") for k in range(depth))), "mtree-leaves")
    radii, parts = np.full(len(routes.parent), -np.inf), {}
    for r in leaves.collect():  # fewer rows than the sample
        parts[r["node"]] = r["slices"]
        for k, node in enumerate(routes.path(r["node"])):
            radii[node] = max(radii[node], r[f"far{k}"])
    dealt = assigned.join(F.broadcast(leaves.select("node", "slices")), "node").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    pages = dealt.select("id", "v", "node", "slice").groupBy("node", "slice").applyInArrow(_build_pages(handle), _PAGE)
    return stored(pages, "mtree-pages"), routes, radii, parts


class _Best:
    """A query's k best (score, then smaller id) so far."""

    def __init__(self, k: int, floor: float | int):
        self.k, self.floor, self.heap = k, floor, []

    def cut(self) -> float:
        return max(self.floor, self.heap[0][0]) if len(self.heap) == self.k else self.floor

    def add(self, score: int, vec_id: int) -> None:
        item = (score, -vec_id)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, item)
        elif item > self.heap[0]:
            heapq.heapreplace(self.heap, item)


def _search(handle, k: int):
    """One slice's pages and one block of queries -> each query's k best of the slice with at least its floor."""

    def run(pages: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if pages.num_rows and queries.num_rows:
            routes: Routes = handle.value
            scale = routes.scale
            parent = routes.objects[pages.column("node")[0].as_py()]
            objects = np.stack([np.frombuffer(x, float) for x in pages.column("object").to_pylist()])
            radius, d_parent = pages.column("radius").to_numpy(), pages.column("d_parent").to_numpy()
            entries = [None] * pages.num_rows
            stores = [pages.column(c).to_pylist() for c in ("ids", "vectors", "distances")]
            q_ids, floors = queries.column("id").to_numpy(), queries.column("floor").to_pylist()
            whole = _vectors(queries.column("v").combine_chunks(), scale.dim)
            q = scale.small(whole)
            norm = np.sqrt((q**2).sum(1))
            slack = scale.slack(norm)
            by_parent = (q @ parent)[:, None] + norm[:, None] * (d_parent + radius)[None]  # no page's object is read yet
            for i in range(len(q)):
                best = _Best(k, -math.inf if floors[i] is None else floors[i])
                maybe = np.flatnonzero(by_parent[i] + slack[i] >= scale.cut(best.cut()))
                bound = objects[maybe] @ q[i] + norm[i] * radius[maybe]
                heap = [(-b, int(p)) for b, p in zip(np.minimum(bound, by_parent[i][maybe]).tolist(), maybe.tolist(), strict=True)]
                heapq.heapify(heap)
                while heap:
                    b, page = heapq.heappop(heap)
                    cut = scale.cut(best.cut())
                    if -b + slack[i] < cut:
                        break
                    if entries[page] is None:
                        ids, vectors, distances = (s[page] for s in stores)
                        entries[page] = (np.frombuffer(ids, np.int64), np.frombuffer(vectors, float).reshape(-1, scale.dim), np.frombuffer(distances, float))
                    ids, vectors, distances = entries[page]
                    center = float(objects[page] @ q[i])
                    open_ = np.flatnonzero((center + norm[i] * distances + slack[i] >= cut) & (ids != q_ids[i]))
                    for s, x in zip(scale.scores(vectors[open_], whole[i]), ids[open_].tolist(), strict=True):
                        if s >= best.cut():
                            best.add(s, x)
                out += [(int(q_ids[i]), -x, s) for s, x in best.heap]
        columns = list(zip(*out, strict=True)) if out else [[]] * 3
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return run


def _leaves(routes: Routes, radii: np.ndarray, q: np.ndarray, norm: np.ndarray, least: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(query, leaf) pairs: the leaf that the best bounds lead to, or (with ``least``) all leaves whose bound reaches it."""
    rows, above = np.arange(len(q)), np.full(len(q), -1)
    product = np.zeros(len(q))
    found = []
    while len(rows):
        n_below = np.array([len(routes.children[k]) for k in above.tolist()])
        node = np.concatenate([routes.children[k] for k in above.tolist()])
        row, up, product = np.repeat(rows, n_below), np.repeat(above, n_below), np.repeat(product, n_below)
        open_ = ~np.isneginf(radii[node])
        if least is not None:  # the parent's product decides most, before a child's is computed
            open_ &= (up < 0) | (product + norm[row] * (routes.d_parent[node] + radii[node]) >= least[row])
        row, node = row[open_], node[open_]
        product = np.concatenate([(q[row[k : k + 65536]] * routes.objects[node[k : k + 65536]]).sum(1) for k in range(0, len(row), 65536)] or [np.zeros(0)])
        bound = product + norm[row] * radii[node]
        if least is None:
            order = np.lexsort((-bound, row))
            keep = order[np.append(True, row[order][1:] != row[order][:-1])] if len(order) else order
        else:
            keep = np.flatnonzero(bound >= least[row])
        row, node, product = row[keep], node[keep], product[keep]
        leaf = np.array([k not in routes.children for k in node.tolist()], bool)
        found.append((row[leaf], node[leaf]))
        rows, above, product = row[~leaf], node[~leaf], product[~leaf]
    return np.concatenate([r for r, _ in found]), np.concatenate([k for _, k in found])


def _bounds(handle, radii: np.ndarray, first: bool):
    """Rows (id, v, floor) -> a row for the leaf that the best bounds lead to, or for each other leaf whose bound reaches the floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        routes: Routes = handle.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q = routes.scale.small(_vectors(batch.column(1), routes.scale.dim))
            norm = np.sqrt((q**2).sum(1))
            row, node = _leaves(routes, radii, q, norm, None)
            if not first:
                best = np.full(len(q), -1)
                best[row] = node
                floors = [-math.inf if x is None else routes.scale.cut(x) for x in batch.column(2).to_pylist()]
                row, node = _leaves(routes, radii, q, norm, np.array(floors) - routes.scale.slack(norm))
                other = node != best[row]
                row, node = row[other], node[other]
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(row)).columns, pa.array(node.astype(np.int32))], names=["id", "v", "floor", "node"])

    return run


def search(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score: the k vectors of highest inner product, all against all, own ids excluded.

    queries and vectors: id and v as ``integer_vectors`` gives them.  The result is a stored table; what was stored on the way is deleted.
    """
    with scratch() as kept:
        return kept(_search_all(queries, vectors, k), "mtree-found")


def _search_all(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    size = F.size("v")
    dims = vectors.groupBy(size.alias("dim")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("largest")).collect()  # a row a dimension
    found = [_search_dimension(*(x.where(size == r["dim"]).select("id", "v") for x in (queries, vectors)), r["n"], Scale(r["dim"], r["largest"]), k) for r in dims if r["dim"]]
    if any(not r["dim"] for r in dims):
        found.append(_search_empty(*(x.where(size == 0).select("id") for x in (queries, vectors)), k))
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return functools.reduce(DataFrame.unionByName, found)


def _search_empty(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """All scores are 0: the smallest ids that aren't the query's own.  Repeated rows with one id count as separate candidates."""
    counts = vectors.groupBy("id").agg(F.count("*").alias("n")).orderBy("id").limit(k + 1)  # k + 1 rows hold k that aren't the query's own
    least = counts.agg(F.array_sort(F.collect_list(F.struct("id", "n"))).alias("least"))
    others = F.flatten(F.transform(F.filter("least", lambda c: c["id"] != F.col("query_id")), lambda c: F.array_repeat(c["id"], F.least(c["n"], F.lit(k)).cast("int"))))
    rows = queries.select(F.col("id").alias("query_id")).crossJoin(F.broadcast(least)).select("query_id", F.posexplode(F.slice(others, 1, k)).alias("p", "vec_id"))  # one row
    return rows.select("query_id", (F.col("p") + 1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))


def _search_dimension(queries: DataFrame, vectors: DataFrame, n: int, scale: Scale, k: int) -> DataFrame:
    spark = vectors.sparkSession
    vectors, queries = stored(vectors, "mtree-rows"), stored(queries, "mtree-queries")
    pages, routes, radii, parts = build_index(vectors, n, scale)
    handle = spark.sparkContext.broadcast(routes)
    slices = F.broadcast(spark.createDataFrame(list(parts.items()), "node int, slices int"))  # a row a routing object
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def visit(wanted: DataFrame, first: bool) -> DataFrame:
        routed = wanted.mapInArrow(_bounds(handle, radii, first), "id long, v array<double>, floor long, node int")
        routed = routed.join(slices, "node").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("slices").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        routed = stored(routed, "mtree-routed")
        needed = routed.select(F.col("node").alias("q_node"), F.col("slice").alias("q_slice"), F.col("block").alias("q_block")).distinct()
        copies = pages.join(needed, (F.col("node") == F.col("q_node")) & (F.col("slice") == F.col("q_slice"))).withColumnRenamed("q_block", "block")
        keys = ("node", "slice", "block")
        return copies.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(_search(handle, k), "query_id long, vec_id long, score long")

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    near = stored(visit(queries.withColumn("floor", F.lit(None).cast("long")), True), "mtree-first")
    floors = near.withColumn("rank", place).where((F.col("rank") == k) & (F.col("score") > -_LARGEST)).select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    found = near.unionByName(visit(queries.join(floors, "id", "left").select("id", "v", "floor"), False))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
