"""Centroid clustering (Lloyd's rounds) with exponion search, exact in whole numbers.

Each vector keeps its centroid, an upper bound of its distance to it and a lower bound of its distance to the
second nearest.  Moves of centroids widen the bounds.  Where the upper bound stays strictly below the lower one, or below half of
the centroid's distance to its nearest neighbour, nothing is computed.  Else the distance to its own centroid is computed, and if that
doesn't settle it, the centroids inside the ball around its own with radius twice that distance plus the own centroid's distance
to its nearest neighbour, taken from sorted lists of distances between centroids.  The ball holds the nearest and the
second nearest centroid, and its border belongs to it, so that equally near ones meet: the smaller number wins.

Distances compared are squared and whole: floats while all sums stay under 2^53, 64-bit integers under 2^62, Python's integers
beyond (without bounds then: all centroids are compared).  Sums of a cluster's components go through Spark in limbs of 48 bits, and means
are exact floors.  A round reads the vectors with their bounds and writes them with new ones; no vector is shuffled.
The driver holds the centroids only: ``k`` rows of ``dim`` numbers, both parameters.

Vectors take part that have exactly ``dim`` components, none null or non-finite.  Null ids are kept and hash like the text
'null'; repeated rows count once each, and rows with one id are seeded in order of their components.  Fewer than ``k`` vectors give fewer centroids,
an empty table no rows.  Distances and inertias over a long's range are cut to its largest.  Other columns are ignored.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, scratch, stored

SCALE = 256
_LARGEST = (1 << 63) - 1
_LIMB = 48
#: Bounds are floats; each is moved to its safe side by so much of itself.
_UP, _DOWN = 1 + 1e-9, 1 - 1e-9


def whole_vectors(table: DataFrame, id_col: str, vec_col: str, dim: int, scale: int = SCALE) -> DataFrame:
    """id and v: floor(scale * x) as array<double> of whole numbers, of the vectors that take part."""
    x = F.col(vec_col)
    sound = F.coalesce(F.size(x) == dim, F.lit(False)) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))

    def whole(e: Column) -> Column:
        y = F.greatest(F.least(e.cast("double") * scale, F.lit(np.finfo(float).max.item())), F.lit(np.finfo(float).min.item()))
        return F.when(F.abs(y) < 1 << 53, F.floor(y).cast("double")).otherwise(y)  # larger ones are whole, and may not fit a long

    return table.where(sound).select(F.col(id_col).cast("long").alias("id"), F.transform(x, whole).alias("v"))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _integers(vectors: np.ndarray) -> np.ndarray:
    """Python's integers, of any size."""
    return np.array([[int(a) for a in row] for row in vectors.tolist()], dtype=object).reshape(vectors.shape)


@dataclasses.dataclass
class Centroids:
    """The centroids and what a search needs of them.  ``rows`` are whole numbers of the width that keeps distances exact."""

    rows: np.ndarray
    largest: float

    def __post_init__(self) -> None:
        k = len(self.rows)
        self.squares = (self.rows * self.rows).sum(1)
        if self.bounded:
            gaps = np.sqrt(np.maximum(self.distances(self.rows, np.arange(k)).astype(float), 0))
            self.order = np.argsort(gaps, axis=1, kind="stable")
            self.sorted = np.take_along_axis(gaps, self.order, 1)
            np.fill_diagonal(gaps, np.inf)
            self.nearest_other = gaps.min(1, initial=np.inf)

    @classmethod
    def of(cls, rows: list[list[int]], largest: float) -> Centroids:
        dim = len(rows[0])
        most = 4 * dim * int(largest) ** 2
        kind = np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object
        return cls(np.array(rows, dtype=kind).reshape(len(rows), dim), largest)

    @property
    def bounded(self) -> bool:
        return self.rows.dtype != object

    def fit(self, vectors: np.ndarray) -> np.ndarray:
        return _integers(vectors) if not self.bounded else vectors.astype(self.rows.dtype)

    def distances(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances of all x to some centroids."""
        return (x * x).sum(1)[:, None] + self.squares[which][None] - 2 * (x @ self.rows[which].T)

    def own(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        """Squared distance of each x to its own centroid."""
        gap = x - self.rows[cluster]
        return (gap * gap).sum(1)

    def moves(self, before: Centroids) -> np.ndarray:
        gap = (self.rows - before.rows).astype(float)
        return np.sqrt((gap * gap).sum(1)) * _UP


def _two_nearest(d: np.ndarray, numbers: np.ndarray, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: the number of the nearest centroid (ties: the smaller), its squared distance, and a lower bound of the second nearest's distance."""
    order = np.argsort(numbers)
    d, numbers = d[:, order], numbers[order]
    if inside is not None:
        d = np.where(inside[:, order], d, np.iinfo(np.int64).max if d.dtype == np.int64 else np.inf)
    best = d.argmin(1)
    rows = np.arange(len(d))
    nearest = d[rows, best]
    if d.dtype == object:
        return numbers[best], nearest, np.zeros(len(d))
    rest = d.astype(float)
    rest[rows, best] = np.inf
    return numbers[best], nearest, np.sqrt(np.maximum(rest.min(1), 0)) * _DOWN


def search(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New clusters and bounds, and how many distances were computed; ``cluster`` is -1 where there is none yet."""
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    every = np.arange(len(centroids.rows))
    if not centroids.bounded or (cluster < 0).any():
        cluster, d, lower = _two_nearest(centroids.distances(x, every), every)
        return cluster, np.sqrt(d.astype(float)) * _UP if centroids.bounded else np.full(len(x), np.inf), lower, x.shape[0] * len(every)
    # half of the distance to the nearest other centroid, as a lower bound of the second nearest's distance
    lower = np.maximum(lower, centroids.nearest_other[cluster] / 2 * _DOWN)
    open_ = np.flatnonzero(~(upper < lower))
    upper[open_] = np.sqrt(centroids.own(x[open_], cluster[open_]).astype(float)) * _UP
    computed = len(open_)
    open_ = open_[~(upper[open_] < lower[open_])]
    for own in np.unique(cluster[open_]).tolist():
        mine = open_[cluster[open_] == own]
        radius = (2 * upper[mine] + centroids.nearest_other[own]) * _UP
        within = np.searchsorted(centroids.sorted[own], radius, side="right")  # the border is inside
        level = np.ceil(np.log2(np.maximum(within, 1))).astype(int)
        for size in np.unique(level).tolist():  # together those whose balls hold about equally many
            rows, held = mine[level == size], within[level == size]
            n = int(held.max())
            numbers = centroids.order[own][:n]
            d = centroids.distances(x[rows], numbers)
            computed += int(held.sum())
            cluster[rows], nearest, lower[rows] = _two_nearest(d, numbers, np.arange(n)[None] < held[:, None])
            upper[rows] = np.sqrt(nearest.astype(float)) * _UP
    return cluster, upper, lower, computed


_STATE = "id long, v array<double>, cluster int, upper double, lower double"
#: Vectors searched at once.
_BLOCK = 8192


def _assign(handle, moves: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids: Centroids = handle.value
        for whole in batches:
            for at in range(0, whole.num_rows, _BLOCK):
                batch = whole.slice(at, _BLOCK)
                x = centroids.fit(_vectors(batch.column(1), centroids.rows.shape[1]))
                cluster, upper, lower = (batch.column(i).to_numpy() for i in (2, 3, 4))
                if moves is not None:
                    upper = (upper + moves[cluster]) * _UP
                    others = np.where(np.arange(len(moves)) == moves.argmax(), -1, moves).max()  # the largest move but the largest one's own
                    lower = lower - np.where(cluster == moves.argmax(), max(others, 0), moves.max()) * _UP
                cluster, upper, lower, _ = search(x, cluster, upper, lower, centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower)], names=["id", "v", "cluster", "upper", "lower"])

    return run


def _limbs(total: int) -> list[int]:
    """total as a sum of limb_j * 2^(48 j)."""
    sign, rest, out = (-1 if total < 0 else 1), abs(total), []
    while rest:
        out.append(sign * (rest & ((1 << _LIMB) - 1)))
        rest >>= _LIMB
    return out


def _sums(dim: int, wide: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list[int]] = {}
        counts: dict[int, int] = {}
        for batch in batches:
            x, cluster = _vectors(batch.column(1), dim), batch.column(0).to_numpy()
            x = _integers(x) if wide else x.astype(np.int64)
            for c in np.unique(cluster).tolist():
                mine = x[cluster == c]
                part = mine.sum(0).tolist()
                totals[c] = [a + b for a, b in zip(totals.get(c, [0] * dim), part, strict=True)]
                counts[c] = counts.get(c, 0) + len(mine)
        rows = [(c, -1, 0, n) for c, n in counts.items()] + [(c, d, j, limb) for c, total in totals.items() for d, number in enumerate(total) for j, limb in enumerate(_limbs(number))]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())], names=["cluster", "d", "limb", "part"])

    return run


def _means(state: DataFrame, centroids: list[list[int]], wide: bool) -> list[list[int]]:
    """Each cluster's mean, floored; a cluster without vectors keeps its centroid.  Collects k * dim sums."""
    dim = len(centroids[0])
    parts = state.select("cluster", "v").mapInArrow(_sums(dim, wide), "cluster int, d int, limb int, part long")
    sums: dict[tuple[int, int], int] = {}
    for row in parts.groupBy("cluster", "d", "limb").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part")).toLocalIterator():
        key = row["cluster"], row["d"]
        sums[key] = sums.get(key, 0) + (int(row["part"]) << _LIMB * row["limb"])
    return [[sums.get((c, d), 0) // sums[c, -1] for d in range(dim)] if (c, -1) in sums else old for c, old in enumerate(centroids)]


def seeds(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of ``seed:id``, in its order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary"), 256)
    return [[int(a) for a in row["v"]] for row in vectors.orderBy(key, "v").limit(k).select("v").collect()]


def cluster(table: DataFrame, id_col: str, vec_col: str, *, dim: int, k: int, rounds: int, seed: str, scale: int = SCALE) -> DataFrame:
    """id, cluster (int), distance (long, squared), cluster_inertia and inertia (long), and centroid (array<string> of whole numbers) of each vector.

    The result is a stored table; what was stored on the way is deleted.
    """
    with scratch() as kept:
        return kept(_clustered(table, id_col, vec_col, dim, k, rounds, seed, scale), "clustered")


def _clustered(table: DataFrame, id_col: str, vec_col: str, dim: int, k: int, rounds: int, seed: str, scale: int) -> DataFrame:
    spark = table.sparkSession
    vectors = stored(whole_vectors(table, id_col, vec_col, dim, scale), "cluster-vectors")
    centers = seeds(vectors, k, seed)
    if not centers:
        return vectors.select("id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.array().cast("array<string>").alias("centroid"))
    largest = vectors.select(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    state = vectors.select("id", "v", F.lit(-1).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"))
    now, moves, last = Centroids.of(centers, largest), None, vectors
    for left in range(rounds, -1, -1):
        handle = spark.sparkContext.broadcast(now)
        state = stored(state.mapInArrow(_assign(handle, moves), _STATE), "clusters")
        discard(last)
        last = state
        if left:
            centers = _means(state, centers, not now.bounded)
            before, now = now, Centroids.of(centers, largest)
            moves = now.moves(before) if now.bounded else None
    return _inertia(state, now, centers)


def _distance(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids: Centroids = handle.value
        for batch in batches:
            x = centroids.fit(_vectors(batch.column(1), centroids.rows.shape[1]))
            own = np.minimum(centroids.own(x, batch.column(2).to_numpy()), _LARGEST) if not centroids.bounded else centroids.own(x, batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([int(d) for d in own.tolist()], pa.int64())], names=["id", "cluster", "distance"])

    return run


def _inertia(state: DataFrame, centroids: Centroids, centers: list[list[int]]) -> DataFrame:
    """Distances with their sums: one row a cluster, k of them, is broadcast."""
    spark = state.sparkSession
    rows = state.select("id", "v", "cluster").mapInArrow(_distance(spark.sparkContext.broadcast(centroids)), "id long, cluster int, distance long")
    cut = lambda c: F.least(c, F.lit(_LARGEST)).cast("long")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    total = sums.agg(F.sum("s").alias("t"))  # one row
    named = spark.createDataFrame([(c, [str(a) for a in row]) for c, row in enumerate(centers)], "cluster int, centroid array<string>")
    facts = sums.join(named, "cluster").crossJoin(F.broadcast(total)).select("cluster", cut(F.col("s")).alias("cluster_inertia"), cut(F.col("t")).alias("inertia"), "centroid")
    return rows.join(F.broadcast(facts), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(centroid: Column) -> Column:
    """Lower-case hex SHA-256 of a centroid's components, joined by commas."""
    return F.sha2(F.array_join(centroid, ",").cast("binary"), 256)
