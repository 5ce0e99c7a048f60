"""Full paths of a forest of (node, parent) rows.

Pointer doubling: after step k a node knows its ancestor 2^k links up and the names
between, so a chain of n nodes takes log2(n) self-joins on equal keys, whatever the shape
of the tree; nodes that have reached the root leave the loop, and it ends with the
deepest.  Entries of folders that hold a large part of all are joined by broadcast of these few folders' facts.  A missing parent, or a node that is its own parent, is the root.  A cycle is cut
at its smallest reference, which becomes a child of the root, so no entry is lost; only what lies on or below cycles, or very deep, is
followed again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import join_facts, partitions
from .staging import staged

_KEY = ["drive", "file_ref"]
#: Chains longer than this are checked for cycles.
_USUAL_DEPTH = 256
#: What a link takes besides its value, about.
_ROW_BYTES = 40


def resolve_paths(entries: DataFrame, root: Column | str, *, sep: str = "/", exclude: Callable[[Column], Column] | None = None) -> DataFrame:
    """entries (drive, file_ref, parent_ref, name, ...) with ``path``; roots themselves, and all below an excluded path, are dropped.

    ``root`` is a path, or a Column over an entry's own columns (such as its drive).  ``exclude`` maps a full path to a
    condition; it is tested for every folder and inherited by what lies below.
    """
    root_path = F.lit(root) if isinstance(root, str) else root
    inner = entries.where(F.col("file_ref") != F.col("parent_ref"))
    known = inner.select(F.col("drive").alias("p_drive"), F.col("file_ref").alias("p_ref"))
    parents = join_facts(inner.select(*_KEY, "parent_ref", "name"), ["drive", "parent_ref"], known, ["p_drive", "p_ref"])
    # a link: the chain from a node up to ``up`` (null: the root was reached), and its names joined
    links = staged(parents.select(*_KEY, F.col("p_ref").alias("up"), F.col("name").alias("tail")), "links")
    names = lambda far, near: F.concat_ws(sep, far, near)
    ended, n_bytes, deep = _double(links, names, "tail", _USUAL_DEPTH)
    if deep is not None:  # deeper than usual, or on a cycle
        below = staged(links.join(deep, _KEY, "left_semi"), "links")
        cut = staged(_without_cycles(below, _cycle_heads(below)), "links")
        more, more_bytes, _ = _double(_from_ended(cut, ended, names, "tail"), names, "tail")
        ended, n_bytes = ended.unionByName(more), n_bytes + more_bytes
        links = links.join(deep, _KEY, "left_anti").unionByName(cut)
    n = partitions(ended.sparkSession, n_bytes)
    rows = (inner, ended) if n is None else (inner.repartition(n, *_KEY), ended.repartition(n, *_KEY))
    paths = rows[0].join(rows[1], _KEY).withColumn("path", F.concat_ws(sep, F.rtrim(root_path, F.lit(sep)), "tail")).drop("tail")
    if exclude is None:
        return paths
    start = links.select(*_KEY, "up").join(paths.select(*_KEY, F.coalesce(exclude(F.col("path")), F.lit(False)).alias("out")), _KEY)
    inherited, _, _ = _double(staged(start, "links"), lambda far, near: far | near, "out")
    return paths.join(inherited.where("NOT out").select(*_KEY), _KEY)


def _far(links: DataFrame, value: str) -> DataFrame:
    return links.select(F.col("drive").alias("f_drive"), F.col("file_ref").alias("f_ref"), F.col("up").alias("f_up"), F.col(value).alias("f_value"))


def _double(links: DataFrame, combine: Callable[[Column, Column], Column], value: str, depth: int | None = None) -> tuple[DataFrame, int, DataFrame | None]:
    """Follows ``up`` until it is null, combining ``value`` of the far link with the near one's: what has ended, and its bytes; with ``depth``, also the keys of longer chains.

    links is a stored table.  A join is dealt into partitions by the bytes of its values, which grow with each step.
    """
    ended, ended_bytes, span = [], 0, 1
    while True:
        open_, done = links.where("up IS NOT NULL"), links.where("up IS NULL")
        size = F.octet_length(F.col(value).cast("string")) + _ROW_BYTES
        n_open, open_bytes, done_bytes = (x or 0 for x in links.agg(F.count("up"), F.sum(F.when(F.col("up").isNotNull(), size)), F.sum(F.when(F.col("up").isNull(), size))).first())
        ended.append(done)
        ended_bytes += done_bytes
        all_ended = reduce(DataFrame.unionByName, ended)
        if not n_open:
            return all_ended.drop("up"), ended_bytes, None
        if depth is not None and span > depth:
            return all_ended.drop("up"), ended_bytes, open_.select(*_KEY)
        parts = partitions(links.sparkSession, 2 * open_bytes + ended_bytes)
        both = join_facts(open_, ["drive", "up"], _far(open_.unionByName(all_ended), value), ["f_drive", "f_ref"], "inner", parts)
        links = staged(both.select(*_KEY, F.col("f_up").alias("up"), combine(F.col("f_value"), F.col(value)).alias(value)), "links")
        span *= 2


def _from_ended(links: DataFrame, ended: DataFrame, combine: Callable[[Column, Column], Column], value: str) -> DataFrame:
    """links, stored, with those that hang from an ended one ended; the others then meet among themselves."""
    ups = staged(links.where("up IS NOT NULL").select("drive", F.col("up").alias("file_ref")).distinct(), "links")
    near = staged(ended.join(ups, _KEY, "left_semi"), "links")
    both = join_facts(links, ["drive", "up"], near.select(F.col("drive").alias("f_drive"), F.col("file_ref").alias("f_ref"), F.col(value).alias("f_value")), ["f_drive", "f_ref"])
    hangs = F.col("f_ref").isNotNull()
    return staged(both.select(*_KEY, F.when(~hangs, F.col("up")).alias("up"), F.when(hangs, combine(F.col("f_value"), F.col(value))).otherwise(F.col(value)).alias(value)), "links")


def _cycle_heads(links: DataFrame) -> DataFrame:
    """drive and head: the smallest reference of each cycle among ``links`` (drive, file_ref, up); other chains leave the loop."""
    low = staged(links.select(*_KEY, "up", F.col("file_ref").alias("low")), "cycles")
    n, span = low.count(), 1
    while span <= n:  # at the end ``up`` lies on the cycle, and a cycle's node has seen all of it
        far = low.select(F.col("drive").alias("f_drive"), F.col("file_ref").alias("f_ref"), F.col("up").alias("f_up"), F.col("low").alias("f_low"))
        both = join_facts(low, ["drive", "up"], far, ["f_drive", "f_ref"], "inner")
        low = staged(both.select(*_KEY, F.col("f_up").alias("up"), F.least("low", "f_low").alias("low")), "cycles")
        span *= 2
    on_cycle = low.select("drive", F.col("up").alias("file_ref")).distinct()
    return staged(low.join(on_cycle, _KEY, "left_semi").select("drive", F.col("low").alias("head")).distinct(), "cycle-heads")


def _without_cycles(links: DataFrame, heads: DataFrame) -> DataFrame:
    """links whose cycles' heads hang from the root."""
    marked = links.join(heads.select(F.col("drive").alias("h_drive"), "head"), (F.col("drive") == F.col("h_drive")) & (F.col("file_ref") == F.col("head")), "left")
    return marked.withColumn("up", F.when(F.col("head").isNull(), F.col("up"))).drop("h_drive", "head")


def refs_to_paths(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """drive, file_ref and path of the refs the catalog knows; others are dropped."""
    return refs.select(*_KEY).distinct().join(catalog.select(*_KEY, "path"), _KEY)
