"""Near duplicates by a chosen-path set similarity join.

Texts are sets of word shingles.  Equal sets collapse into one class, whose smallest
id represents it.  Every representative then starts at the root of several
trees, each with minwise values of its own.  A node picks one or (with chance 1/4) both of its level's
two values by its own hash, and each set goes to the child named by its value of that token, so the
expected number of children of a pair at the threshold 0.8 that stay together is one.
Nodes of up to SMALL_NODE sets are compared exhaustively by signature; larger ones
branch again.  A large node that kept most of its parent's sets is dense (its sets agree
on tokens picked at random), and so is what is still large at the last level: its sets
are linked to its smallest member and branch no more.  A pair at the threshold meets in
a tree with a chance of 0.48 at the last level (the branching process's exact value), in none of
16 trees with one of 3e-5; the signatures' cut takes it with one of 2e-8 (exact binomial), in all trees at once.

Those links only gather candidates: their connected components bring the texts
together, each once.  There, full sets decide, and every pair of a group is compared that
shares one of its rarest shingles, as any linked pair must: groups of bounded size are linked
exactly in one task; a larger group is first split where no rare shingle is shared, and only a part that
is still large is dealt into blocks that share a hub, and whatever
isn't linked to the hub's component is compared with all blocks, so no link is lost to
a block's bound.  Components of confirmed links are the result.

Null and empty texts and texts without words have an empty set and are linked with
nothing, not even each other.  Texts with fewer words than the width have one shingle,
the whole sequence.  Rows with a null id aren't linked, have a null component and are
kept.  Rows that share an id are one vertex: their links count together.  Equal texts
go to the smallest id.  A very long text is scanned whole, alone in its chunk.  Other columns
are ignored by ``near_duplicates`` and carried by ``keep_one_of_each``, whatever their names;
an empty table gives an empty one.  Facts of hot classes and hubs are broadcast, so copies of
one text don't meet in one task.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .shared import discard, flag_ids, join_facts, scratch, stored
from .textscan import NONSPACE, SMALL_BYTES, Scan, keyed, mix, scans, windows


def shingle_sets(scan: Scan, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles (hashes) of each text, in the texts' order, and their texts."""
    low = scan.lowered()
    s, e, owner = low.spans(NONSPACE)
    words = low.hashes(s, e)
    grams, first = windows(words, owner, width)
    texts = owner[first]
    count = np.bincount(owner, minlength=scan.n)
    start = np.searchsorted(owner, np.arange(scan.n))
    for k in range(1, width):
        short = np.flatnonzero(count == k)
        if len(short):
            whole = np.full(len(short), k, np.uint64)
            for j in range(k):
                whole = whole * np.uint64(0xC2B2AE3D27D4EB4F) + words[start[short] + j]
            grams, texts = np.concatenate([grams, mix(whole + np.uint64(k))]), np.concatenate([texts, short])
    keep = np.unique(keyed(grams, texts), return_index=True)[1]
    keep = keep[np.argsort(texts[keep], kind="stable")]
    return grams[keep], texts[keep]


def signatures(grams: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """n minwise values (uint32) of each nonempty set; sets begin at ``starts``."""
    x = (grams >> np.uint64(32)).astype(np.uint32)
    seeds = mix(np.arange(n, dtype=np.uint64) + np.uint64(20240601))
    xor, mul = (seeds >> np.uint64(32)).astype(np.uint32), seeds.astype(np.uint32) | np.uint32(1)
    out = np.empty((len(starts), n), np.uint32)
    for k in range(n):
        out[:, k] = np.minimum.reduceat((x ^ xor[k]) * mul[k], starts)
    return out


#: Minwise values of a sketch, a byte each: sets with nothing in common agree on 1/256 of them.
SKETCH = 64
#: Every tree has so many minwise values of its own, of 32 bits: with 16, a node of n sets had n / 65,536 of them by chance.
TOKENS, TOKEN_BYTES = 12, 4
TREES, LEVELS, SMALL_NODE = 16, 6, 32
#: A large node with more than this share of its parent's sets is dense.
DENSE = 0.6
#: Signatures that agree less aren't candidates: six deviations under 0.8.
LEAST_AGREEMENT = 0.5
#: Most texts, and most shingles in all, of a group that one task links exactly.
GROUP_TEXTS, GROUP_SHINGLES = 512, 1_000_000


def _sketch(width: int, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, h1, h2 = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            sketch: list[bytes | None] = [None] * batch.num_rows
            tokens: list[bytes | None] = [None] * batch.num_rows
            for lo, _, scan in scans(batch.column(1), SMALL_BYTES):
                grams, texts = shingle_sets(scan, width)
                if not len(grams):
                    continue
                full, starts = np.unique(texts, return_index=True)
                at = lo + full
                size[at] = np.diff(np.append(starts, len(grams)))
                h1[at] = np.add.reduceat(mix(grams), starts).view(np.int64)
                h2[at] = np.add.reduceat(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), starts).view(np.int64)
                values = signatures(grams, starts, SKETCH + trees * TOKENS) * np.uint32(0x9E3779B1)
                short, long = (values[:, :SKETCH] >> np.uint32(24)).astype(np.uint8), values[:, SKETCH:]
                for i, x, y in zip(at, short, long, strict=True):
                    sketch[i], tokens[i] = x.tobytes(), y.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(h1), pa.array(h2), pa.array(sketch, pa.binary()), pa.array(tokens, pa.binary())], names=["id", "n_shingles", "h1", "h2", "sketch", "tokens"])

    return run


def _matrix(column: pa.Array, width: int, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _children(node: np.ndarray, tokens: np.ndarray, level: int, follow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of (node, set) rows and the rows they come from; bit k of ``follow``: by the level's token k.

    Each level has two tokens of its own, as a token picked twice on a way would keep all sets together.
    """
    children, sources = [], []
    for k in range(2):
        chosen = np.flatnonzero(follow >> k & 1)
        token = (2 * (level - 1) + k) % TOKENS
        value = tokens[chosen, token].astype(np.uint64)
        children.append(mix(mix(node[chosen] + np.uint64(k + 1)) ^ (value + np.uint64(token << 32))))
        sources.append(chosen)
    return np.concatenate(children).view(np.int64), np.concatenate(sources)


def _picks(column: str) -> Column:
    """The tokens that a node picks by its hash, as bits: one, and with chance 1/4 both."""
    pick = F.xxhash64(F.col(column), F.lit(23))
    return F.when(F.shiftright(pick, 32).bitwiseAND(3) == 0, 3).otherwise(pick.bitwiseAND(1) + 1).cast("int")


def _past_dense(open_: DataFrame, level: int, small: int, n_sets: int) -> tuple[DataFrame, DataFrame]:
    """Rows of nodes that branch from ``level``, with the tokens they ``follow``, and links (a, b) of those that needn't.

    The child that holds a node's smallest set is known by that set's token. Where it would be large and dense, its sets are linked
    to that set at once, as one level down they would be, and only the node's other sets go down by that token.
    """
    firsts = [TOKEN_BYTES * ((2 * level + k) % TOKENS) + 1 for k in range(2)]
    rows = open_.withColumns({f"t{k}": F.substring("own", at, TOKEN_BYTES) for k, at in enumerate(firsts)})
    values = rows.groupBy("node", "t0", "t1").agg(F.count("*").alias("n"), F.min("rep").alias("least"))

    def at_least(k: int) -> DataFrame:
        """Each node's value of token k that its smallest set has, and how many sets have it."""
        each = values.groupBy("node", f"t{k}").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
        return each.groupBy("node").agg(F.min_by(f"t{k}", "least").alias(f"hub{k}"), F.min_by("n", "least").alias(f"n{k}"), F.sum("n").alias("n" if k == 0 else "total"))

    counts = at_least(0).join(at_least(1), "node")
    dense = [((F.col(f"n{k}") > small) & (F.col(f"n{k}") > DENSE * F.col("n"))).alias(f"dense{k}") for k in range(2)]
    rows = join_facts(rows, counts.select("node", "hub0", "hub1", "n", *dense), ["node"], "n", n_sets)
    agree = [F.col(f"t{k}") == F.col(f"hub{k}") for k in range(2)]
    at_hub = sum((F.when(x & F.col(f"dense{k}"), 1 << k).otherwise(0) for k, x in enumerate(agree)), F.lit(0))
    rows = rows.withColumn("at_hub", at_hub.bitwiseAND(_picks("node"))).withColumn("follow", _picks("node") - F.col("at_hub"))
    rows = stored(rows.select("node", "rep", "size", "sketch", "own", "hub", "at_hub", "follow"), "tree-branching")  # read three times
    links = rows.where("at_hub != 0 AND rep != hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    return rows.where("follow != 0").select("node", "rep", "size", "sketch", "own", "follow"), links


def _plant(trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens = _matrix(batch.column(1), trees * TOKENS)
            for tree in range(trees):
                root = mix(np.array([tree + 1], np.uint64))[0]
                follow = 3 if (int(root) >> 32) % 4 == 0 else (int(root) & 1) + 1
                node, row = _children(np.full(len(tokens), root), tokens[:, tree * TOKENS : (tree + 1) * TOKENS], 1, np.full(len(tokens), follow))
                yield pa.RecordBatch.from_arrays([pa.array(node), batch.column(0).take(pa.array(row)), pa.array(np.full(len(row), tree, np.int32))], names=["node", "rep", "tree"])

    return run


def _branch(level: int):
    """Rows (node, rep, size, sketch, own, follow) one level down."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node, row = _children(batch.column(0).to_numpy().view(np.uint64), _matrix(batch.column(4), TOKENS), level, batch.column(5).to_numpy())
                rep, size, sketch, own = (batch.column(k).take(pa.array(row)) for k in (1, 2, 3, 4))
                yield pa.RecordBatch.from_arrays([pa.array(node), rep, size, sketch, own], names=["node", "rep", "parent_size", "sketch", "own"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int = 1) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that agree on the first ``keys`` columns; the rows come sorted by these."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        new = np.zeros(table.num_rows, bool)
        for k in range(keys):
            key = table.column(k).to_numpy()
            new[1:] |= key[1:] != key[:-1]
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut)
    if held is not None:
        yield held


def _compare_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compares all pairs of each small node, row i with row i + k for every k; each set is linked to the smallest it is connected with there."""
    for table in _groups(batches):
        node, rep = table.column(0).to_numpy(), table.column(1).to_numpy()
        sketch = _matrix(table.column(2).combine_chunks(), SKETCH, np.uint8)
        a, b = [], []
        for k in range(1, len(node)):
            i = np.flatnonzero(node[:-k] == node[k:])
            if not len(i):
                break
            i = i[(sketch[i] == sketch[i + k]).mean(1) >= LEAST_AGREEMENT]
            a.append(i)
            b.append(i + k)
        least = rep.copy()
        if a:
            left, right = np.concatenate(a), np.concatenate(b)
            while (least[left] != least[right]).any():
                low = np.minimum(least[left], least[right])
                np.minimum.at(least, left, low)
                np.minimum.at(least, right, low)
        joined = np.flatnonzero(least != rep)
        yield pa.RecordBatch.from_arrays([pa.array(rep[joined]), pa.array(least[joined])], names=["a", "b"])


def candidate_edges(reps: DataFrame, *, trees: int = TREES, levels: int = LEVELS, small: int = SMALL_NODE) -> DataFrame:
    """Candidate links (a, b) between representatives (rep, sketch, tokens)."""
    n_sets = reps.count()
    rows = stored(reps.select("rep", "tokens").mapInArrow(_plant(trees), "node long, rep long, tree int"), "tree-rows")  # counted, then joined
    leaves, dense = [], []
    for level in range(1, levels + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("n"), F.min("rep").alias("hub")).where("n > 1")
        members = join_facts(rows, sizes.withColumn("size", F.col("n")), ["node"], "n", n_sets * 2).where("size IS NOT NULL")
        if level == 1:  # most sets have no company from the start; only the others bring their signatures
            members = members.join(reps.select("rep", "sketch", "tokens"), "rep").withColumn("own", F.expr(f"substring(tokens, tree * {TOKEN_BYTES * TOKENS} + 1, {TOKEN_BYTES * TOKENS})")).withColumn("parent_size", F.lit(None).cast("long"))
        members = stored(members.select("node", "rep", "size", "sketch", "own", "hub", "parent_size"), "tree-nodes")
        discard(rows)
        leaves.append(members.where(F.col("size") <= small).select("node", "rep", "sketch"))
        large = members.where(F.col("size") > small)
        ended = F.coalesce(F.col("size") > DENSE * F.col("parent_size"), F.lit(False)) if level < levels else F.lit(True)
        dense.append(large.where(ended).select(F.col("rep").alias("a"), F.col("hub").alias("b")))
        open_ = large.where(~ended).select("node", "rep", "size", "sketch", "own", "hub")
        if level == levels or open_.isEmpty():
            break
        open_, links = _past_dense(open_, level, small, n_sets * 2)
        dense.append(links)
        rows = stored(open_.mapInArrow(_branch(level + 1), "node long, rep long, parent_size long, sketch binary, own binary"), "tree-rows")
    edges = functools.reduce(DataFrame.unionByName, leaves).repartition("node").sortWithinPartitions("node").mapInArrow(_compare_small, "a long, b long")
    return functools.reduce(DataFrame.unionByName, dense, edges)


# -- confirming links on full sets


class _Sets:
    """The shingle sets of a group's texts, each with its rarest shingles first.

    A set that shares ``percent`` of its union with another has that much of itself in common with it, so both hold a
    common shingle among their rarest (size - least + 1), ``least`` being that share of their size: an exact filter.
    """

    def __init__(self, texts: pa.ChunkedArray, width: int, percent: int):
        parts = [(grams, lo + owner) for lo, _, scan in scans(texts) for grams, owner in (shingle_sets(scan, width),)]
        grams, owner = (np.concatenate([p[k] for p in parts]) for k in range(2))
        _, code, found = np.unique(grams, return_inverse=True, return_counts=True)
        order = np.lexsort((code, found[code], owner))
        self.code, owner, self.percent = code[order], owner[order], percent
        self.size = np.bincount(owner, minlength=len(texts))
        self.start = np.cumsum(self.size) - self.size
        self.head = self.size + (-percent * self.size // 100) + 1
        rare = np.flatnonzero(np.arange(len(owner)) - self.start[owner] < self.head[owner])
        rare = rare[np.argsort(self.code[rare], kind="stable")]
        self.holder = owner[rare]
        self.cuts = np.searchsorted(self.code[rare], np.arange(len(found) + 1))
        self.mark = np.zeros(len(found), bool)

    def linked(self, i: int, among: np.ndarray) -> Iterator[int]:
        """The sets of the mask ``among`` that are linked with set i; the mask is read again before each comparison."""
        codes = self.code[self.start[i] : self.start[i] + self.size[i]]
        rare = codes[: self.head[i]]
        near = np.concatenate([self.holder[a:b] for a, b in zip(self.cuts[rare], self.cuts[rare + 1], strict=True)] or [np.zeros(0, int)])
        near = np.unique(near[among[near]])
        near = near[100 * np.minimum(self.size[near], self.size[i]) >= self.percent * np.maximum(self.size[near], self.size[i])]
        self.mark[codes] = True
        for j in near.tolist():
            if among[j]:
                common = int(self.mark[self.code[self.start[j] : self.start[j] + self.size[j]]].sum())
                if 100 * common >= self.percent * (self.size[i] + self.size[j] - common):
                    yield j
        self.mark[codes] = False


def _link_group(rep: np.ndarray, sets: _Sets, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The smallest rep of each row's component, under the links between rows ``first`` and ``second``; pairs already connected aren't compared."""
    label = np.arange(len(rep))
    may = np.zeros(len(rep), bool)
    may[second] = True
    for i in first.tolist():
        among = may & (label != label[i])
        for j in sets.linked(i, among):
            label[label == label[j]] = label[i]
            np.logical_and(among, label != label[i], out=among)
    least = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(least, label, rep)
    return least[label]


def _confirm(width: int, percent: int):
    """Rows (group, block, side, rep, hub, text) -> edges (a, b) from each rep to its component's smallest in the block, and whether that holds the hub.

    Side 0 are the block's own texts, all compared; side 1 are residual texts, compared with those of side 0 only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 2):
            group, block, side, rep, hub = (table.column(k).to_numpy() for k in range(5))
            cuts = [0, *(np.flatnonzero((group[1:] != group[:-1]) | (block[1:] != block[:-1])) + 1), len(group)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                sets = _Sets(table.column(5).slice(lo, hi - lo), width, percent)
                own, other = np.flatnonzero(side[lo:hi] == 0), np.flatnonzero(side[lo:hi] == 1)
                low = _link_group(rep[lo:hi], sets, other if len(other) else own, own)
                with_hub = np.isin(low, low[rep[lo:hi] == hub[lo]])
                yield pa.RecordBatch.from_arrays([pa.array(rep[lo:hi]), pa.array(low), pa.array(with_hub)], names=["a", "b", "with_hub"])

    return run


def _blocks(rows: DataFrame, width: int, percent: int) -> DataFrame:
    ready = rows.select("group", "block", "side", "rep", "hub", "text").repartition("group", "block").sortWithinPartitions("group", "block", "side", "rep")
    return ready.mapInArrow(_confirm(width, percent), "a long, b long, with_hub boolean")


def _shared_keys(width: int, percent: int):
    """Rows (group, rep, text) -> (key, rep, spare): a row a shingle, and how many of its text's most common shingles a linked text may share alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group, rep = (batch.column(k).to_numpy() for k in range(2))
            for lo, _, scan in scans(batch.column(2), SMALL_BYTES):
                grams, texts = shingle_sets(scan, width)
                if not len(grams):
                    continue
                spare = -(-percent * np.bincount(texts, minlength=scan.n) // 100) - 1
                key = mix(grams ^ mix(group[lo + texts].view(np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(rep[lo + texts]), pa.array(spare[texts])], names=["key", "rep", "spare"])

    return run


def split_groups(large: DataFrame, width: int, percent: int) -> DataFrame:
    """node and component: the texts (group, rep, text) of large groups, connected where two share one of their rarest shingles.

    As in ``_Sets``, any linked pair does, rarity being counted in the whole group. A text without such company isn't linked with any and has no row.
    """
    rows = stored(large.select("group", "rep", "text").mapInArrow(_shared_keys(width, percent), "key long, rep long, spare long"), "group-keys")
    n_texts = large.count()
    counts = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("held", F.col("n"))
    common = join_facts(rows, counts, ["key"], "n", n_texts).where("held IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("held"), F.desc("key")))
    rare = stored(common.withColumn("place", place).where("place > spare").select("key", "rep"), "group-rare-keys")
    discard(rows)
    hubs = rare.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1")
    return components(join_facts(rare, hubs, ["key"], "n", n_texts).where("hub IS NOT NULL").select(F.col("rep").alias("a"), F.col("hub").alias("b")))


def _dealt(groups: DataFrame, group_texts: int, group_shingles: int) -> DataFrame:
    """Each rep's group, its number of texts, its smallest rep and of how many blocks which one is the rep's."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total"), F.min("rep").alias("hub"))
    parts = F.greatest(F.ceil(F.col("n") / group_texts), F.ceil(F.col("total") / group_shingles)).cast("int")
    dealt = join_facts(groups, sizes.select("component", parts.alias("parts"), "hub", "n", F.col("n").alias("n_group")), ["component"], "n", groups.count())
    block = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("rep", F.lit(3)), F.col("parts"))).otherwise(0).cast("int")
    return stored(dealt.select(F.col("component").alias("group"), "rep", "n_shingles", "parts", "hub", "n_group", block.alias("block")), "dealt")


def confirmed_edges(texts: DataFrame, groups: DataFrame, width: int, percent: int, group_texts: int = GROUP_TEXTS, group_shingles: int = GROUP_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """Labels (a: rep, b: smallest linked rep) of the groups linked in one task, and edges (a, b) of the others.

    texts: rep, text.  groups: rep, component (the candidate group) and n_shingles.
    """
    dealt = _dealt(groups, group_texts, group_shingles)
    rows = stored(flag_ids(texts, "rep", dealt.select("rep")).where("__may").drop("__may").join(dealt.drop("n_shingles"), "rep"), "group-texts")
    whole, large = rows.where("parts = 1"), rows.where("parts > 1")
    if not large.isEmpty():
        sizes = dealt.where("parts > 1").groupBy("rep").agg(F.max("n_shingles").alias("n_shingles"))
        again = _dealt(stored(split_groups(large, width, percent).withColumnRenamed("node", "rep").join(sizes, "rep"), "groups"), group_texts, group_shingles)
        rows = stored(large.select("rep", "text").join(again.drop("n_shingles"), "rep"), "group-texts")
        whole, large = whole.unionByName(rows.where("parts = 1")), rows.where("parts > 1")
    one_task = _blocks(whole.withColumn("side", F.lit(0)), width, percent).select("a", "b")
    if large.isEmpty():
        return one_task, one_task.limit(0)
    hubs = large.where(F.col("rep") == F.col("hub"))
    copies = hubs.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("at != block").drop("block").withColumnRenamed("at", "block")
    first = stored(_blocks(large.unionByName(copies).withColumn("side", F.lit(0)), width, percent), "group-edges")
    # what no block linked to the hub meets all blocks of its group, in chunks
    residual = stored(large.join(first.where("NOT with_hub").select(F.col("a").alias("rep")), "rep", "left_semi"), "group-residual")
    chunks = stored(residual.groupBy("group").agg(F.ceil(F.count("*") / group_texts).cast("int").alias("chunks"), F.max("n_group").alias("n")), "group-chunks")
    most = chunks.agg(F.max("n")).first()[0] or 0
    residual = join_facts(residual, chunks, ["group"], "n", most).withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(4)), F.col("chunks")).cast("int"))
    place = (F.col("at") * F.col("chunks") + F.col("chunk")).alias("block")
    right = residual.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("group", place, F.lit(1).alias("side"), "rep", "hub", "text")
    left = join_facts(large.withColumnRenamed("block", "at"), chunks, ["group"], "n", most).where("chunks IS NOT NULL").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("group", place, F.lit(0).alias("side"), "rep", "hub", "text")
    second = _blocks(left.unionByName(right), width, percent)
    return one_task, first.unionByName(second).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80, trees: int = TREES, levels: int = LEVELS, small: int = SMALL_NODE, group_texts: int = GROUP_TEXTS, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """id, n_shingles, component_id (the smallest id reachable by links of ``percent`` or more) and kept of every row, as a stored table; what was stored on the way is deleted."""
    with scratch() as kept:
        return kept(_classified(docs, id_col, text_col, width, percent, trees, levels, small, group_texts, group_shingles), "near-duplicates")


def _classified(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, trees: int, levels: int, small: int, group_texts: int, group_shingles: int) -> DataFrame:
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = stored(texts.mapInArrow(_sketch(width, trees), "id long, n_shingles long, h1 long, h2 long, sketch binary, tokens binary"), "sketches")
    full = sketches.where("n_shingles > 0 AND id IS NOT NULL")
    keys = ["h1", "h2", "n_shingles"]
    classes = full.groupBy(*keys).agg(F.min(F.struct("id", "sketch", "tokens")).alias("least"), F.count("*").alias("n"))
    classes = stored(classes.select(*keys, "n", F.col("least.id").alias("rep"), F.col("least.sketch").alias("sketch"), F.col("least.tokens").alias("tokens")), "classes")
    whole, sketches = sketches, stored(sketches.select("id", "n_shingles", "h1", "h2"), "sizes")  # the representatives' tokens are in the classes
    discard(whole)
    full = sketches.where("n_shingles > 0 AND id IS NOT NULL")
    gathered = components(candidate_edges(classes, trees=trees, levels=levels, small=small))
    groups = classes.select("rep", "n_shingles").join(gathered.withColumnRenamed("node", "rep"), "rep")
    labels, edges = confirmed_edges(texts.withColumnRenamed("id", "rep"), groups, width, percent, group_texts, group_shingles)
    shared = full.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")  # ids with several rows tie these rows' classes
    ties = stored(full.join(shared, "id").join(classes.select(*keys, "rep"), keys).select(F.col("id").alias("a"), F.col("rep").alias("b")), "ties")
    if not ties.isEmpty():
        edges, labels = edges.unionByName(labels).unionByName(ties), labels.limit(0)
    edges = stored(edges, "linked")
    if not edges.isEmpty():
        labels = labels.unionByName(components(edges).select(F.col("node").alias("a"), F.col("component").alias("b")))
    labels = classes.select(*keys, "n", "rep").join(labels.select(F.col("a").alias("rep"), F.col("b").alias("component")), "rep", "left")
    labels = labels.select(*keys, "n", F.coalesce("component", "rep").alias("component"))
    linked = join_facts(full.select("id", *keys), labels, keys, "n", full.count()).select("id", "n_shingles", "component")
    alone = sketches.where("n_shingles = 0 OR id IS NULL").select("id", "n_shingles", F.col("id").alias("component"))
    out = linked.unionByName(alone)
    return out.select("id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that represent their group, all columns; of rows that share a kept id the one with the smallest hash stays."""
    found = near_duplicates(docs, id_col, text_col, **options).where("id IS NOT NULL")
    ids = found.groupBy("id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    ids = stored(ids.where("NOT kept OR n > 1"), "near-duplicate-ids")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"))
    gone = ids.where("NOT kept").select("id")
    flagged = flag_ids(rows, "id", gone)
    rows = flagged.where("NOT __may").unionByName(flagged.where("__may").join(gone, "id", "left_anti")).select("row", "id")
    several = ids.where("kept").select("id")
    if not several.isEmpty():
        flagged = flag_ids(rows, "id", several)
        one = flagged.where("__may").join(several, "id", "left_semi").groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        rows = flagged.where("NOT __may").unionByName(flagged.where("__may").join(several, "id", "left_anti").select(*flagged.columns)).select("row").unionByName(one.select("row"))
    return rows.select(*(F.col(f"row.`{c}`") for c in docs.columns))
