"""Embedding near-duplicates with a forest of random-projection trees.

Each tree splits the vectors again and again by their projection on a random direction, near
the median, where few lie close to the limit; a vector within a margin of a split goes down both sides (spill), so a near pair
that a split would part usually stays together on one of them. Vectors are compared only
within leaves, every candidate is verified by its cosine in double precision, and what many
trees find is united.

The trees' tops are fitted on a bounded sample of distinct vectors (SAMPLE_FLOATS numbers at most,
documented and a parameter), and every vector goes through them; a vector of a dimension that
the sample lacks goes to a leaf for that dimension. A leaf that turns out to have more than
twice LEAF_ROWS members is split again on the executors, by a subtree that is fitted on a sample of its
own members, of SPLIT_ROWS about, and so on until no leaf is larger or splits no longer part one. So leaves
have a bounded size whatever the number of vectors, and work grows in line with it, but for
vectors so close to one another that no split parts them: these are compared with one another, in cells
of bounded size in which each two meet once. Equal vectors are one class, so copies are
never compared with one another.

Leaves are found, counted and split on narrow rows (class, leaf); the vectors, packed as
32-bit floats where these hold them exactly, and as 64-bit ones otherwise, move to the leaves once, and to oversized leaves once
for each time that these are split. No list of pairs leaves a task. A class goes to a leaf with
the leaves of earlier trees that it is in, so the task of a leaf knows whether a pair met before
and counts it in the first tree only; tasks send out counts, and the links as a spanning forest
of what they have merged.

Inputs: vectors that are null, zero, empty, or have null or non-finite components link with
nothing: n_links 0, component_id their own vec_id. Vectors of different length don't link.
Rows that repeat a vec_id are vectors of their own. A null vec_id takes part in linking; a
component's id is its least non-null vec_id. ``kept`` is false for a null vec_id. An empty
table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litlode.llm.common import cut, grouped_batches, map_batches, small_side, split_hot_keys
from litlode.llm.components import components, merge_pairs

LEAST_COSINE = 0.95
TREES = 8
#: Numbers in the fitting sample, vectors of a leaf (of all, about), splits above a leaf at most.
SAMPLE_FLOATS, LEAF_ROWS, DEPTH = 2_000_000, 512, 24
#: Half the spill's width, in standard deviations of what a projection differs by for a pair at the least cosine.
#: A split then parts about 5 in 100 pairs at just the least cosine (64 dimensions), and sends 6 in 100 vectors down
#: both sides: over 9 levels one tree keeps 63 in 100 such pairs together, and 8 trees all but 4 in 10,000.
SPILL = 0.25
#: Random directions that a split chooses from.
DIRECTIONS = 4
#: Members of an oversized leaf that its subtree is fitted on, about; members that one task routes, about; times that leaves are split again at most.
SPLIT_ROWS, ROUTE_ROWS, ROUNDS = 4096, 200_000, 8
#: Members of the fitting sample in a leaf, at least.
LEAF_SAMPLE = 16
BLOCK = 1024


@dataclass
class Tree:
    """Nodes in arrays; a leaf has no direction. children: left and right; margin: half the spill."""

    directions: list[np.ndarray | None] = field(default_factory=list)
    limits: list[float] = field(default_factory=list)
    children: list[tuple[int, int]] = field(default_factory=list)
    margin: float = 0.0

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for each leaf that a row of unit vectors x reaches."""
        rows, leaves, todo = [], [], [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if self.directions[node] is None:
                rows.append(at)
                leaves.append(np.full(len(at), node))
                continue
            p = x[at] @ self.directions[node] - self.limits[node]
            for child, mine in zip(self.children[node], (p <= self.margin, p >= -self.margin), strict=True):
                if mine.any():
                    todo.append((child, at[mine]))
        return (np.concatenate(rows), np.concatenate(leaves)) if rows else (np.empty(0, int), np.empty(0, int))


def fit_tree(sample: np.ndarray, leaf: int, least_cosine: float, rng: np.random.Generator) -> Tree:
    """A tree over unit vectors ``sample`` with up to ``leaf`` of them in a leaf, where splits can part them."""
    d = sample.shape[1]
    tree = Tree(margin=SPILL * float(np.sqrt(2 - 2 * least_cosine) / np.sqrt(d)))

    def grow(at: np.ndarray, depth: int) -> int:
        node = len(tree.directions)
        tree.directions.append(None)
        tree.limits.append(0.0)
        tree.children.append((-1, -1))
        if len(at) <= leaf or depth >= DEPTH:
            return node
        best = (2.0, None, 0.0)
        for _ in range(DIRECTIONS):  # of a few random splits the one that the fewest vectors lie close to
            direction = rng.standard_normal(d)
            direction /= np.linalg.norm(direction)
            p = np.sort(sample[at] @ direction)
            limits = p[(len(p) * np.linspace(0.3, 0.7, 41)).astype(int)]
            close = np.searchsorted(p, limits + tree.margin, side="right") - np.searchsorted(p, limits - tree.margin)
            k = int(np.argmin(close))
            best = min(best, (close[k] / len(p), direction, float(limits[k])), key=lambda x: x[0])
        _, direction, limit = best
        p = sample[at] @ direction
        left, right = at[p <= limit + tree.margin], at[p >= limit - tree.margin]
        if max(len(left), len(right)) > 0.9 * len(at):  # the split parts too little to be worth its copies
            return node
        tree.directions[node], tree.limits[node] = direction, limit
        tree.children[node] = grow(left, depth + 1), grow(right, depth + 1)
        return node

    grow(np.arange(len(sample)), 0)
    return tree


def unit_rows(packed: pa.Array | pa.ChunkedArray, wide: bool) -> list[np.ndarray]:
    """Each packed vector as a unit vector in double precision."""
    kind = "<f8" if wide else "<f4"
    told = []
    for x in packed.to_pylist():
        v = np.frombuffer(x, dtype=kind).astype(np.float64)
        v = v / np.abs(v).max()
        told.append(v / np.linalg.norm(v))
    return told


def packed(classes: DataFrame, wide: bool) -> DataFrame:
    """(node, size, first_id, vector, packed): the vector as little-endian floats as well."""
    kind = "<f8" if wide else "<f4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("vector")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            rows = [flat[s:e].tobytes() for s, e in zip([0, *ends], ends, strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(rows, pa.binary())], names=["node", "packed"])

    return map_batches(classes.select("node", "vector"), run, "node long, packed binary")


def leaves(vectors: DataFrame, forest: dict[int, list[Tree]], wide: bool) -> DataFrame:
    """(node, dim, leaf) for each leaf at the trees' tops that a class of ``vectors(node, packed)`` reaches; leaf is tree x 2^56 + number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = unit_rows(b.column("packed"), wide)
            dims = np.array([len(v) for v in units])
            rows, found = [], []
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                x = np.stack([units[k] for k in at])
                for t, tree in enumerate(forest.get(int(d), [Tree([None], [0.0], [(-1, -1)])])):  # a dimension that the sample lacks: one leaf
                    row, leaf = tree.route(x)
                    rows.append(at[row])
                    found.append((t << 56) + leaf)
            rows, found = np.concatenate(rows), np.concatenate(found)
            yield pa.RecordBatch.from_arrays([b.column("node").take(pa.array(rows)), pa.array(dims[rows].astype(np.int32)), pa.array(found.astype(np.int64))], names=["node", "dim", "leaf"])

    return map_batches(vectors.select("node", "packed"), run, "node long, dim int, leaf long")


def split_again(members: DataFrame, vectors: DataFrame, sizes: DataFrame, least_cosine: float, wide: bool, seed: int) -> DataFrame:
    """(node, dim, leaf, final) of the ``members`` (node, dim, leaf) of the leaves in ``sizes`` (dim, leaf, n), each split by a subtree of its own.

    A leaf's members are dealt to tasks of about ROUTE_ROWS; the sample that its subtree is fitted on
    goes ahead of them to each of these tasks, which so come to the same subtree. A new leaf's
    number keeps the tree's and hashes the rest; a leaf that can't be parted is final.
    """
    by = ["dim", "leaf", "deal"]
    whole = members.join(small_side(sizes), ["dim", "leaf"]).join(vectors, "node").withColumn("mix", F.xxhash64(F.lit(seed), "packed"))
    deals = F.ceil(F.col("n") / ROUTE_ROWS).cast("int")
    columns = ["node", "dim", "leaf", "n", "mix", "packed"]
    own = whole.select(*columns, F.pmod("mix", deals).cast("int").alias("deal"), F.lit(1).alias("late"))
    chosen = F.pmod(F.xxhash64(F.lit(seed + 1), "packed"), F.lit(1 << 30)) < F.lit(float(SPLIT_ROWS << 30)) / F.col("n")
    some = whole.filter(chosen).select(*columns, F.explode(F.sequence(F.lit(0), deals - 1)).alias("deal"), F.lit(0).alias("late"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sample, tree = None, [], None
        for b in batches:
            codes = np.stack([b.column(k).to_numpy().astype(np.int64) for k in (*by, "late")])
            bounds = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                own = tuple(codes[:3, lo].tolist())
                if own != key:
                    key, sample, tree = own, [], None
                units = np.stack(unit_rows(b.column("packed").slice(lo, hi - lo), wide))
                if not codes[3, lo]:
                    sample.append(units)
                    continue
                if tree is None:
                    fitted = np.concatenate(sample) if sample else units[:0]
                    leaf = max(LEAF_SAMPLE, LEAF_ROWS * len(fitted) // b.column("n")[lo].as_py())
                    tree = fit_tree(fitted, leaf, least_cosine, np.random.default_rng((seed, *key[:2])))
                row, found = tree.route(units)
                alone = len(tree.directions) == 1
                inner = _mixed(found.astype(np.uint64) + np.uint64(key[1] * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                number = np.full(len(row), key[1]) if alone else (key[1] >> 56 << 56) + (inner >> np.uint64(8)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column("node").slice(lo, hi - lo).take(pa.array(row)), pa.array(np.full(len(row), key[0], dtype=np.int32)), pa.array(number), pa.array(np.full(len(row), alone))], names=["node", "dim", "leaf", "final"])

    order = [*by, "late", "mix", "packed"]
    return map_batches(own.union(some).repartition(*by).sortWithinPartitions(*order), run, "node long, dim int, leaf long, final boolean")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bounded_leaves(vectors: DataFrame, forest: dict[int, list[Tree]], least_cosine: float, wide: bool, seed: int) -> DataFrame:
    """(node, dim, leaf) with every leaf that splits can part down to a bounded size; materialised."""
    whole = cut(leaves(vectors, forest, wide))
    done = None
    for level in range(ROUNDS):
        sizes = whole.groupBy("dim", "leaf").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * LEAF_ROWS)
        large = cut(sizes)
        if large.isEmpty():
            break
        fine = whole.join(small_side(large.select("dim", "leaf")), ["dim", "leaf"], "left_anti").select("node", "dim", "leaf")
        parted = cut(split_again(whole, vectors, large, least_cosine, wide, seed + 1000 * (level + 1)))
        kept = fine.union(parted.filter("final").select("node", "dim", "leaf"))
        done = kept if done is None else done.union(kept)
        whole = parted.filter("not final").select("node", "dim", "leaf")
    return whole if done is None else cut(done.union(whole))


def earlier_leaves(lists: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A bit set for each row: the leaves in its list; two rows met before if their sets meet."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    seen, place = np.unique(flat, return_inverse=True)
    bits = np.zeros((len(lists), -(-max(1, len(seen)) // 64) * 64), dtype=np.uint8)
    bits[rows, place] = 1
    return np.packbits(bits, axis=1).view(np.uint64)


def compare_leaf(x: np.ndarray, part: np.ndarray, cross: bool, least_cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of unit rows at the least cosine or above; in a crossed cell only between parts."""
    n = len(x)
    for lo in range(0, n, BLOCK):
        hi = min(n, lo + BLOCK)
        for a in range(lo, n, BLOCK):
            i, j = np.nonzero(x[lo:hi] @ x[a : a + BLOCK].T >= least_cosine - 1e-9)
            i, j = i + lo, j + a
            fine = i < j
            if cross:
                fine &= part[i] != part[j]
            i, j = i[fine], j[fine]
            if len(i):  # the block product may round otherwise than one pair's
                exact = np.einsum("ij,ij->i", x[i], x[j]) >= least_cosine
                yield i[exact], j[exact]


def leaf_links(cells: DataFrame, least_cosine: float, wide: bool) -> DataFrame:
    """(node, other, links): other is set for an edge of the spanning forest, links is what to add to a node's count."""
    by = ["dim", "leaf", "cell_a", "cell_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped_batches(batches, by, least=4096):
            codes = np.stack([table.column(k).to_numpy().astype(np.int64) for k in by])
            bounds = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if hi - lo < 2:
                    continue
                group = table.slice(lo, hi - lo)
                x = np.stack(unit_rows(group.column("packed"), wide))
                node, size, part = (group.column(k).to_numpy() for k in ("node", "size", "part"))
                before = earlier_leaves(group.column("homes"))
                parent, added = np.arange(hi - lo), np.zeros(hi - lo, dtype=np.int64)
                for i, j in compare_leaf(x, part, bool(codes[2, lo] != codes[3, lo]), least_cosine):
                    parent = merge_pairs(parent, i, j)
                    for s in range(0, len(i), 65536):
                        a, b = i[s : s + 65536], j[s : s + 65536]
                        new = ~(before[a] & before[b]).any(axis=1)
                        added += np.bincount(a[new], weights=size[b[new]], minlength=hi - lo).astype(np.int64)
                        added += np.bincount(b[new], weights=size[a[new]], minlength=hi - lo).astype(np.int64)
                child, counted = np.flatnonzero(parent != np.arange(hi - lo)), np.flatnonzero(added)
                if len(child) or len(counted):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate((node[child], node[counted]))), pa.concat_arrays([pa.array(node[parent[child]], pa.int64()), pa.nulls(len(counted), pa.int64())]), pa.array(np.concatenate((np.zeros(len(child), np.int64), added[counted])))],
                        names=["node", "other", "links"],
                    )

    dealt = cells.select("node", "size", "packed", "homes", "part", *by).repartition(*by).sortWithinPartitions(*by)
    return map_batches(dealt, run, "node long, other long, links long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least_cosine: float = LEAST_COSINE, trees: int = TREES, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``df``."""
    vector = F.col(vector_col).cast("array<double>")
    fine = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = df.select(F.col(id_col).alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), vector).alias("vector"))
    distinct = rows.filter("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("size"))
    classes = cut(distinct.withColumn("node", F.monotonically_increasing_id()))
    told = classes.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("widest"), F.max(F.exists("vector", lambda x: x.cast("float").cast("double") != x)).alias("wide")).first()
    n, wide = told["n"], bool(told["wide"])
    most = max(1, SAMPLE_FLOATS // (told["widest"] or 1))
    sample = [np.array(r["vector"]) for r in classes.orderBy(F.xxhash64(F.lit(seed), "vector"), "vector").limit(most).select("vector").collect()]  # bounded by SAMPLE_FLOATS
    forest: dict[int, list[Tree]] = {}
    for d in {len(v) for v in sample}:
        x = np.stack([v / np.abs(v).max() for v in sample if len(v) == d])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        leaf = max(LEAF_SAMPLE, LEAF_ROWS * len(sample) // max(n, 1))
        forest[d] = [fit_tree(x, leaf, least_cosine, np.random.default_rng((seed, d, t))) for t in range(trees)]
    vectors = cut(packed(classes, wide))
    found = bounded_leaves(vectors, forest, least_cosine, wide, seed)
    homes = found.groupBy("node").agg(F.array_sort(F.collect_set("leaf")).alias("homes"), F.first("dim").alias("dim"))  # some leaves of each tree
    rows_of = classes.select("node", "size").join(vectors, "node").join(homes, "node")
    rows_of = rows_of.select("node", "size", "packed", "dim", "homes", F.explode("homes").alias("leaf"))
    rows_of = rows_of.withColumn("homes", F.filter("homes", lambda h: h < F.col("leaf")))  # those before
    cells = split_hot_keys(rows_of, ["dim", "leaf"], "node")
    links = cut(leaf_links(cells, least_cosine, wide))
    roots = components(links.filter("other is not null"), "node", "other")
    counts = links.filter("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("node", "first_id", "size").join(counts, "node", "left").join(roots, "node", "left")
    least = known.filter("root is not null").groupBy("root").agg(F.min("first_id").alias("least_id"))
    labelled = known.join(least, "root", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("least_id", "first_id").alias("component_id"))
    answers = cut(classes.select("node", "vector").join(labelled, "node").select("vector", "n_links", "component_id"))
    out = rows.join(answers, "vector", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vector").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
