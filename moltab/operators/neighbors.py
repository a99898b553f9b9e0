"""Exact k-nearest neighbours without a cross join.

1. *Equal points.* Of the points of a group that have the same vector only those with the
   smallest keys can be neighbours; the others are dropped before anything is paired.
2. *Cells.* A binary tree, split at medians of a sample, deals the points to cells of at
   most about ``CELL_ROWS``, however many they are; a small group stops higher up in the
   tree.  A node knows the box around its points.  A cell is cut the same way into leaves
   of about ``BLOCK_ROWS`` by the task that holds it.
3. *Own cell.* A query is compared with its own cell, own leaf first: its k-th distance
   there bounds the k-th distance of all.
4. *Others.* The query visits only the other cells and leaves whose box is within that
   bound, so the result is exact whatever the trees.  A query's lists, one per visit, are
   merged.

A task step holds the points of one cell and some of its visitors.  Queries go through all
of this in slices of ``SLICE_ROWS``, neighbouring cells together, and what a slice wrote and
shuffled is deleted before the next, so that disk does not grow with queries times visits.
Distances are screened by one product (with a margin for its rounding) and then computed
term by term.

``by`` restricts neighbours to the same group (e.g. one class).  Vectors that are null or
hold null or non-finite components have no neighbours and are none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, log2

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moltab.session import delete, importable, released, stored


def sq_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v)


#: Points that a leaf aims at, points sampled per cell, and the factor for leaves of
#: vectors of more than ``WIDE`` components, where boxes exclude little.
BLOCK_ROWS = 512
PIVOTS = 16
WIDE, WIDE_TIMES = 16, 8
#: Points and visitors that a task holds at most (about), and bytes of their vectors.
CELL_ROWS, VISITORS, CELL_BYTES = 1 << 15, 1 << 16, 1 << 24
#: Queries of a slice.
SLICE_ROWS = 1 << 21
#: Distances held at a time.
SCORES = 1 << 20


class Tree:
    """A complete binary tree of ``depth`` levels of splits, nodes numbered like a heap."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros((1 << depth) - 1, dtype=np.int32)
        self.at = np.full((1 << depth) - 1, np.inf)
        parts = {0: sample}
        for node in range(len(self.at)):
            x = parts.pop(node)
            if len(x):
                self.axis[node] = axis = int(x.std(axis=0).argmax())
                c = x[:, axis]
                # the median goes left; where it is the largest value, what is below it
                at = np.median(c)
                if at >= c.max() and (c < at).any():
                    at = c[c < at].max()
                self.at[node] = at
                left = c <= at
                x, y = x[left], x[~left]
            else:
                y = x
            parts[2 * node + 1], parts[2 * node + 2] = x, y

    def leaf(self, x: np.ndarray, full: np.ndarray | None = None, depth: int | None = None) -> np.ndarray:
        """The node, ``depth`` levels down, of every row; with ``full`` (a flag per node) one
        that has points."""
        node, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
        for _ in range(self.depth if depth is None else depth):
            right = x[rows, self.axis[node]] > self.at[node]
            node = 2 * node + 1 + right
            if full is not None:
                node = np.where(full[node], node, node + np.where(right, -1, 1))
        return node


def _box_distance(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    d = np.zeros(len(x))
    for j in range(x.shape[1]):
        d += np.maximum(np.maximum(low[:, j] - x[:, j], x[:, j] - high[:, j]), 0.0) ** 2
    return d


class Boxes:
    """The boxes around the points of one group, per node of ``depth`` levels of the tree."""

    def __init__(self, depth: int, nodes: np.ndarray, low: np.ndarray, high: np.ndarray):
        n = (2 << depth) - 1
        self.depth = depth
        self.low, self.high = np.full((n, low.shape[1]), np.inf), np.full((n, low.shape[1]), -np.inf)
        self.low[nodes], self.high[nodes] = low, high
        for level in range(depth - 1, -1, -1):
            at = np.arange((1 << level) - 1, (2 << level) - 1)
            self.low[at] = np.minimum(self.low[2 * at + 1], self.low[2 * at + 2])
            self.high[at] = np.maximum(self.high[2 * at + 1], self.high[2 * at + 2])
        self.full = self.low[:, 0] < np.inf

    def within(self, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, leaf)`` for all leaves that may hold a point within a row's bound."""
        limit = bound * bound * (1 + 1e-9) + 1e-12
        rows, nodes = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            rows, nodes = np.tile(rows, 2), np.concatenate([2 * nodes + 1, 2 * nodes + 2])
            near = self.full[nodes]
            rows, nodes = rows[near], nodes[near]
            near = _box_distance(x[rows], self.low[nodes], self.high[nodes]) <= limit[rows]
            rows, nodes = rows[near], nodes[near]
        return rows, nodes


def _first(i: np.ndarray, k: int, part: np.ndarray | None = None) -> np.ndarray:
    """Which entries, sorted by row ``i`` and distance, are among the first ``k`` of their
    row; with ``part`` whichever one part is left out."""
    start = np.searchsorted(i, i)
    at = np.arange(len(i)) - start
    if part is None or not len(i):
        return at < k
    seen = np.zeros((len(i) + 1, int(part.max()) + 1), dtype=np.int32)
    seen[np.arange(1, len(i) + 1), part] = 1
    seen = seen.cumsum(axis=0, dtype=np.int32)
    return at - (seen[:-1] - seen[start]).max(axis=1) < k


def _have(i: np.ndarray, n: int, k: int, part: np.ndarray | None = None) -> np.ndarray:
    """Which of ``n`` rows have ``k`` entries, with ``part`` whichever one part is left out."""
    have = np.bincount(i, minlength=n)
    if part is None or not len(i):
        return have >= k
    parts = int(part.max()) + 1
    return have - np.bincount(i * parts + part, minlength=n * parts).reshape(n, parts).max(axis=1) >= k


def nearest(q: np.ndarray, p: np.ndarray, k: int, q_code: np.ndarray | None = None,
            p_code: np.ndarray | None = None, bound: np.ndarray | None = None,
            part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, dist)``: the k nearest rows of ``p`` (ties to the first) of every row of ``q``,
    those of its own code and beyond its bound left out; with ``part`` (a number per row of
    ``p``) all that are among the k nearest whichever one part is left out."""
    if not len(q) or not len(p):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    found = []
    p_size = (p * p).sum(axis=1)
    more = int(np.bincount(p_code).max()) if p_code is not None else 0
    at = min(k + more if part is None else 2 * (k + more), len(p)) - 1
    step = max(1, SCORES // len(p))
    for low in range(0, len(q), step):
        x = q[low:low + step]
        x_size = (x * x).sum(axis=1)
        slack = 1e-11 * (x_size + p_size.max())     # more than the product's rounding
        d = x @ p.T
        d *= -2.0
        d += p_size
        d += x_size[:, None]
        limit = np.full(len(x), np.inf) if bound is None else bound[low:low + step] ** 2 * (1 + 1e-9) + 1e-12
        free = np.isinf(limit)
        if free.any():
            limit[free] = np.partition(d[free], at, axis=1)[:, at]
        while True:
            i, j = np.nonzero(~(d > (limit + 2 * slack)[:, None]))
            if q_code is not None:
                other = q_code[low + i] != p_code[j]
                i, j = i[other], j[other]
            short = free & np.isfinite(limit) if part is not None and at < len(p) - 1 else np.zeros(1, dtype=bool)
            if short.any():
                short &= ~_have(i, len(x), k, part[j])
            if not short.any():
                break
            limit[short] = np.inf      # seldom: too many of one part
        dist = np.zeros(len(i))
        for c in range(q.shape[1]):
            dist += (x[i, c] - p[j, c]) ** 2
        dist = np.sqrt(dist)
        real = np.isfinite(dist)
        i, j, dist = i[real], j[real], dist[real]
        order = np.lexsort((j, dist, i))
        i, j, dist = i[order], j[order], dist[order]
        keep = _first(i, k, None if part is None else part[j])
        found.append((low + i[keep], j[keep], dist[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _reach(i: np.ndarray, dist: np.ndarray, n: int, k: int, part: np.ndarray | None) -> np.ndarray:
    """The distance within which all wanted points of a row lie, as far as its entries tell."""
    bound = np.full(n, np.inf)
    have = _have(i, n, k, part)
    bound[have] = dist[np.searchsorted(i, np.flatnonzero(have), side="right") - 1]
    return bound


def nearest_in_leaves(q: np.ndarray, p: np.ndarray, k: int, q_code: np.ndarray | None = None,
                      p_code: np.ndarray | None = None, bound: np.ndarray | None = None,
                      part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`nearest` by the leaves of a tree over ``p``: own leaf first, then those within
    the bound."""
    rows = BLOCK_ROWS * (WIDE_TIMES if p.shape[1] > WIDE else 1)
    depth = ceil(log2(len(p) / rows)) if len(p) > rows else 0
    if not depth or not len(q):
        return nearest(q, p, k, q_code, p_code, bound, part)
    tree = Tree(p, depth)
    leaf = tree.leaf(p)
    order = np.argsort(leaf, kind="stable")
    nodes, start = np.unique(leaf[order], return_index=True)
    boxes = Boxes(depth, nodes, np.minimum.reduceat(p[order], start), np.maximum.reduceat(p[order], start))
    of = dict(zip(nodes.tolist(), np.split(order, start[1:])))
    found = []

    def meet(asked: np.ndarray, leaves: np.ndarray, bound: np.ndarray | None) -> None:
        by = np.argsort(leaves, kind="stable")
        cuts = np.flatnonzero(np.diff(leaves[by])) + 1
        for rows_ in np.split(by, cuts) if len(by) else ():
            a, b = asked[rows_], of[int(leaves[rows_[0]])]
            i, j, dist = nearest(q[a], p[b], k, None if q_code is None else q_code[a], None if p_code is None else p_code[b],
                                 None if bound is None else bound[a], None if part is None else part[b])
            found.append((a[i], b[j], dist))

    def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, dist = (np.concatenate(x) for x in zip(*found))
        by = np.lexsort((j, dist, i))
        i, j, dist = i[by], j[by], dist[by]
        keep = _first(i, k, None if part is None else part[j])
        return i[keep], j[keep], dist[keep]

    own = tree.leaf(q, boxes.full)
    if bound is None:
        meet(np.arange(len(q)), own, None)
        found[:] = [merged()]
        bound = _reach(found[0][0], found[0][2], len(q), k, None if part is None else part[found[0][1]])
    else:
        own = np.full(len(q), -1)
    for low in range(0, len(q), 8192):
        a, leaves = boxes.within(q[low:low + 8192], bound[low:low + 8192])
        a += low
        other = leaves != own[a]
        meet(a[other], leaves[other], bound)
    return merged() if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))


def _array(table, name: str) -> pa.Array:
    x = table.column(name)
    return x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x


def _matrix(table, dim: int) -> np.ndarray:
    return _array(table, "v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _search(q: pa.Table, p: pa.Table, dim: int, k: int, exclude_self: bool,
            bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
    """Rows of ``q``, distances, and the columns of ``p`` beside them."""
    more = [c for c in ("y", "part") if c in p.column_names]
    p = p.take(pc.sort_indices(p, sort_keys=[(c, "ascending") for c in ("id", *more)], null_placement="at_start"))
    p_ids, codes = _array(p, "id"), (None, None)
    if exclude_self:
        both = pa.concat_arrays([_array(q, "id").cast(p_ids.type), p_ids])
        code = both.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        codes = code[:q.num_rows], code[q.num_rows:]
    part = _array(p, "part").to_numpy() if "part" in more else None
    i, j, dist = nearest_in_leaves(_matrix(q, dim), _matrix(p, dim), k, *codes, bound, part)
    bound = _reach(i, dist, q.num_rows, k, None if part is None else part[j]) if bound is None else bound
    at = pa.array(j)
    return i, bound, {"d": pa.array(dist), **{n: _array(p, c).take(at) for n, c in (("p", "id"), *zip(more, more))}}


def _fewest(points: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """Of equal vectors the points that can be among k neighbours: the k smallest keys (of a
    part); with ``exclude_self`` as many after any one key is left out."""
    more = [c for c in ("y", "part") if c in points.columns]
    same = Window.partitionBy("g", F.xxhash64("v"), "v", *more[1:])
    if not exclude_self:
        w = same.orderBy("id", *more[:1])
        return points.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
    ids = points.groupBy("g", "v", "id", *more).agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    return ids.withColumn("r", F.dense_rank().over(same.orderBy("id"))).where(F.col("r") <= k + 1) \
        .withColumn("n", F.explode(F.array_repeat("id", F.col("n")))).select("g", "id", "v", *more)


def usable(df: DataFrame) -> DataFrame:
    """Rows whose vector ``v`` is there and finite."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col("v").isNotNull() & finite)


def neighbour_lists(asked: DataFrame, points: DataFrame, k: int, exclude_self: bool = False,
                    dim: int | None = None) -> DataFrame | None:
    """Every row of ``asked`` (``g, id, v`` and other columns) with ``near``: its k nearest
    ``points`` (``g, id, v``) of its group as an array of ``d`` (distance), ``p`` (key),
    sorted by both.  Points may have a number ``y``, that the entries then hold instead, and
    with it a ``part``: the array then holds all points that are among the k nearest
    whichever one part is left out.  None if there are no points.
    """
    spark = points.sparkSession
    importable(spark)
    kinds = dict(points.dtypes)
    more = [c for c in ("y", "part") if c in kinds]
    entry = [("d", "double"), ("p", kinds["id"]), *[(c, kinds[c]) for c in more]]
    point_kind = ", ".join(f"{c} {kinds[c]}" for c in ("g", "id", "v", *more))
    lists_kind = ", ".join(f"{c}s array<{t}>" for c, t in entry)
    near = F.arrays_zip(*[F.col(f"{c}s").alias(c) for c, _ in entry])
    columns = [c for c in asked.columns if c != "v"]

    with released(spark) as keep:
        few = stored(_fewest(points.select("g", "id", "v", *more), k, exclude_self), "knn-points")
        counts = {r["g"]: r["n"] for r in few.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not counts:
            return None
        dim = dim or len(few.select("v").first()["v"])
        rows = BLOCK_ROWS * (WIDE_TIMES if dim > WIDE else 1)
        total = sum(counts.values())
        cell = max(rows, min(CELL_ROWS, CELL_BYTES // (8 * dim), total // (4 * spark.sparkContext.defaultParallelism)))
        visitors = max(4 * rows, min(VISITORS, CELL_BYTES // (8 * dim)))
        depths = {g: max(0, ceil(log2(n / cell))) for g, n in counts.items()}
        depth = max(depths.values())
        sample = np.zeros((0, dim))
        if depth:
            every = max(1, total // (PIVOTS << depth))
            kept = few.where(F.pmod(F.xxhash64("v", "id"), F.lit(every)) == 0).select("v").toArrow()
            sample = _matrix(kept, dim)
        tree = spark.sparkContext.broadcast((Tree(sample, depth), depths))

        def dealer(boxes=None):
            def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                t, deep = tree.value
                for b in batches:
                    x, g = _matrix(b, dim), b.column("g").to_numpy()
                    leaf = np.full(len(x), -1, dtype=np.int64)
                    for one in np.unique(g):
                        if one in deep:
                            leaf[g == one] = t.leaf(x[g == one], boxes and boxes.value[one].full, deep[one])
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf)], names=[*b.schema.names, "leaf"])
            return deal

        dealt = stored(few.mapInArrow(dealer(), f"{point_kind}, leaf long"), "knn-dealt")
        delete(spark, few.stored_at)
        sides = dealt.groupBy("g", "leaf").agg(F.array(*[F.min(F.col("v")[c]) for c in range(dim)]).alias("low"),
                                               F.array(*[F.max(F.col("v")[c]) for c in range(dim)]).alias("high")).toArrow()
        side_g, side_leaf = (sides.column(c).to_numpy() for c in ("g", "leaf"))
        low, high = (_array(sides, c).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for c in ("low", "high"))
        boxes = spark.sparkContext.broadcast({int(g): Boxes(depths[g], side_leaf[side_g == g], low[side_g == g], high[side_g == g])
                                              for g in np.unique(side_g)})

        # rows get their numbers here, once
        asked = asked.withColumn("row", F.monotonically_increasing_id())
        kind = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
        placed = stored(asked.mapInArrow(dealer(boxes), ", ".join(f"`{c}` {t}" for c, t in kind.items()) + ", leaf long")
                        .where("leaf >= 0"), "knn-placed")
        told = sorted((r["g"], r["leaf"], r["n"]) for r in placed.groupBy("g", "leaf").agg(F.count(F.lit(1)).alias("n")).collect())
        slices, full = [], SLICE_ROWS
        for g, leaf, n in told:       # cells in order: those of a slice are neighbours
            if full >= SLICE_ROWS:
                slices.append([])
                full = 0
            slices[-1].append((g, leaf, n))
            full += n

        def cuts_of(seen) -> DataFrame:
            return F.broadcast(spark.createDataFrame([(g, leaf, -(-n // visitors)) for g, leaf, n in seen], "g int, leaf long, cuts long"))

        def met(x: DataFrame, seen):
            """Every cell beside its visitors, so many at a time."""
            x = x.join(cuts_of(seen), ["g", "leaf"]).withColumn("cut", F.col("row") % F.col("cuts")).drop("cuts")
            y = dealt.join(cuts_of(seen), ["g", "leaf"]) \
                .withColumn("cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))).drop("cuts")
            return x.groupBy("g", "leaf", "cut").cogroup(y.groupBy("g", "leaf", "cut"))

        def lists(i: np.ndarray, n: int, entries: dict[str, pa.Array]) -> dict[str, pa.Array]:
            at = pa.array(np.searchsorted(i, np.arange(n + 1)), pa.int32())
            return {f"{c}s": pa.ListArray.from_arrays(at, x) for c, x in entries.items()}

        def first(q: pa.Table, p: pa.Table) -> pa.Table:
            i, bound, entries = _search(q, p, dim, k, exclude_self)
            return pa.table({**{c: _array(q, c) for c in (*columns, "row", "v", "leaf")}, "bound": bound,
                             **lists(i, q.num_rows, entries)})

        def second(q: pa.Table, p: pa.Table) -> pa.Table:
            i, _, entries = _search(q, p, dim, k, exclude_self, q.column("bound").to_numpy())
            hit, i = np.unique(i, return_inverse=True)
            return pa.table({"row": _array(q, "row").take(pa.array(hit)), **lists(i, len(hit), entries)})

        def visits(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            x, g, own = _matrix(b, dim), b.column("g").to_numpy(), b.column("leaf").to_numpy()
            bound = b.column("bound").to_numpy()
            for one in np.unique(g):
                mine = np.flatnonzero(g == one)
                for at in range(0, len(mine), 1024):
                    some = mine[at:at + 1024]
                    r, leaf = boxes.value[one].within(x[some], bound[some])
                    other = leaf != own[some[r]]
                    yield int(one), some[r][other], leaf[other]

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for one, _, leaf in visits(b):
                    cells, n = np.unique(leaf, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), one, np.int32)), pa.array(cells),
                                                      pa.array(n.astype(np.int64))], names=["g", "leaf", "n"])

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, r, leaf in visits(b):
                    for low in range(0, len(r), 4096):
                        part = b.select(["g", "row", "id", "v", "bound"]).take(pa.array(r[low:low + 4096]))
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(leaf[low:low + 4096])],
                                                         names=[*part.schema.names, "leaf"])

        own_kind = ", ".join(f"`{c}` {kind[c]}" for c in (*columns, "row", "v"))
        visit_kind = f"g int, row long, id {kind['id']}, v array<double>, bound double, leaf long"
        out = []
        for cells in slices:
            with released(spark) as keep_slice:
                here = placed
                if len(slices) > 1:
                    (g0, l0, _), (g1, l1, _) = cells[0], cells[-1]
                    here = placed.where((F.struct("g", "leaf") >= F.struct(F.lit(g0).alias("g"), F.lit(l0).cast("long").alias("leaf")))
                                        & (F.struct("g", "leaf") <= F.struct(F.lit(g1).alias("g"), F.lit(l1).cast("long").alias("leaf"))))
                begun = stored(met(here, cells).applyInArrow(first, f"{own_kind}, leaf long, bound double, {lists_kind}"), "knn-first")
                away = begun.select("g", "row", "id", "v", "bound", "leaf")
                seen = away.mapInArrow(counted, "g int, leaf long, n long").groupBy("g", "leaf").agg(F.sum("n").alias("n")).collect()
                both = begun.select(*columns, "row", near.alias("near"))
                if seen:
                    there = met(away.mapInArrow(visit, visit_kind), [tuple(r) for r in seen]) \
                        .applyInArrow(second, f"row long, {lists_kind}")
                    both = both.unionByName(there.select("row", near.alias("near")), allowMissingColumns=True)
                    both = both.groupBy("row").agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns],
                                                   F.flatten(F.collect_list("near")).alias("near"))
                best = F.sort_array("near")
                if "part" not in more:
                    best = F.slice(best, 1, k)
                if more:
                    best = F.transform(best, lambda e: F.struct(*[e[c].alias(c) for c in more]))
                out.append(keep(keep_slice(stored(both.select(*columns, best.alias("near")), "knn-lists"))))
        if not out:
            return None
        return spark.read.schema(out[0].schema).parquet(*[x.stored_at for x in out])


def knn(queries: DataFrame, points: DataFrame, key: str, vec: str, k: int, by: Sequence[str] = (),
        dim: int | None = None, exclude_self: bool = False) -> DataFrame:
    """``(by…, q, p, dist, rank)``: the k nearest ``points`` of every query (Euclidean,
    ties to the smaller key).

    ``vec`` is an ``ARRAY<DOUBLE>`` column.  With ``exclude_self`` a point
    is not its own neighbour (same key), as in SMOTE and leave-self-out kNN.
    """
    by, spark = list(by), points.sparkSession

    def flat(df: DataFrame) -> DataFrame:
        return usable(df.select(*[F.col(c).alias(f"by_{c}") for c in by], F.col(key).alias("id"),
                                F.col(vec).cast("array<double>").alias("v")))

    # groups (few, like classes) get numbers
    names = [f"by_{c}" for c in by]
    sizes = flat(points).groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    sizes = sorted(sizes.collect(), key=lambda r: (-r["n"], str(r)))
    kinds = dict(points.dtypes)
    groups = spark.createDataFrame([(g, *[r[c] for c in names]) for g, r in enumerate(sizes)],
                                   ", ".join(["g int", *[f"`by_{c}` {kinds[c]}" for c in by]])) if by else None

    def numbered(df: DataFrame) -> DataFrame:
        if groups is None:
            return df.select(F.lit(0).alias("g"), "id", "v")
        of = groups.select("g", *[F.col(c).alias(f"_{c}") for c in names])
        return df.join(F.broadcast(of), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]).select("g", "id", "v")

    lists = None
    if sizes and sizes[0]["n"]:
        lists = neighbour_lists(numbered(flat(queries)), numbered(flat(points)), k, exclude_self, dim)
    if lists is None:
        return queries.select(*by, F.col(key).alias("q")).where(F.lit(False)) \
            .select(*by, "q", F.col("q").alias("p"), F.lit(0.0).alias("dist"), F.lit(1).alias("rank"))
    found = lists.select("g", F.col("id").alias("q"), F.explode("near").alias("e")) \
        .select("g", "q", F.col("e.p").alias("p"), F.col("e.d").alias("dist"))
    # the rows of a repeated key are ranked together
    w = Window.partitionBy("g", "q").orderBy("dist", "p")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if groups is not None:
        best = best.join(F.broadcast(groups), "g")
    return best.select(*[F.col(f"by_{c}").alias(c) for c in by], "q", "p", "dist", "rank")


def _outcomes(y: np.ndarray, null: np.ndarray, row: np.ndarray, rank: np.ndarray, n: int, ks: Sequence[int],
              regression: bool) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """Per k: which of ``n`` rows have neighbours, the predictions and the shares of class 1,
    from the labels ``y`` of the rows' neighbours at their ranks."""
    most = max(ks)
    some = rank < most
    y, null, row, rank = y[some], null[some], row[some], rank[some]

    def counted(which: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros((n, most), dtype=np.int64 if values is None else np.float64)
        out[row[which], rank[which]] = 1 if values is None else values[which]
        return out.cumsum(axis=1)

    have = counted(np.ones(len(y), dtype=bool))
    if regression:
        total, valid = counted(~null, y), counted(~null)
    else:
        of = [(None, counted(null))] if null.any() else []
        of += [(c, counted(~null & ((y == c) | (np.isnan(y) & np.isnan(c))))) for c in np.unique(y[~null])]
        ones = counted(~null & (y == 1))
    for k in ks:
        told = have[:, k - 1] > 0
        if regression:
            m = valid[:, k - 1]
            yield told, pa.array(total[:, k - 1] / np.maximum(m, 1), mask=m == 0), np.zeros(n)
            continue
        best, votes, none = np.zeros(n), np.full(n, -1), np.zeros(n, dtype=bool)
        for c, v in of:       # the smallest class on ties
            more = v[:, k - 1] > votes
            votes, none = np.where(more, v[:, k - 1], votes), np.where(more, c is None, none)
            best = np.where(more, 0.0 if c is None else c, best)
        yield told, pa.array(best, mask=none), ones[:, k - 1] / np.maximum(have[:, k - 1], 1)


def predictions(lists: DataFrame, ks: Sequence[int], regression: bool, others: Sequence[str], folds: int = 0) -> DataFrame:
    """kNN models of several k from one search: mean label (regression) or the majority class
    (smallest label on ties) with its share of class 1: ``cand_id`` (place in ``ks``),
    ``split``, the columns ``others`` and ``prediction, prob1``.  With ``folds`` each of the
    splits leaves out the points of that part; else there is one split, -1."""
    kind = dict(lists.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 4096):
                b = whole.slice(low, 4096)
                ys, n = b.column("_y"), b.num_rows
                size = pc.fill_null(pc.list_value_length(ys), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat = ys.flatten()
                null = flat.is_null().to_numpy(zero_copy_only=False)
                y = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
                row, start = np.repeat(np.arange(n), size), np.cumsum(size) - size
                for f in range(folds) if folds else (-1,):
                    in_ = b.column("_t").flatten().to_numpy(zero_copy_only=False) != f if folds else np.ones(len(y), dtype=bool)
                    seen = np.concatenate([[0], np.cumsum(in_)])
                    rank = (seen[:-1] - seen[start[row]])[in_]
                    for cand, (told, pred, prob) in enumerate(_outcomes(y[in_], null[in_], row[in_], rank, n, ks, regression)):
                        at = pa.array(np.flatnonzero(told))
                        m = len(at)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(m, cand, np.int32)), pa.array(np.full(m, f, np.int32)),
                             *[b.column(c).take(at) for c in others], pred.take(at), pa.array(prob).take(at)],
                            names=["cand_id", "split", *others, "prediction", "prob1"])

    read = lists.select(*others, F.col("near.y").alias("_y"), *([F.col("near.part").alias("_t")] if folds else []))
    out = read.mapInArrow(run, ", ".join(["cand_id int, split int", *[f"`{c}` {kind[c]}" for c in others], "prediction double, prob1 double"]))
    return out.drop("prob1") if regression else out


def knn_predict(train: DataFrame, test: DataFrame, key: str, vec: str, label: str, k: int,
                regression: bool = False, exclude_self: bool = False, dim: int | None = None) -> DataFrame:
    """kNN model: mean label (regression) or class shares with the majority class
    (smallest label on ties).  ``(key, prediction, prob1)``"""
    rows = [usable(df.select(F.lit(0).alias("g"), F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v"), *more))
            for df, more in ((test, []), (train, [F.col(label).cast("double").alias("y")]))]
    lists = neighbour_lists(*rows, k, exclude_self, dim)
    if lists is None:
        none = test.select(key, F.lit(0.0).alias("prediction"), F.lit(0.0).alias("prob1")).where(F.lit(False))
        return none.drop("prob1") if regression else none
    return predictions(lists, [k], regression, ["id"]).drop("cand_id", "split").withColumnRenamed("id", key)
