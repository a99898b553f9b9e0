"""Hard-negative mining by threshold joins with suffix-norm bounds (L2AP).

Vectors are quantised to ``floor(256 * x)`` and scored by integer inner product.  Two
threshold joins of the anchors with all rows follow each other:

1. positives: the ``k_pos`` best other rows of the anchor's label;
2. negatives: for each positive with score p the ``k_neg`` best rows of another label whose
   score lies in the window ``[lo_share * p, hi_share * p]``.

A join finds, for every open window, the best rows with a score of at least the window's
threshold.  A window that got all the rows it wants is full: nothing below the threshold
can change it.  The others are joined again with a lower threshold, the last one being the
window's own lower end, so the result is exact.

Inside a task the candidates are an inverted index by dimension blocks, the dimensions with
the largest mass first.  A candidate leaves the lists of all dimensions from which on its
remaining norm times any anchor's cannot reach a threshold alone (the suffix-norm bound of
L2AP).  Partial scores are accumulated list by list; a pair is dropped once its partial
score and the product of the remaining norms stay below the threshold, and the few pairs
left get the dimensions that the index omits.  Thresholds also rise inside a task with the
rows already found for a window.

Placement: a cell is one group of about ``GROUP`` anchors and one share of the rows.  The
anchors of a cell are held, its candidates stream by, so memory does not grow with the
table; what leaves a cell are ``k`` rows per window.

Rows whose id, label or vector is null, whose vector is empty or holds a null or non-finite
component take no part.  Vectors of different lengths never meet.  "Other" rows are rows
with another id.  Repeated rows are candidates of their own (a positive that occurs twice is
returned twice) and one anchor; rows of one id with different labels or vectors are anchors
of their own.  Equal scores are ordered by id, equal ids by nothing (their rows are alike
in the result).  Scores that could leave 62 bits raise.  An empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moltab.llm.common import importable, staged, table

#: Anchors held by a task, anchors and candidates scored at a time, dimensions of a list.
GROUP = 8192
ANCHOR_BLOCK = 512
CANDIDATE_BLOCK = 2048
DIM_BLOCK = 16
#: Pairs are followed one by one once fewer than this share of a block is left.
SPARSE = 0.02
LOWEST, HIGHEST = -(1 << 62), 1 << 62
#: Thresholds of the positives, as shares of the anchor's own score; then none.
POSITIVE_STEPS = (0.3, 0.15)
#: Thresholds of a window, as shares of the way from its lower to its upper end.
WINDOW_STEPS = (0.66, 0.0)


def _rest(x: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Norm of the dimensions from each cut on (rows x cuts; the last is 0)."""
    mass = np.cumsum((x.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1]
    mass = np.concatenate([mass, np.zeros((len(x), 1))], axis=1)
    return np.sqrt(mass[:, cuts])


def threshold_pairs(q: np.ndarray, c: np.ndarray, t: np.ndarray,
                    dim_block: int = DIM_BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor row, candidate row, score) of all pairs with score at least ``t[anchor]``.

    ``q`` and ``c`` are rows x dimensions in the index's order of dimensions, of a kind
    that holds every partial score exactly.
    """
    dim = q.shape[1]
    cuts = [*range(0, dim, dim_block), dim]
    rq, rc = _rest(q, cuts), _rest(c, cuts)
    t = t.astype(np.float64)
    slack = 1.0 + 1e-9 * float(rq[:, 0].max() * rc[:, 0].max())   # rounding of the norms
    # lists that a candidate enters: up to the first cut behind which it cannot reach any t
    with np.errstate(divide="ignore", invalid="ignore"):
        reach = np.where(rq > 0, (t[:, None] - slack) / rq, np.where(t[:, None] > slack, np.inf, -np.inf)).min(axis=0)
    omitted = rc < reach[None, :]
    omitted[:, -1] = True
    lists = omitted.argmax(axis=1)
    order = np.argsort(-lists, kind="stable")
    c, rc, lists = c[order], rc[order], lists[order]
    part = np.zeros((len(q), len(c)), dtype=q.dtype)
    alive = np.arange(len(c))
    left: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []   # pairs and their next list

    def leave(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, at: int) -> None:
        if len(rows):
            left.append((rows, cols, scores, at))

    for at in range(len(cuts) - 1):
        n = int((lists[alive] > at).sum())          # alive candidates keep their order: a prefix
        if n < len(alive):                          # the rest is not indexed from here on
            gone = alive[n:]
            if at:   # without any list the bound alone has dropped the candidate
                i, j = np.nonzero(part[:, n:] + rq[:, at, None] * rc[None, gone, at] >= t[:, None] - slack)
                leave(i, gone[j], part[:, n:][i, j], at)
            alive, part = alive[:n], part[:, :n]
        if not len(alive):
            break
        lo, hi = cuts[at], cuts[at + 1]
        part = part + q[:, lo:hi] @ c[alive, lo:hi].T
        open_ = part + rq[:, at + 1, None] * rc[None, alive, at + 1] >= t[:, None] - slack
        if open_.mean() <= SPARSE or at == len(cuts) - 2:
            i, j = np.nonzero(open_)
            leave(i, alive[j], part[i, j], at + 1)
            break
        some = open_.any(axis=0)
        if not some.all():
            alive, part = alive[some], np.ascontiguousarray(part[:, some])
    rows, cols, scores = [], [], []
    for i, j, s, at in left:
        for k in range(at, len(cuts) - 1):
            lo, hi = cuts[k], cuts[k + 1]
            s = s + np.einsum("ij,ij->i", q[i, lo:hi], c[j, lo:hi])
            keep = s + rq[i, k + 1] * rc[j, k + 1] >= t[i] - slack
            i, j, s = i[keep], j[keep], s[keep]
        keep = s >= t[i]
        rows.append(i[keep])
        cols.append(order[j[keep]])
        scores.append(s[keep])
    if not rows:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(scores).astype(np.int64)


class _Anchors:
    """A block of anchors with its windows and the best rows found for each."""

    def __init__(self, a, ids, labels, x, win, order, k: int, same: bool):
        self.a, self.ids, self.labels, self.k, self.same = a, ids, labels, k, same
        self.x, self.order = x[:, order], order
        self.most = int(np.abs(x).max(initial=0))
        self.float = self.x.astype(np.float64)
        width = max(map(len, win))
        self.w = np.zeros((len(a), width), np.int64)
        self.t = np.full((len(a), width), HIGHEST, np.int64)
        self.hi = np.full((len(a), width), LOWEST, np.int64)
        for i, ws in enumerate(win):
            for j, one in enumerate(ws):
                self.w[i, j], self.hi[i, j], self.t[i, j] = one["w"], one["hi"], one["t"]
        self.found = (np.empty(0, np.int64),) * 3     # window number, id, score
        self.all_labels = set(labels.tolist())

    def meet(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, most: int) -> None:
        if self.same and not self.all_labels.intersection(np.unique(labels).tolist()):
            return
        size = x.shape[1] * self.most * most
        if size >= HIGHEST:
            raise ValueError("scores of these vectors could leave 62 bits")
        exact = size < 1 << 53
        x = x[:, self.order]
        i, j, s = threshold_pairs(self.float if exact else self.x, x.astype(np.float64) if exact else x,
                                  self.t.min(axis=1))
        alike = self.labels[i] == labels[j]
        keep = alike & (self.ids[i] != ids[j]) if self.same else ~alike
        i, j, s = i[keep], ids[j[keep]], s[keep]
        got = [self.found]
        width = self.t.shape[1]
        for w in range(width):
            inside = (s >= self.t[i, w]) & (s <= self.hi[i, w])
            got.append((i[inside] * width + w, j[inside], s[inside]))
        key, one, score = (np.concatenate(z) for z in zip(*got))
        if len(key) == len(self.found[0]):
            return
        by = np.lexsort((one, -score, key))
        key, one, score = key[by], one[by], score[by]
        first = np.searchsorted(key, np.arange(len(self.a) * width))
        keep = np.arange(len(key)) - first[key] < self.k
        self.found = key, one, score = key[keep], one[keep], score[keep]
        n = np.bincount(key, minlength=len(self.a) * width)
        full = np.flatnonzero(n == self.k)
        last = score[np.cumsum(n)[full] - 1]          # equal scores may still win by their id
        self.t.reshape(-1)[full] = np.maximum(self.t.reshape(-1)[full], last)

    def rows(self) -> pa.RecordBatch:
        key, one, score = self.found
        width = self.t.shape[1]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.a[key // width]), pa.array(self.w.reshape(-1)[key]), pa.array(one), pa.array(score)],
            names=["a", "w", "id", "score"])


def _matrix(x: pa.ListArray, dim: int) -> tuple[np.ndarray, int]:
    m = np.asarray(x.flatten()).reshape(-1, dim)
    return m, int(np.abs(m).max(initial=0))


def _search(rows: DataFrame, goals: DataFrame, k: int, same: bool) -> DataFrame:
    """``a, w, rank, id, score``: the ``k`` best rows of each window of ``goals`` (``a, id,
    label, x, win``) with a score from its threshold ``t`` to ``hi``."""
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups = max(1, -(-goals.count() // GROUP))
    shares = max(1, parts // groups)
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    win = goals.schema["win"].dataType
    held = goals.select(F.pmod(F.xxhash64("a"), F.lit(groups)).cast("int").alias("r"), copies(shares).alias("part"),
                        F.size("x").alias("dim"), F.lit(0).alias("kind"), "a", "id", "label", "x", "win")
    sent = rows.select(copies(groups).alias("r"), F.pmod("spread", F.lit(shares)).cast("int").alias("part"),
                       F.size("x").alias("dim"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("a"),
                       "id", "label", "x", F.lit(None).cast(win).alias("win"))
    cells = held.unionByName(sent).repartition(groups * shares, "r", "part", "dim") \
        .sortWithinPartitions("r", "part", "dim", "kind", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, blocks = None, [], []

        def opened():
            """Anchor blocks from what has been read of a cell's anchors."""
            if not waiting:
                return []
            a, ids, labels = (np.concatenate([w[i] for w in waiting]) for i in range(3))
            x = np.concatenate([w[3] for w in waiting])
            win = [ws for w in waiting for ws in w[4]]
            order = np.argsort(-(x.astype(np.float64) ** 2).sum(axis=0), kind="stable")
            waiting.clear()
            return [_Anchors(a[s:s + ANCHOR_BLOCK], ids[s:s + ANCHOR_BLOCK], labels[s:s + ANCHOR_BLOCK],
                             x[s:s + ANCHOR_BLOCK], win[s:s + ANCHOR_BLOCK], order, k, same)
                    for s in range(0, len(a), ANCHOR_BLOCK)]

        for batch in batches:
            where = np.stack([np.asarray(batch.column(n)) for n in ("r", "part", "dim", "kind")], axis=1)
            cuts = np.flatnonzero((np.diff(where, axis=0) != 0).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(where)]):
                if hi == lo:
                    continue
                cell, kind, part = tuple(where[lo, :3]), where[lo, 3], batch.slice(lo, hi - lo)
                if cell != at:
                    yield from (b.rows() for b in blocks)
                    at, blocks = cell, []
                    waiting.clear()
                dim = int(cell[2])
                ids, labels = np.asarray(part.column("id")), np.asarray(part.column("label"))
                x, most = _matrix(part.column("x"), dim)
                if kind == 0:
                    waiting.append((np.asarray(part.column("a")), ids, labels, x, part.column("win").to_pylist()))
                    continue
                blocks = blocks or opened()
                for s in range(0, len(ids) if blocks else 0, CANDIDATE_BLOCK):
                    e = s + CANDIDATE_BLOCK
                    for b in blocks:
                        b.meet(ids[s:e], labels[s:e], x[s:e], most)
        yield from (b.rows() for b in blocks)

    best = Window.partitionBy("a", "w").orderBy(F.desc("score"), "id")
    return cells.mapInArrow(run, "a long, w long, id long, score long") \
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _filled(rows: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, same: bool,
            steps: list[Callable[[], Column]]) -> DataFrame:
    """The ``k`` best rows of every window (``a, w, lo, hi``): thresholds are lowered until
    each window is full or its own lower end was searched."""
    open_, parts = windows, []
    for i, step in enumerate(steps):
        now = open_.withColumn("t", F.greatest("lo", step()))
        goals = staged(anchors.join(now.groupBy("a").agg(F.collect_list(F.struct("w", "hi", "t")).alias("win")), "a"),
                       "negatives-goals")             # at most k_pos windows an anchor
        found = staged(_search(rows, goals, k, same), "negatives-found")
        if i == len(steps) - 1:
            parts.append(found)
            break
        n = found.groupBy("a", "w").agg(F.count(F.lit(1)).alias("n"))
        state = now.join(n, ["a", "w"], "left")
        full = (F.coalesce("n", F.lit(0)) >= k) | (F.col("t") <= F.col("lo"))
        parts.append(found.join(state.where(full).select("a", "w"), ["a", "w"]))
        open_ = staged(state.where(~full).select(*windows.columns), "negatives-open")
        if open_.isEmpty():
            break
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def hard_negatives(vectors: DataFrame, every: int = 50, k_pos: int = 5, k_neg: int = 3, lo_pct: int = 50,
                   hi_pct: int = 95, key: str = "vec_id", label: str = "label",
                   vec: str = "embedding") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    spark = vectors.sparkSession
    importable(spark)
    v = F.col(vec)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0)
                           & ~F.coalesce(bad, F.lit(False)))
    # `spread` deals rows to tasks; written once, so a task that runs again deals alike
    rows = staged(usable.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                                F.transform(v, lambda x: F.floor(x.cast("double") * 256)).alias("x"),
                                F.monotonically_increasing_id().alias("spread")), "negatives-rows")
    anchors = staged(rows.where(F.col("id") % every == 0).dropDuplicates(["id", "label", "x"])
                     .select(F.xxhash64("id", "label", "x").alias("a"), "id", "label", "x"), "negatives-anchors")
    one = anchors.select("a", F.lit(0).cast("long").alias("w"), F.lit(LOWEST).alias("lo"), F.lit(HIGHEST).alias("hi"),
                         F.aggregate("x", F.lit(0.0), lambda s, z: s + z.cast("double") * z).alias("own"))
    steps = [lambda f=f: F.least(F.col("own") * f, F.lit(2.0 ** 61)).cast("long") for f in POSITIVE_STEPS] + [lambda: F.lit(LOWEST)]
    positives = staged(_filled(rows, anchors, one, k_pos, True, steps)
                       .select("a", F.col("rank").cast("long").alias("w"), F.col("id").alias("positive_id"),
                               F.col("score").alias("positive_score")), "negatives-positives")
    p = F.col("positive_score")
    down = lambda z, n: F.expr(f"({z} - pmod({z}, {n})) div {n}")  # noqa: E731  floor division
    windows = positives.select("a", "w", (-down(f"({-lo_pct} * positive_score)", 100)).alias("lo"),
                               down(f"({hi_pct} * positive_score)", 100).alias("hi")).where("lo <= hi")
    steps = [lambda f=f: F.col("lo") + ((F.col("hi") - F.col("lo")) * f).cast("long") for f in WINDOW_STEPS]
    found = _filled(rows, anchors, windows, k_neg, False, steps)
    return found.join(positives, ["a", "w"]).join(anchors.select("a", F.col("id").alias("anchor_id")), "a").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        p.cast("long").alias("positive_score"), F.col("score").cast("long").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label))


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT a, b, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id,
  row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b)::INT AS rank,
  n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM pos p JOIN s n ON n.a = p.a AND NOT n.alike
  AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
