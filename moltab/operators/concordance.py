"""Kendall's tau-b by a bounded count matrix.

Work is on distinct cells ``(x, y) -> count``.  The distinct values of x and of y are cut
into strips of about ``strip`` cells each, in order; a value with more cells than that is a
strip of its own.  The pairs of cells fall into three kinds:

* different x strips and different y strips: their signs follow from the strips, so the
  counts per (x strip, y strip) suffice.  There are at most ``MOST_STRIPS`` strips of
  either kind, which bounds the matrix whatever the data;
* the same x strip: compared exactly inside the strip;
* the same y strip and different x strips: inside the y strip, x known by its strip.

Every part is the signed pair count of a bounded set of weighted points, found by a
vectorised inversion count.  No pair of rows is made, and no task gets all values of x.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltab.operators.ordered import running_sum
from moltab.session import importable, stored

STRIP = 1 << 18
MOST_STRIPS = 2048


def _inversions(rank: np.ndarray, weight: np.ndarray) -> float:
    """Weighted count of pairs i < j with ``rank[i] > rank[j]``, one bit of the rank at a
    time: within equal higher bits a set bit stands before a clear one."""
    total = 0.0
    order = np.arange(len(rank))
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        r, w = rank[order], weight[order]
        ones = np.where((r >> bit) & 1, w, 0.0)
        before = np.cumsum(ones) - ones
        head = r >> (bit + 1)
        start = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
        base = np.repeat(before[start], np.diff(np.append(start, len(r))))
        total += float(((before - base) * np.where((r >> bit) & 1, 0.0, w)).sum())
        order = order[np.argsort(r >> bit, kind="stable")]
    return total


def signed_pairs(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Sum over pairs of ``w w' sign(x - x') sign(y - y')``."""
    if len(x) < 2:
        return 0.0
    by = np.lexsort((y, x))
    x, y, w = x[by], y[by], weight[by].astype(np.float64)
    rank = np.unique(y, return_inverse=True)[1]
    pairs = lambda t: float((t * t).sum()) / 2.0
    per_x = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    per_xy = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])]))
    apart_in_y = float(w.sum()) ** 2 / 2.0 - pairs(np.bincount(rank, w))
    # pairs of equal x were sorted by y and look concordant
    tied_in_x = pairs(np.add.reduceat(w, per_x)) - pairs(np.add.reduceat(w, per_xy))
    return apart_in_y - 2.0 * _inversions(rank, w) - tied_in_x


def _strips(cells: DataFrame, by: list[str], value: str, out: str, strip: int) -> DataFrame:
    """``by, value, out, alone``: the strip of every distinct value; strips grow with it."""
    sizes = cells.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_k"))
    at = running_sum(sizes, value, ["_k"], by=by, prefix="_upto")
    window = F.floor((F.col("_upto_k") - F.col("_k")) / F.lit(strip)).cast("long")
    alone = F.col("_k") >= strip
    # a large value ends its window: what follows it begins behind it
    return at.select(*by, value, (2 * window + alone.cast("long")).alias(out), alone.alias(f"{out}_alone"))


def _sum_of_pairs(points: DataFrame, keys: list[str], by: list[str], x: str, y: str) -> DataFrame:
    """``by, _s``: signed pairs within each group of ``keys``."""
    kinds = {f.name: f.dataType for f in points.schema.fields}

    def run(t):
        s = signed_pairs(*(t.column(c).to_numpy() for c in (x, y, "_c")))
        return pa.table({**{b: t.column(b).slice(0, 1) for b in by}, "_s": pa.array([s])})

    schema = ", ".join([*(f"`{b}` {kinds[b].simpleString()}" for b in by), "_s double"])
    return points.groupBy(*keys).applyInArrow(run, schema)


def kendall_tau(df: DataFrame, x: str, y: str, by: Sequence[str] = (), strip: int = STRIP) -> DataFrame:
    """Tie-corrected Kendall tau-b per group over rows with both values: ``(by…, n, tau)``.

    Exact for any data; null if either column is constant.  A group that ends up in one
    strip is counted in one task, larger ones by strips and the strip matrix.
    """
    by = list(by)
    importable(df.sparkSession)
    cells = stored(df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
                   .groupBy(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
                   .agg(F.count(F.lit(1)).alias("_c")), "kendall-cells")
    per_group = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("m")) if by else cells.agg(F.count(F.lit(1)).alias("m"))
    largest = per_group.agg(F.max("m").alias("m")).first()["m"] or 0
    strip = max(int(strip), -(-largest // MOST_STRIPS))
    if largest <= strip:
        inside = cells.withColumn("_only", F.lit(0))
        parts = _sum_of_pairs(inside, [*by, "_only"], by, "_x", "_y")
    else:
        sx = _strips(cells, by, "_x", "_bx", strip)
        sy = _strips(cells, by, "_y", "_by", strip)
        placed = stored(cells.join(sx, [*by, "_x"]).join(sy, [*by, "_y"]), "kendall-strips")
        # a strip of one value has no pair that counts
        in_x = _sum_of_pairs(placed.where("not _bx_alone").select(*by, "_bx", "_x", "_y", "_c"),
                             [*by, "_bx"], by, "_x", "_y")
        coarse = placed.where("not _by_alone").groupBy(*by, "_by", "_bx", "_y").agg(F.sum("_c").alias("_c"))
        in_y = _sum_of_pairs(coarse, [*by, "_by"], by, "_bx", "_y")
        matrix = placed.groupBy(*by, "_bx", "_by").agg(F.sum("_c").alias("_c")).withColumn("_only", F.lit(0))
        across = _sum_of_pairs(matrix, [*by, "_only"], by, "_bx", "_by")
        parts = in_x.unionByName(in_y).unionByName(across)
    signed = parts.groupBy(*by).agg(F.sum("_s").alias("_S"))
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    size = F.col("_t").cast("double")

    def ties(value: str, out: str) -> DataFrame:
        return cells.groupBy(*by, value).agg(F.sum("_c").alias("_t")).groupBy(*by).agg(pairs(size).alias(out))

    n = cells.groupBy(*by).agg(F.sum("_c").alias("_n"))
    tied = [ties("_x", "_n1"), ties("_y", "_n2"), signed]
    for t in tied:
        n = n.join(t, by) if by else n.crossJoin(t)      # one row each without groups
    all_pairs = F.col("_n") * (F.col("_n") - 1) / 2.0
    den = F.sqrt((all_pairs - F.col("_n1")) * (all_pairs - F.col("_n2")))
    return n.select(*by, F.col("_n").cast("long").alias("n"),
                    F.try_divide(F.col("_S"), F.when(den > 0, den)).alias("tau"))
