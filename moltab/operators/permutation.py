"""Permutation tests without permuted tables.

A permutation of n positions is a keyed bijection: six Feistel rounds on the smallest power
of two that holds n, repeated until the value is a position (cycle walking).  Where a row
goes under permutation b is arithmetic on (position, key of b), so nothing is sorted or
shuffled per permutation, and DuckDB computes the same numbers (:func:`sql_permuted`).

For correlations the permuted statistic needs only ``sum x_i y_p(i)`` (and the sums of y over
the rows that have x).  The targets lie in blocks of consecutive positions; a cell is one
block and one share of the rows.  A task holds the block, streams its rows and forms the
sums of all permutations at once as matrix products; it returns one row of ``n_perm`` sums
per feature.  What is shuffled is the rows once (per target block) and those sums.

Difference of means: x and y of a feature form one pool that is dealt anew; the same sums
with x = 1 for the first places.  Kendall's tau needs all rows of a permutation together:
a task gets all rows and a share of the permutations, for at most ``MOST_KENDALL`` rows.
Where the values are few, a permutation is one pass that counts pairs of values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltab.functions.rng import hash32
from moltab.operators.concordance import kendall_tau, signed_pairs
from moltab.operators.ordered import average_rank, row_number
from moltab.session import importable, stored

CORRELATIONS = ("pearson", "spearman", "kendall")
METHODS = (*CORRELATIONS, "mean_difference")
ALTERNATIVES = ("two-sided", "greater", "less")
ROUNDS = 6
#: The bijection works on at least so many bits; on fewer, few permutations can occur.
LEAST_BITS = 10
#: Positions of a target block; rows and permutations handled at a time.
BLOCK = 1 << 22
ROWS, PERMS = 2048, 256
MOST_KENDALL = 1 << 22
#: Places whose permuted ones are worked out at a time for Kendall.
WALKED = 1 << 15
#: Mixing constants of a round (31-bit arithmetic, so products fit 64 bits).
_MOD, _MULT = (1 << 31) - 1, 73244475
#: Scores within this of the observed one count as equal.
TOLERANCE = 1e-12


def round_keys(seed: int, n_perm: int) -> np.ndarray:
    """Key of every (permutation, round): the first 32 bits of an md5, 31 of them used."""
    return np.array([[int(hashlib.md5(f"{seed}|{b}|{r}".encode()).hexdigest()[:8], 16) & _MOD
                      for r in range(ROUNDS)] for b in range(1, n_perm + 1)], dtype=np.int64).reshape(n_perm, ROUNDS)


def _widths(n: int) -> tuple[int, int]:
    bits = max(LEAST_BITS, (n - 1).bit_length())
    return bits // 2, bits - bits // 2


def _scramble(v: np.ndarray, key: np.ndarray) -> np.ndarray:
    """31 bits of unsigned products: 32-bit numbers that wrap around give the same."""
    v = v + key
    v &= v.dtype.type(_MOD)
    v *= v.dtype.type(_MULT)
    v &= v.dtype.type(_MOD)
    v ^= v >> v.dtype.type(15)
    v *= v.dtype.type(_MULT)
    v &= v.dtype.type(_MOD)
    v ^= v >> v.dtype.type(13)
    return v


def permuted(pos: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """Where the positions ``pos`` go under every permutation (rows: positions, columns:
    the permutations of ``keys``)."""
    low, high = _widths(n)
    kind = np.uint32 if low + high <= 32 else np.uint64
    by_round = np.ascontiguousarray(keys.T).astype(kind)

    def once(v: np.ndarray, key) -> np.ndarray:
        a, b = high, low                       # widths of the left and the right part
        left, right = v >> kind(b), v & kind((1 << b) - 1)
        for r in range(ROUNDS):
            mixed = _scramble(right, key(r))
            mixed &= kind((1 << a) - 1)
            mixed ^= left
            left, right = right, mixed
            a, b = b, a
        return (left << kind(b)) | right

    out = once(np.broadcast_to(pos.astype(kind)[:, None], (len(pos), len(keys))), lambda r: by_round[r])
    flat = out.reshape(-1)
    at = np.flatnonzero(flat >= n)
    while len(at):
        j = at % len(keys)
        v = once(flat[at], lambda r: by_round[r][j])
        flat[at] = v
        at = at[v >= n]
    return flat.reshape(len(pos), len(keys)).astype(np.int64)


def sql_permuted(positions: str, seed: int, n_perm: int) -> str:
    """DuckDB twin: a query ``(b, i, p)`` over ``positions`` (columns ``i, n``, ``n`` the
    number of positions): the place p of position i under permutation b."""
    key = lambda r: f"(('0x' || substr(md5('{seed}|' || b || '|{r}'), 1, 8))::BIGINT & {_MOD}) AS k{r}"
    keys = ", ".join(f"k{r}" for r in range(ROUNDS))
    a, b = "hi", "lo"
    step = f"SELECT b, i, n, lo, hi, {keys}, v >> lo AS l, v & ((1 << lo) - 1) AS r FROM walk WHERE fresh OR v >= n"
    for r in range(ROUNDS):
        step = f"SELECT *, (((r + k{r}) & {_MOD}) * {_MULT}) & {_MOD} AS m FROM ({step})"
        step = f"SELECT * EXCLUDE (m), (xor(m, m >> 15) * {_MULT}) & {_MOD} AS m FROM ({step})"
        step = f"SELECT * EXCLUDE (m, l, r), r AS l, xor(l, xor(m, m >> 13) & ((1 << {a}) - 1)) AS r FROM ({step})"
        a, b = b, a
    return f"""WITH RECURSIVE start AS (
  SELECT b, i, n, bits // 2 AS lo, bits - bits // 2 AS hi, {keys}, i AS v
  FROM (SELECT i::BIGINT AS i, n::BIGINT AS n,
          greatest({LEAST_BITS}, CASE WHEN n > 1 THEN floor(log2(n - 1))::BIGINT + 1 ELSE 0 END) AS bits FROM ({positions})) p,
    (SELECT b, {", ".join(map(key, range(ROUNDS)))} FROM (SELECT unnest(range(1, {n_perm} + 1)) AS b)) q),
walk AS (
  SELECT b, i, n, lo, hi, {keys}, v, true AS fresh FROM start
  UNION ALL
  SELECT b, i, n, lo, hi, {keys}, (l << {b}) | r AS v, false AS fresh FROM ({step}))
SELECT b, i, v AS p FROM walk WHERE NOT fresh AND v < n"""


def _sums(rows: DataFrame, sizes: dict[int, int], width: int, seed: int, n_perm: int) -> DataFrame:
    """``g, f, n, sx, sxx, sxy, sy, syy`` per cell: for each group ``g`` and feature number
    ``f`` the sums over the rows that have the feature, the last three per permutation.

    ``rows``: ``g, pos, v, xs`` with the target ``v`` and the features ``xs`` (null: the row
    has none of them, it only offers its target).
    """
    spark = rows.sparkSession
    shares = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    most = max(sizes.values(), default=0)
    n_blocks = max(1, -(-most // BLOCK))
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def block(key, t):
        pos, v = t.column("pos").to_numpy(), t.column("v").to_numpy()
        return pa.table({"g": [key[0].as_py()], "block": [key[1].as_py()], "vs": [v[np.argsort(pos)].tobytes()]},
                        schema=pa.schema([("g", pa.int32()), ("block", pa.int32()), ("vs", pa.binary())]))

    blocks = rows.select("g", F.floor(F.col("pos") / BLOCK).cast("int").alias("block"), "pos", "v") \
        .groupBy("g", "block").applyInArrow(block, "g int, block int, vs binary")
    held = blocks.select("g", "block", copies(shares).alias("part"), F.lit(0).alias("kind"), "vs",
                         F.lit(0).cast("long").alias("pos"), F.lit(None).cast("array<double>").alias("xs"))
    sent = rows.where("xs is not null").select(
        "g", copies(n_blocks).alias("block"), F.pmod(F.col("pos"), F.lit(shares)).cast("int").alias("part"),
        F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("vs"), "pos", "xs")
    cells = held.unionByName(sent).repartition(shares * n_blocks, "g", "block", "part") \
        .sortWithinPartitions("g", "block", "part", "kind")
    fields = ["n", "sx", "sxx", "sxy", "sy", "syy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = round_keys(seed, n_perm)
        at, v, base, g = None, None, 0, 0
        sums: dict[str, np.ndarray] = {}

        def close():
            if at is None or not sums["n"].any():
                return
            yield pa.RecordBatch.from_arrays(
                [pa.array([g] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([base == 0] * width),
                 *[pa.array(sums[c]) for c in fields[:3]], *[pa.array([r.tobytes() for r in sums[c]]) for c in fields[3:]]],
                names=["g", "f", "first", *fields])

        def add(pos: np.ndarray, x: np.ndarray) -> None:
            has = ~np.isnan(x)
            x = np.where(has, x, 0.0)
            mask = has.astype(np.float64)
            sums["n"] += mask.sum(axis=0)
            sums["sx"] += x.sum(axis=0)
            sums["sxx"] += (x * x).sum(axis=0)
            for lo in range(0, n_perm, PERMS):
                to = permuted(pos, keys[lo:lo + PERMS], sizes[g]) - base
                inside = (to >= 0) & (to < len(v))
                y = np.where(inside, v[np.where(inside, to, 0)], 0.0)
                sums["sxy"][:, lo:lo + PERMS] += x.T @ y
                sums["sy"][:, lo:lo + PERMS] += mask.T @ y
                sums["syy"][:, lo:lo + PERMS] += mask.T @ (y * y)

        for b in batches:
            where = np.stack([np.asarray(b.column(c)) for c in ("g", "block", "part", "kind")], axis=1)
            cuts = np.flatnonzero((np.diff(where, axis=0) != 0).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(where)]):
                if lo == hi:
                    continue
                if tuple(where[lo, :3]) != at:
                    yield from close()
                    at, g, base = tuple(where[lo, :3]), int(where[lo, 0]), int(where[lo, 1]) * BLOCK
                    v = np.empty(0)
                    sums = {c: np.zeros(width) for c in fields[:3]} | {c: np.zeros((width, n_perm)) for c in fields[3:]}
                if where[lo, 3] == 0:
                    v = np.frombuffer(b.column("vs")[lo].as_py(), dtype=np.float64)
                    continue
                for s in range(lo, hi, ROWS):
                    part = b.slice(s, min(ROWS, hi - s))
                    x = np.asarray(part.column("xs").flatten()).astype(np.float64).reshape(-1, width)
                    add(np.asarray(part.column("pos")), x)
        yield from close()

    return cells.select("g", "block", "part", "kind", "vs", "pos", "xs").mapInArrow(
        run, "g int, f int, first boolean, n double, sx double, sxx double, sxy binary, sy binary, syy binary")


def _hits(rb: np.ndarray, r: float, alternative: str) -> int:
    if alternative == "two-sided":
        return int((np.abs(rb) >= abs(r) - TOLERANCE).sum())
    sign = 1.0 if alternative == "greater" else -1.0
    return int((sign * rb >= sign * r - TOLERANCE).sum())


def _p_values(sums: DataFrame, observed: DataFrame, statistic, n_perm: int, alternative: str) -> DataFrame:
    """``g, f, hits``: the permuted statistics against the observed ones (``g, f, r``)."""

    def run(key, t):
        r = t.column("r")[0].as_py()
        first = t.column("first").to_numpy(zero_copy_only=False)     # the other blocks saw the same rows
        add = lambda c: t.column(c).to_numpy()[first].sum()
        fold = lambda c: sum(np.frombuffer(x, dtype=np.float64) for x in t.column(c).to_pylist())
        with np.errstate(divide="ignore", invalid="ignore"):
            rb = statistic(add("n"), add("sx"), add("sxx"), fold("sxy"), fold("sy"), fold("syy"), t.column("total")[0].as_py())
        hits = None if r is None else _hits(rb[~np.isnan(rb)], r, alternative)
        return pa.table({"g": [key[0].as_py()], "f": [key[1].as_py()], "hits": [hits]},
                        schema=pa.schema([("g", pa.int32()), ("f", pa.int32()), ("hits", pa.int64())]))

    return sums.join(observed.select("g", "f", "r", "total"), ["g", "f"]).groupBy("g", "f") \
        .applyInArrow(run, "g int, f int, hits long")


def _correlation(n, sx, sxx, sxy, sy, syy, total):
    cov = sxy / n - (sx / n) * (sy / n)
    spread = (sxx / n - (sx / n) ** 2) * (syy / n - (sy / n) ** 2)
    return np.where(spread > 1e-300, cov / np.sqrt(np.where(spread > 1e-300, spread, 1.0)), np.nan)


def _signed_counts(table: np.ndarray) -> float:
    """Signed pairs of points given as a table of counts (values of x by values of y)."""
    above = np.cumsum(table, axis=0) - table                   # of smaller x
    upto = np.cumsum(above, axis=1)
    return float((table * ((upto - above) - (upto[:, -1:] - upto))).sum())


def _permuted_tau(has: np.ndarray, x: np.ndarray, v: np.ndarray, keys: np.ndarray) -> Iterator[float]:
    """tau-b of ``x`` (values at the places ``has``) with the permuted targets ``v``, for every
    permutation whose two sides vary.  Values that make few different pairs are counted in a
    table instead of sorted."""
    m = len(has)
    all_pairs = m * (m - 1) / 2.0
    untied = lambda k: all_pairs - float(k @ (k - 1)) / 2.0
    x_of, cx = np.unique(x, return_inverse=True)
    y_of, cy = np.unique(v, return_inverse=True)
    wide, high = len(x_of), len(y_of)
    tx = untied(np.bincount(cx).astype(np.float64))
    tabled = wide * high <= max(m, 1 << 16)
    cells = cx * high
    for b in range(len(keys)):
        if tabled:
            t = np.zeros(wide * high, dtype=np.int64)
            for lo in range(0, m, WALKED):
                to = permuted(has[lo:lo + WALKED], keys[b:b + 1], len(v))[:, 0]
                t += np.bincount(cells[lo:lo + WALKED] + cy[to], minlength=wide * high)
            t = t.reshape(wide, high).astype(np.float64)
            den = np.sqrt(tx * untied(t.sum(axis=0)))
            if den > 0:
                yield _signed_counts(t) / den
            continue
        y = np.empty(m, dtype=np.int64)
        for lo in range(0, m, WALKED):
            y[lo:lo + WALKED] = cy[permuted(has[lo:lo + WALKED], keys[b:b + 1], len(v))[:, 0]]
        den = np.sqrt(tx * untied(np.bincount(y, minlength=high).astype(np.float64)))
        if den > 0:
            yield signed_pairs(cx, y, np.ones(m)) / den


def _kendall_hits(rows: DataFrame, observed: DataFrame, n: int, n_perm: int, seed: int, alternative: str,
                  width: int) -> DataFrame:
    """``g, f, hits`` for Kendall: every task has all rows, in packets, and a share of the
    permutations."""
    if n > MOST_KENDALL:
        raise ValueError(f"a permutation test of Kendall's tau takes at most {MOST_KENDALL} rows with a target, not {n}")
    spark = rows.sparkSession
    shares = max(1, min(n_perm, 4 * spark.sparkContext.defaultParallelism))
    seen = {r["f"]: r["r"] for r in observed.select("f", "r").collect() if r["r"] is not None}   # a row per feature
    packets = max(1, n * width >> 17)

    def pack(t):
        xs = t.column("xs").combine_chunks()
        return pa.table({"ps": [t.column("pos").to_numpy().tobytes()], "vs": [t.column("v").to_numpy().tobytes()],
                         "xs": [np.asarray(xs.flatten()).tobytes()]},
                        schema=pa.schema([("ps", pa.binary()), ("vs", pa.binary()), ("xs", pa.binary())]))

    packed = rows.select(F.pmod("pos", F.lit(packets)).alias("packet"), "pos", "v", "xs") \
        .groupBy("packet").applyInArrow(lambda key, t: pack(t), "ps binary, vs binary, xs binary")
    lanes = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    sent = stored(packed, "permutation-packets").select(lanes.alias("lane"), "ps", "vs", "xs")
    schema = pa.schema([("g", pa.int32()), ("f", pa.int32()), ("hits", pa.int64())])

    def run(key, t):
        whole = lambda c, kind: np.concatenate([np.frombuffer(b.as_py(), dtype=kind) for b in t.column(c)])
        order = np.argsort(whole("ps", np.int64))
        v, x = whole("vs", np.float64)[order], whole("xs", np.float64).reshape(-1, width)[order]
        keys = round_keys(seed, n_perm)[key[0].as_py()::shares]
        out = []
        for f, r in seen.items():
            has = np.flatnonzero(~np.isnan(x[:, f]))
            taus = np.fromiter(_permuted_tau(has, x[has, f], v, keys), dtype=np.float64)
            out.append((0, f, _hits(taus, r, alternative)))
        return pa.table({n_: [o[i] for o in out] for i, n_ in enumerate(schema.names)}, schema=schema)

    return sent.repartition(shares, "lane").groupBy("lane").applyInArrow(run, "g int, f int, hits long") \
        .groupBy("g", "f").agg(F.sum("hits").alias("hits"))


def permutation_test(df: DataFrame, key: str, cols: Sequence[str], target: str, method: str = "pearson",
                     n_perm: int = 10_000, seed: int = 2024, alternative: str = "two-sided") -> DataFrame:
    """Permutation p-values of every feature against ``target``: ``(feature, n, r, p_value)``.

    p = (1 + #{T_b >= T_obs}) / (B + 1) (Phipson & Smyth 2010), T = |r| two-sided, r for
    ``greater``, -r for ``less``; r is the correlation, or mean(feature) - mean(target) for
    ``mean_difference`` (over each column's own non-null values).  Permutation b sends the row
    at place i of the keys' hash order to the target at place p_b(i); rows without a target take
    no part.  Spearman ranks a feature over its rows and the target over all rows with one.
    A permutation that leaves either side constant counts as not extreme; a feature without
    a statistic has a null p-value.
    """
    if method not in METHODS:
        raise ValueError(f"unknown statistic {method!r}; use one of {METHODS}")
    if alternative not in ALTERNATIVES:
        raise ValueError(f"alternative must be one of {ALTERNATIVES}")
    importable(df.sparkSession)
    cols = list(cols)
    base = df.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)],
                     F.col(target).cast("double").alias("_y"))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "f int, feature string")
    if method == "mean_difference":
        return _mean_test(base, names, cols, n_perm, seed, alternative)
    base = base.where(F.col("_y").isNotNull())
    values = [f"_x{i}" for i in range(len(cols))]
    if method == "spearman":
        for c in [*values, "_y"]:
            base = average_rank(base, c, out="_rank").drop(c).withColumnRenamed("_rank", c)
    placed = row_number(base.withColumn("_hk", hash32(F.col("_key"), "key")), "_hk", tiebreak=["_key"], out="_rn")
    nan = F.lit(float("nan"))
    rows = stored(placed.select(F.lit(0).alias("g"), (F.col("_rn") - 1).alias("pos"), F.col("_y").alias("v"),
                                F.array(*[F.coalesce(c, nan) for c in values]).alias("xs")), "permutation-rows")
    n = rows.count()
    long = rows.select("v", F.posexplode("xs").alias("f", "x")).where(~F.isnan("x"))
    if method == "kendall":
        observed = kendall_tau(long, "x", "v", by=["f"]).select("f", "n", F.col("tau").alias("r"))
    else:
        den = F.sqrt(F.var_pop("x") * F.var_pop("v"))
        observed = long.groupBy("f").agg(F.count(F.lit(1)).alias("n"),
                                         F.try_divide(F.covar_pop("x", "v"), F.when(den > 0, den)).alias("r"))
    observed = stored(observed.select(F.lit(0).alias("g"), "f", "n", "r", F.lit(0.0).alias("total")), "permutation-observed")
    if method == "kendall":
        hits = _kendall_hits(rows, observed, n, n_perm, seed, alternative, len(cols))
    else:
        hits = _p_values(_sums(rows, {0: n}, len(cols), seed, n_perm), observed, _correlation, n_perm, alternative)
    return _told(observed, hits, names, n_perm)


def _told(observed: DataFrame, hits: DataFrame, names: DataFrame, n_perm: int) -> DataFrame:
    return observed.join(hits, ["g", "f"], "left").join(F.broadcast(names), "f").select(
        "feature", F.col("n").cast("long").alias("n"), "r",
        F.when(F.col("r").isNotNull(), (1 + F.col("hits")) / F.lit(float(n_perm + 1))).alias("p_value"))


def _mean_test(base: DataFrame, names: DataFrame, cols: list[str], n_perm: int, seed: int, alternative: str) -> DataFrame:
    """Difference of means of each feature and the target: their values form one pool, the
    feature's in the first places."""
    values = [f"_x{i}" for i in range(len(cols))]
    side = lambda c, f, s: base.where(F.col(c).isNotNull()).select(
        F.lit(f).alias("g"), F.lit(s).alias("side"), F.col("_key").cast("string").alias("_key"), F.col(c).alias("v"))
    pool = None
    for f, c in enumerate(values):
        both = side(c, f, 0).unionByName(side("_y", f, 1))
        pool = both if pool is None else pool.unionByName(both)
    placed = row_number(pool, "side", tiebreak=["_key"], by=["g"], out="_rn")
    rows = stored(placed.select("g", (F.col("_rn") - 1).alias("pos"), "v",
                                F.when(F.col("side") == 0, F.array(F.lit(1.0))).alias("xs"), "side"), "permutation-rows")
    is_x = F.col("side") == 0
    observed = stored(rows.groupBy("g").agg(
        F.count(F.lit(1)).alias("all"), F.count_if(is_x).alias("n"), F.sum("v").alias("total"),
        (F.avg(F.when(is_x, F.col("v"))) - F.avg(F.when(~is_x, F.col("v")))).alias("r")), "permutation-observed")
    sizes = {r["g"]: r["all"] for r in observed.select("g", "all").collect()}     # a row per feature
    told = observed.select("g", F.lit(0).alias("f"), "n", "r", "total", "all")

    def difference(n, sx, sxx, sxy, sy, syy, total):
        return sxy / n - (total[0] - sxy) / (total[1] - n)

    packed = told.withColumn("total", F.array("total", F.col("all").cast("double")))
    hits = _p_values(_sums(rows.drop("side"), sizes, 1, seed, n_perm), packed, difference, n_perm, alternative)
    # here a feature is a group
    return _told(told.drop("f").withColumn("f", F.col("g")), hits.drop("f").withColumn("f", F.col("g")), names, n_perm)
