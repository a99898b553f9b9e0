"""Fingerprint similarity: pair scores, threshold joins, search, summary (§2.3, §2.8).

Pairs are generated by an exact *threshold* join, never a cross join:

* length filter — Tanimoto ≥ t implies t·|A| ≤ |B| ≤ |A|/t;
* prefix filter — with bits ordered by global rarity, two sets reaching t
  must share one of the first ``|A| − ⌈t·|A|⌉ + 1`` bits of each
  (Bayardo et al. 2007), so candidates come from an equi-join on those bits;
* positional filter — at the rarest shared bit (positions i, j) at most
  1 + min(|A| − i, |B| − j) bits can still be shared (Xiao et al. 2008);
* each candidate is emitted once (only at its rarest shared prefix bit) and
  verified with the exact similarity.

Where prefixes select too little (dense sets of few words), blocks of sets with equal
numbers of on-bits are multiplied instead, as 0/1 matrices: bounded tasks, and only pairs
that reach t leave them.  Where most sets occur more than once, pairs of different sets are
found first and then expanded to the rows that have them.

The rarity order is a table of at most ``n_bits`` rows (the fingerprint width,
a schema constant); it is the only thing that reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltab.session import importable, stored

_EPS = 1e-9


def tanimoto_expr(a: str | Column, b: str | Column) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    inter = F.size(F.array_intersect(a, b))
    return F.try_divide(inter.cast("double"), (F.size(a) + F.size(b) - inter).cast("double"))


def dice_expr(a: str | Column, b: str | Column) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    inter = F.size(F.array_intersect(a, b))
    return F.try_divide(2.0 * inter, (F.size(a) + F.size(b)).cast("double"))


def fp_similarity(a, b, dice: bool = False) -> Column:
    return dice_expr(a, b) if dice else tanimoto_expr(a, b)


def count_tanimoto_expr(a: str | Column, b: str | Column) -> Column:
    """Σ min / Σ max over ids of two count maps (``MAP<id, count>``)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    smin = F.aggregate(F.map_entries(a), F.lit(0).cast("double"),
                       lambda acc, e: acc + F.least(e["value"], F.coalesce(b[e["key"]], F.lit(0))))
    sa = F.aggregate(F.map_values(a), F.lit(0).cast("double"), lambda acc, v: acc + v)
    sb = F.aggregate(F.map_values(b), F.lit(0).cast("double"), lambda acc, v: acc + v)
    return F.try_divide(smin, sa + sb - smin)


#: Bits of a mask word (a BIGINT), and the words that a set's mask may take as columns;
#: wider sets are compared as arrays.
WORD, MOST_WORDS = 64, 64
#: Largest bit number for which ranks are looked up by position.
MOST_POSITIONS = 1 << 16


def _ranks(frames: list[DataFrame], bits: str) -> tuple:
    """``(lookup, n)``: the rank of a bit (0 = rarest over all given frames) as a function
    on columns, and the number of distinct bits."""
    ex = None
    for f in frames:
        e = f.select(F.explode(bits).alias("bit"))
        ex = e if ex is None else ex.unionByName(e)
    freq = ex.groupBy("bit").agg(F.count(F.lit(1)).alias("n")).collect()     # at most the fingerprint's width
    order = [int(bit) for _, bit in sorted((r["n"], r["bit"]) for r in freq)]
    if not order:
        return (lambda b: F.lit(None).cast("int")), 0
    if min(order) >= 0 and max(order) < MOST_POSITIONS:
        place = [-1] * (max(order) + 1)
        for rank, bit in enumerate(order):
            place[bit] = rank
        table = F.array(*[F.lit(x) for x in place])
        return (lambda b: F.element_at(table, b.cast("int") + 1)), len(order)
    table = F.create_map(*[F.lit(x) for rank, bit in enumerate(order) for x in (bit, rank)])
    return (lambda b: table[b]), len(order)


def _words(ranks: Column, words: int) -> list[Column]:
    """The ranks as bit masks of ``WORD`` each."""
    one = lambda r: F.call_function("shiftleft", F.lit(1).cast("long"), r % WORD)

    def word(w: int) -> Column:
        # a second argument of a lambda would be taken for the index
        mine = F.filter(ranks, lambda r: (r - r % WORD) == w * WORD)
        return F.aggregate(mine, F.lit(0).cast("long"), lambda acc, r: acc.bitwiseOR(one(r)))

    return [word(w) for w in range(words)]


def _prepare(df: DataFrame, key: str, bits: str, rank, t_jac: float, side: str, words: int) -> DataFrame:
    d = df.select(F.col(key).alias(f"{side}_key"), F.array_sort(F.transform(F.col(bits), rank)).alias(f"{side}_r"),
                  F.size(F.col(bits)).alias(f"{side}_n")).where(F.col(f"{side}_n") > 0)
    n = F.col(f"{side}_n")
    plen = n - F.ceil(n * F.lit(t_jac) - F.lit(_EPS)) + 1
    d = d.withColumn(f"{side}_pre", F.slice(F.col(f"{side}_r"), 1, plen.cast("int")))
    if words <= MOST_WORDS:
        d = d.select(f"{side}_key", f"{side}_n", f"{side}_pre",
                     *[m.alias(f"{side}_m{w}") for w, m in enumerate(_words(F.col(f"{side}_r"), words))],
                     *[m.alias(f"{side}_p{w}") for w, m in enumerate(_words(F.col(f"{side}_pre"), words))])
    d = d.select("*", F.posexplode(f"{side}_pre").alias(f"{side}_i", f"{side}_tok"))
    if words > MOST_WORDS or side != "a":
        return d
    # the prefix's bits that are rarer than the row's: a pair that shares one is met there
    tok = F.col("a_tok")
    at, bit = (tok - tok % WORD) / WORD, tok % WORD
    below = F.when(bit == 0, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), WORD - bit))
    return d.select("a_key", "a_n", "a_i", "a_tok", *[f"a_m{w}" for w in range(words)], *[
        F.when(at > w, F.col(f"a_p{w}")).when(at == w, F.col(f"a_p{w}").bitwiseAND(below))
        .otherwise(F.lit(0).cast("long")).alias(f"a_q{w}") for w in range(words)])


def similarity_pairs(a: DataFrame, key: str, bits: str = "bits", b: DataFrame | None = None,
                     min_sim: float = 0.5, metric: str = "tanimoto") -> DataFrame:
    """Exact pairs with similarity ≥ ``min_sim``: ``(i, j, sim)``; ``i < j`` for a self join.

    ``metric`` is ``tanimoto`` or ``dice`` (Dice t ↔ Tanimoto t/(2−t) for the filters).
    """
    if not 0 < min_sim <= 1:
        raise ValueError("min_sim must be in (0, 1]: a threshold join never enumerates all pairs")
    if metric not in ("tanimoto", "dice"):
        raise ValueError(f"unknown metric {metric!r}")
    importable(a.sparkSession)
    rows, sets, one_each = _classes(a, key, bits)
    if b is None:
        if one_each:
            return _pairs(rows, None, min_sim, metric)
        far = _expanded(_pairs(sets, None, min_sim, metric), rows, rows) \
            .where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "sim")
        return far.unionByName(_expanded(_itself(sets), rows, rows).where("i < j"))
    other, other_sets, other_one_each = _classes(b, key, bits)
    if one_each and other_one_each:
        return _pairs(rows, other, min_sim, metric)
    if one_each:
        rows = _with_set(rows, sets)
    if other_one_each:
        other = _with_set(other, other_sets)
    return _expanded(_pairs(sets, other_sets, min_sim, metric), rows, other)


def _classes(df: DataFrame, key: str, bits: str) -> tuple[DataFrame, DataFrame, bool]:
    """Rows with on-bits (``id, bits`` and the number ``set`` of their bits), the different
    sets (``id, bits``), and whether most rows have a set of their own."""
    rows = df.select(F.col(key).alias("id"), F.array_sort(bits).alias("bits")).where(F.size("bits") > 0)
    sets = stored(rows.select("bits").distinct().withColumn("id", F.monotonically_increasing_id()), "sim-sets")
    one_each = 2 * sets.count() > rows.count()
    if not one_each:
        rows = stored(_with_set(rows, sets), "sim-rows")
    return rows, sets, one_each


def _with_set(rows: DataFrame, sets: DataFrame) -> DataFrame:
    of = sets.select(F.col("bits").alias("b"), F.col("id").alias("set"))
    return rows.join(of, F.col("bits") == F.col("b")).drop("b", "bits")


def _itself(sets: DataFrame) -> DataFrame:
    return sets.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("sim"))


def _expanded(pairs: DataFrame, rows: DataFrame, other: DataFrame) -> DataFrame:
    """The pairs of rows that have a pair of sets."""
    x = rows.select(F.col("set").alias("x"), F.col("id").alias("xi"))
    y = other.select(F.col("set").alias("y"), F.col("id").alias("yi"))
    return pairs.join(x, F.col("i") == F.col("x")).join(y, F.col("j") == F.col("y")) \
        .select(F.col("xi").alias("i"), F.col("yi").alias("j"), "sim")


#: Most words for which a product is weighed; sets per block; the cost of a candidate of the
#: prefix join, and of a pair of a product by its words.
PRODUCT_WORDS, PRODUCT_ROWS = 16, 2048
CANDIDATE_COST, PAIR_COST, WORD_COST = 200.0, 2.0, 6.0


def _pays(left: DataFrame, right: DataFrame | None, words: int) -> bool:
    """Whether a product of all pairs costs less than the prefix join's candidates."""
    if words > PRODUCT_WORDS:
        return False

    def counted(d: DataFrame, side: str) -> dict:
        rows = d.groupBy(f"{side}_tok").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(f"{side}_i") == 0).alias("r"))
        return {r[f"{side}_tok"]: (r["n"], r["r"]) for r in rows.collect()}     # at most the fingerprint's width

    x = counted(left, "a")
    y = x if right is None else counted(right, "b")
    candidates = sum(n * y[t][0] for t, (n, _) in x.items() if t in y)
    pairs = sum(r for _, r in x.values()) * sum(r for _, r in y.values())
    return candidates * CANDIDATE_COST > pairs * (PAIR_COST + WORD_COST * words)


def _product(a: DataFrame, b: DataFrame | None, rank, words: int, min_sim: float, metric: str, t_jac: float) -> DataFrame:
    """All pairs of blocks of sets with n and m on-bits, where the lengths allow ``min_sim``."""
    kind = [dict(a.dtypes)["id"], dict((a if b is None else b).dtypes)["id"]]

    def blocks(df: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
        rows = df.select("id", F.size("bits").alias(f"n{side}"), F.transform("bits", rank).alias("r"))
        rows = rows.select("id", f"n{side}", F.xxhash64("id", "r").alias("h"),
                           *[m.alias(f"w{w}") for w, m in enumerate(_words(F.col("r"), words))])
        cuts = rows.groupBy(f"n{side}").agg(F.ceil(F.count(F.lit(1)) / PRODUCT_ROWS).alias("cuts"))
        cut = rows.join(F.broadcast(cuts), f"n{side}").withColumn(f"c{side}", F.pmod("h", "cuts"))
        packed = cut.groupBy(f"n{side}", f"c{side}").agg(F.collect_list(F.struct(
            "id", F.array(*[f"w{w}" for w in range(words)]).alias("w"))).alias("s"))
        return (packed.select(f"n{side}", f"c{side}", F.col("s.id").alias("ids"), F.flatten("s.w").alias("w")),
                cuts.select(f"n{side}", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1)).alias(f"c{side}")))

    x, x_at = blocks(a, 1)
    y, y_at = blocks(a if b is None else b, 2)
    n, m = F.col("n1"), F.col("n2")
    may = (m >= n * F.lit(t_jac) - F.lit(_EPS)) & (m * F.lit(t_jac) <= n + F.lit(_EPS))
    if b is None:
        may = may & ((n < m) | ((n == m) & (F.col("c1") <= F.col("c2"))))
    meet, of = x_at.crossJoin(F.broadcast(y_at)).where(may), ["n1", "c1", "n2", "c2"]
    once = b is None

    def bits(t: pa.Table) -> np.ndarray:
        w = t.column("w").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return np.unpackbits(w.view(np.uint8)).reshape(-1, 64 * words).astype(np.float32)

    def search(key: tuple, p: pa.Table, q: pa.Table) -> pa.Table:
        n, c, m, d = (v.as_py() for v in key)
        both = np.arange(min(n, m) + 1, dtype=np.float64)
        sims = both / (n + m - both) if metric == "tanimoto" else 2.0 * both / (n + m)
        least = int(np.searchsorted(sims, min_sim))     # it grows with the bits in common
        found: list[tuple] = []
        if p.num_rows and q.num_rows and least < len(sims):
            ids, jds = (t.column("ids").combine_chunks().flatten() for t in (p, q))
            x, y = bits(p), bits(q).T
            for at in range(0, len(x), 256):
                common = x[at:at + 256] @ y
                i, j = np.nonzero(common >= least)
                sim = pa.array(sims[common[i, j].astype(np.int64)])
                i, j = ids.take(pa.array(at + i)), jds.take(pa.array(j))
                if once:
                    keep = pc.less(i, j) if (n, c) == (m, d) else pc.not_equal(i, j)
                    i, j, sim = i.filter(keep), j.filter(keep), sim.filter(keep)
                    less = pc.less(i, j)
                    i, j = pc.if_else(less, i, j), pc.if_else(less, j, i)
                found.append((i, j, sim))
        types = [t.schema.field("ids").type.value_type for t in (p, q)] + [pa.float64()]
        return pa.table({c: pa.chunked_array([f[k] for f in found], types[k]) for k, c in enumerate(("i", "j", "sim"))})

    p = x.join(meet.select(*[F.col(c).alias(f"x_{c}") for c in of]),
               (F.col("n1") == F.col("x_n1")) & (F.col("c1") == F.col("x_c1"))).select(*[f"x_{c}" for c in of], "ids", "w")
    q = y.join(meet.select(*[F.col(c).alias(f"y_{c}") for c in of]),
               (F.col("n2") == F.col("y_n2")) & (F.col("c2") == F.col("y_c2"))).select(*[f"y_{c}" for c in of], "ids", "w")
    return p.groupBy(*[f"x_{c}" for c in of]).cogroup(q.groupBy(*[f"y_{c}" for c in of])) \
        .applyInArrow(search, f"i {kind[0]}, j {kind[1]}, sim double")


def _pairs(a: DataFrame, b: DataFrame | None, min_sim: float, metric: str) -> DataFrame:
    """Pairs of ``id, bits`` rows."""
    t_jac = min_sim if metric == "tanimoto" else min_sim / (2.0 - min_sim)
    key, bits = "id", "bits"
    other = a if b is None else b
    rank, n_distinct = _ranks([a] if b is None else [a, b], bits)
    words = max(1, -(-n_distinct // WORD))
    left = _prepare(a, key, bits, rank, t_jac, "a", words)
    right = _prepare(other, key, bits, rank, t_jac, "b", words)
    if _pays(left, None if b is None else right, words):
        return _product(a, b, rank, words, min_sim, metric, t_jac)
    cond = [F.col("a_tok") == F.col("b_tok"),
            F.col("b_n") >= F.col("a_n") * F.lit(t_jac) - F.lit(_EPS),
            F.col("b_n") * F.lit(t_jac) <= F.col("a_n") + F.lit(_EPS)]
    # positional filter (Xiao et al. 2008): at the first shared bit, at most
    # 1 + min(remaining bits of each side) can still be shared
    need = F.ceil(F.lit(t_jac / (1.0 + t_jac)) * (F.col("a_n") + F.col("b_n")) - F.lit(_EPS))
    cond.append(F.lit(1) + F.least(F.col("a_n") - F.col("a_i") - 1, F.col("b_n") - F.col("b_i") - 1) >= need)
    if b is None:
        cond.append(F.col("a_key") < F.col("b_key"))
    cand = left.join(right, cond, "inner")
    # emit each pair once: at the rarest bit the two prefixes share
    if words <= MOST_WORDS:
        for w in range(words):
            cand = cand.where(F.col(f"a_q{w}").bitwiseAND(F.col(f"b_p{w}")) == 0)
        inter = sum((F.bit_count(F.col(f"a_m{w}").bitwiseAND(F.col(f"b_m{w}"))) for w in range(words)), F.lit(0)).cast("double")
        tot = (F.col("a_n") + F.col("b_n")).cast("double")
        sim = (F.try_divide(inter, tot - inter) if metric == "tanimoto" else F.try_divide(2.0 * inter, tot))
    else:
        cand = cand.where(F.col("a_tok") == F.array_min(F.array_intersect("a_pre", "b_pre")))
        sim = tanimoto_expr("a_r", "b_r") if metric == "tanimoto" else dice_expr("a_r", "b_r")
    return (cand.select(F.col("a_key").alias("i"), F.col("b_key").alias("j"), sim.alias("sim"))
            .where(F.col("sim") >= F.lit(min_sim)))


def similarity_search(reference: DataFrame, targets: DataFrame, key: str, bits: str = "bits",
                      threshold: float | None = 0.5, dice: bool = False) -> DataFrame:
    """One reference fingerprint against every target (``bulk_similarity``).

    ``reference`` must hold exactly one row (checked, then broadcast).
    Output ``(number, fp_reference, fp_target, similarity)``; with a threshold
    only targets with ``similarity >= threshold`` remain.
    """
    if reference.limit(2).count() != 1:
        raise ValueError("similarity_search needs exactly one reference row")
    ref = reference.select(F.col(key).alias("fp_reference"), F.col(bits).alias("_rb"))
    j = targets.select(F.col(key).alias("fp_target"), F.col(bits).alias("_tb")).crossJoin(F.broadcast(ref))
    out = j.select(F.col("fp_target").alias("number"), "fp_reference", "fp_target",
                   fp_similarity("_rb", "_tb", dice).alias("similarity"))
    if threshold is not None:
        out = out.where(F.col("similarity") >= F.lit(threshold))
    return out


def dice_summary(df: DataFrame, bits: str) -> DataFrame:
    """``(n, mean, std)`` of the full n×n Dice matrix (diagonal included), exactly and
    without forming pairs.

    With rows grouped by their number of bits, the sum of common bits over two classes
    is a sum of products of bit counts, the sum of squared common bits one of products
    of bit co-occurrences.  Both tables are bounded by the fingerprint, not by the
    rows.  A row without bits has similarity 0 with every row, itself included.
    """
    rows = df.select(F.array_distinct(F.coalesce(bits, F.array().cast("array<int>"))).alias("b")) \
        .withColumn("l", F.size("b"))
    one = rows.select("l", F.explode("b").alias("u")).groupBy("l", "u").agg(
        F.count(F.lit(1)).cast("double").alias("c"))
    two = rows.select("l", "b", F.explode("b").alias("u")).select("l", "u", F.explode("b").alias("v")) \
        .groupBy("l", "u", "v").agg(F.count(F.lit(1)).cast("double").alias("c"))

    def moment(t: DataFrame, keys: list[str], power: int) -> DataFrame:
        other = t.select(*keys, F.col("l").alias("m"), F.col("c").alias("d"))
        scale = F.pow(2.0 / (F.col("l") + F.col("m")), F.lit(power))
        return t.join(other, keys).agg(F.coalesce(F.sum(F.col("c") * F.col("d") * scale), F.lit(0.0)).alias(f"s{power}"))

    total = rows.agg(F.count(F.lit(1)).alias("n"))
    both = total.crossJoin(F.broadcast(moment(one, ["u"], 1))).crossJoin(F.broadcast(moment(two, ["u", "v"], 2)))
    cells = F.col("n").cast("double") * F.col("n")
    mean = F.try_divide(F.col("s1"), cells)
    return both.select("n", mean.alias("mean"), F.sqrt(F.greatest(
        F.try_divide(F.col("s2"), cells) - mean * mean, F.lit(0.0))).alias("std"))


def similarity_summary(pairs: DataFrame, n_items: DataFrame | int, sim: str = "sim") -> DataFrame:
    """Mean and population std of the n×n similarity matrix in which everything below
    the threshold of the i<j pair table is set to 0 (diagonal 1).  Not the mean of
    the full matrix; see ``dice_summary`` for that."""
    agg = pairs.agg(F.coalesce(F.sum(sim), F.lit(0.0)).alias("_s"),
                    F.coalesce(F.sum(F.col(sim) * F.col(sim)), F.lit(0.0)).alias("_s2"))
    if isinstance(n_items, int):
        nn = agg.withColumn("_n", F.lit(float(n_items)))
    else:
        nn = agg.crossJoin(n_items.agg(F.count(F.lit(1)).cast("double").alias("_n")))
    mean = (2 * F.col("_s") + F.col("_n")) / (F.col("_n") * F.col("_n"))
    m2 = (2 * F.col("_s2") + F.col("_n")) / (F.col("_n") * F.col("_n"))
    return nn.select(F.col("_n").cast("long").alias("n"), mean.alias("mean"),
                     F.sqrt(F.greatest(m2 - mean * mean, F.lit(0.0))).alias("std"))


def embedding_bits(col: str = "embedding") -> Column:
    """On-bits of a numeric vector: 0-based positions with a positive value."""
    return F.filter(F.transform(F.col(col), lambda v, i: F.when(v > 0, i)), lambda x: x.isNotNull())
