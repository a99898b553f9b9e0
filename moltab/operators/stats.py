"""Correlations, ranks, quantiles, histograms and feature selection (§2.4, §2.5, §2.10).

Pearson is computed from population moments with ``try_divide`` so a
constant column yields NULL instead of an ANSI error.  Spearman ranks come
from :func:`moltab.operators.ordered.average_rank` (distributed, tie-averaged).
Per-feature work runs on the long form in one grouped aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moltab.operators.concordance import kendall_tau
from moltab.operators.gram import corr_pairs
from moltab.operators.ordered import average_rank, rank_table, running_sum
from moltab.operators.permutation import permutation_test

METHODS = ("pearson", "spearman", "kendall")


def _check_method(method: str) -> None:
    if method not in METHODS:
        raise ValueError(f"unknown correlation method {method!r}; use one of {METHODS}")


def pearson_agg(x: str | Column, y: str | Column) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    y = F.col(y) if isinstance(y, str) else y
    den = F.sqrt(F.var_pop(x) * F.var_pop(y))
    return F.try_divide(F.covar_pop(x, y), F.when(den > 0, den))


def corr_features(df: DataFrame, cols: Sequence[str], target: str, method: str = "pearson",
                  key: str | None = None) -> DataFrame:
    """``(feature, n, r)`` for every feature against ``target``, pairwise-complete rows."""
    _check_method(method)
    keycols = [key] if key else []
    base = df.select(*keycols, *[F.col(c).cast("double").alias(c) for c in cols],
                     F.col(target).cast("double").alias("_y"))
    long = base.unpivot(keycols + ["_y"], list(cols), "feature", "value") \
        .where(F.col("value").isNotNull() & F.col("_y").isNotNull())
    if method == "pearson":
        return long.groupBy("feature").agg(F.count(F.lit(1)).alias("n"),
                                           pearson_agg("value", "_y").alias("r"))
    if method == "spearman":
        return _spearman(base.where(F.col("_y").isNotNull()), list(cols))
    return kendall_tau(long, "value", "_y", by=["feature"]).withColumnRenamed("tau", "r")


def _spearman(base: DataFrame, cols: list[str]) -> DataFrame:
    """``feature, n, r`` over rows with a target ``_y``.  Features without nulls share the
    target's ranks, which are joined before the rows are made long."""
    holes = base.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    full = [c for c in cols if not holes[c]]
    out = None
    for part, own in (([c for c in cols if c not in full], True), (full, False)):
        if not part:
            continue
        rows = base.select("_y", *part) if own else average_rank(base.select("_y", *part), "_y", out="_ry")
        kept = ["_y"] if own else ["_ry"]
        long = rows.unpivot(kept, part, "feature", "value").where(F.col("value").isNotNull())
        ranked = average_rank(long, "value", by=["feature"], out="_rx")
        if own:   # ranks of the target among the feature's rows, from the rows before the first join
            ys = rank_table(long, "_y", ["feature"], "_ry")
            ranked = ranked.join(ys, ["feature", "_y"])
        one = ranked.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), pearson_agg("_rx", "_ry").alias("r"))
        out = one if out is None else out.unionByName(one)
    return out


def corr_pair(df: DataFrame, x: str, y: str, method: str = "pearson") -> DataFrame:
    """Correlation of two columns as ``(x, y, r)`` (the off-diagonal of the 2×2 matrix)."""
    _check_method(method)
    res = corr_features(df, [x], y, method)
    return res.select(F.lit(x).alias("x"), F.lit(y).alias("y"), "r")


def corr_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """All pairs ``(f1, f2, r)``, ``f1 < f2`` by position, from one blocked Gram pass.

    For Spearman every column is first replaced by its average rank.
    """
    _check_method(method)
    if method == "kendall":
        raise ValueError("use kendall_tau for pairwise Kendall")
    d = df
    cols = list(cols)
    if method == "spearman":
        d = d.withColumn("_rid", F.monotonically_increasing_id())
        for c in cols:
            d = average_rank(d, c, out=f"_r_{c}")
        d = d.select(*[F.col(f"_r_{c}").alias(c) for c in cols])
    return corr_pairs(d, cols)


# ------------------------------------------------------------ quantiles, describe, histogram

def exact_quantiles(long: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles ``(by…, q, quantile)`` without buffering groups.

    Counts per distinct value are cumulated with the bucketed running sum; the
    two order statistics around ``(n-1)·q`` are picked by comparing positions.
    """
    by = list(by)
    counts = (long.where(F.col(value).isNotNull())
              .groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_c")))
    cum = running_sum(counts, "_v", ["_c"], by=by, prefix="_cum")
    n = counts.groupBy(*by).agg(F.sum("_c").alias("_n"))
    qs = long.sparkSession.createDataFrame([(float(p),) for p in probs], "q double")
    tgt = n.crossJoin(F.broadcast(qs)).select(
        *by, "q", ((F.col("_n") - 1) * F.col("q")).alias("_pos"))
    tgt = tgt.select(*by, "q", "_pos", F.floor("_pos").alias("_lo"), F.ceil("_pos").alias("_hi"))
    j = cum.join(tgt, by) if by else cum.crossJoin(tgt)
    start = F.col("_cum_c") - F.col("_c")
    inlo = (start <= F.col("_lo")) & (F.col("_lo") < F.col("_cum_c"))
    inhi = (start <= F.col("_hi")) & (F.col("_hi") < F.col("_cum_c"))
    g = j.where(inlo | inhi).groupBy(*by, "q").agg(
        F.max(F.when(inlo, F.col("_v"))).alias("_vlo"), F.max(F.when(inhi, F.col("_v"))).alias("_vhi"),
        F.first("_pos").alias("_pos"), F.first("_lo").alias("_lo"))
    return g.select(*by, "q", (F.col("_vlo") + (F.col("_pos") - F.col("_lo")) *
                               (F.col("_vhi") - F.col("_vlo"))).alias("quantile"))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """pandas ``describe``: ``(feature, count, mean, std, min, q25, q50, q75, max)``."""
    d = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    long = d.unpivot([], list(cols), "feature", "value")
    basic = long.groupBy("feature").agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                                        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                        F.max("value").alias("max"))
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], by=["feature"])
    qw = q.groupBy("feature").agg(
        F.max(F.when(F.col("q") == 0.25, F.col("quantile"))).alias("q25"),
        F.max(F.when(F.col("q") == 0.5, F.col("quantile"))).alias("q50"),
        F.max(F.when(F.col("q") == 0.75, F.col("quantile"))).alias("q75"))
    return basic.join(qw, "feature", "left").select("feature", "count", "mean", "std", "min",
                                                    "q25", "q50", "q75", "max")


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 20, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between each feature's min and max: ``(by…, feature, bin, count)``.

    Edges come from the whole column (all classes), as in the reference's
    overlaid histograms; the max falls in the last bin; a constant column
    lands in bin 0.
    """
    by = list(by)
    d = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    long = d.unpivot(by, list(cols), "feature", "value").where(F.col("value").isNotNull())
    rng = long.groupBy("feature").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    j = long.join(F.broadcast(rng), "feature")  # one row per feature: bounded by the column count
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width > 0, F.least(F.floor((F.col("value") - F.col("_lo")) / width * bins),
                                  F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    return j.groupBy(*by, "feature", b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


# ------------------------------------------------------------ selection

def corr_select(df: DataFrame, cols: Sequence[str], target: str, method: str = "spearman",
                thresh: float = 0.4, max_null_frac: float = 0.7, perm: dict | None = None,
                key: str | None = None) -> DataFrame:
    """``find_correlating_features``: per feature skip if ≥ ``max_null_frac`` null,
    select if |r| > thresh (strict); with ``perm`` (``n_perm, sig_level, seed,
    alternative``) the selected features also get a permutation p-value and a
    ``significant`` flag.  ``(feature, n, null_frac, r, selected, p_value, significant)``"""
    from moltab.operators.columns import feature_stats

    st = feature_stats(df, cols).select("feature", (F.col("n_null") / F.col("n")).alias("null_frac"))
    c = corr_features(df, cols, target, method, key=key)
    out = st.join(c, "feature", "left").withColumn(
        "selected", (F.col("null_frac") < max_null_frac) & F.coalesce(F.abs(F.col("r")) > thresh, F.lit(False)))
    if not perm:
        return out.withColumn("p_value", F.lit(None).cast("double")).withColumn("significant", F.lit(None).cast("boolean"))
    if key is None:
        raise ValueError("the permutation test needs a key column")
    sel = [r["feature"] for r in out.where("selected").select("feature").collect()]  # ≤ column count
    if not sel:
        return out.withColumn("p_value", F.lit(None).cast("double")).withColumn("significant", F.lit(None).cast("boolean"))
    pv = permutation_test(df, key, sel, target, method, int(perm.get("n_perm", 10_000)),
                          int(perm.get("seed", 2024)), perm.get("alternative", "two-sided"))
    lvl = float(perm.get("sig_level", 0.05))
    return out.join(pv.select("feature", "p_value"), "feature", "left").withColumn(
        "significant", F.col("p_value") < lvl)
