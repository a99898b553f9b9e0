"""SMOTE oversampling.

Every non-majority class grows to the majority size.  New row m of class c
takes base row (m mod n_c) in hash order, its neighbour of rank
1 + floor(u·k) among the class's k nearest (exact band-join kNN, no cross
join) and x_new = x + u'·(x_nn − x); u, u' are hashes of (class, m, seed).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moltab.functions.rng import hash32, u01
from moltab.operators.neighbors import knn
from moltab.operators.ordered import row_number


#: Synthetic rows made by one task step.
DRAWS_PER_BLOCK = 100_000


def _minority(df: DataFrame, label: str) -> DataFrame:
    """Rows of the classes that are smaller than the largest one."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    nmax = counts.agg(F.max("_nc").alias("_nmax"))
    return df.join(counts.crossJoin(F.broadcast(nmax)).where("_nc < _nmax").select(label), label, "left_semi")


def _draw_numbers(small: DataFrame, *cols: str) -> DataFrame:
    """``_m`` = 0 .. ``_need`` - 1 per class, in blocks that are spread over the tasks."""
    first = small.select(*cols, "_need", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("_need") - 1, F.lit(DRAWS_PER_BLOCK).cast("long"))).alias("_lo"))
    spread = first.repartition(*cols[:1], "_lo")
    return spread.select(*cols, F.explode(F.sequence(
        "_lo", F.least(F.col("_lo") + DRAWS_PER_BLOCK, F.col("_need")) - 1)).alias("_m"))


def smote(df: DataFrame, key: str, vec: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Input rows plus synthetic rows; ``is_synthetic`` flags the new ones, whose key is
    ``'syn-<class>-<m>'`` (the key column is cast to string)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    nmax = counts.agg(F.max("_nc").alias("_nmax"))
    need = counts.crossJoin(F.broadcast(nmax)).select(label, "_nc", (F.col("_nmax") - F.col("_nc")).alias("_need"))
    small = need.where(F.col("_need") > 0)
    if small.where(F.col("_nc") < 2).limit(1).count():
        raise ValueError("SMOTE needs at least 2 rows in every minority class")
    kk = F.least(F.lit(k), F.col("_nc") - 1)
    # neighbours inside each class
    minor = _minority(df, label)
    nn = knn(minor, minor, key, vec, k, by=[label], exclude_self=True)
    pos = row_number(minor.withColumn("_h", hash32(F.col(key), seed, "smote")), "_h", tiebreak=[key],
                     by=[label], out="_pos")
    # (class, m) for m < need: one generated row per synthetic sample
    gen = _draw_numbers(small.withColumn("_k", kk), label, "_nc", "_k")
    gen = gen.withColumn("_pos", (F.col("_m") % F.col("_nc")) + 1) \
        .withColumn("_rank", (F.floor(u01(F.col(label), F.col("_m"), seed, "nn") * F.col("_k")) + 1).cast("int")) \
        .withColumn("_gap", u01(F.col(label), F.col("_m"), seed, "gap"))
    base = gen.join(pos.select(label, "_pos", F.col(key).alias("q"), F.col(vec).alias("_x")), [label, "_pos"])
    nb = base.join(nn.select(label, "q", F.col("rank").alias("_rank"), "p"), [label, "q", "_rank"])
    nb = nb.join(minor.select(label, F.col(key).alias("p"), F.col(vec).alias("_xn")), [label, "p"])
    new = nb.select(F.concat_ws("-", F.lit("syn"), F.col(label).cast("string"), F.col("_m").cast("string")).alias(key),
                    F.zip_with("_x", "_xn", lambda a, b: a + F.col("_gap") * (b - a)).alias(vec),
                    label, F.lit(True).alias("is_synthetic"))
    orig = df.select(F.col(key).cast("string").alias(key), vec, label, F.lit(False).alias("is_synthetic"))
    return orig.unionByName(new)


def smotenc(df: DataFrame, key: str, numeric: list[str], categorical: list[str], label: str,
            k: int = 5, seed: int = 42) -> DataFrame:
    """SMOTE-NC: numeric features interpolated as in SMOTE; each categorical value of
    a new row is the most frequent value among the base row's k neighbours (ties:
    smallest).  Distances add median(std of numeric features)² per differing
    category: categories are one-hot coded with weight median_std/√2 inside the
    neighbour vector, which contributes exactly that amount per mismatch.
    Returns the input columns plus ``is_synthetic``; new keys ``syn-<class>-<m>``."""
    import math

    from moltab.operators.scaling import onehot_fit

    # median over numeric features of their std (one aggregate row, p values)
    allstd = [r for r in df.agg(*[F.stddev_samp(c).alias(c) for c in numeric]).first()]
    vals = sorted(v for v in allstd if v is not None)
    med = vals[len(vals) // 2] if len(vals) % 2 else 0.5 * (vals[len(vals) // 2 - 1] + vals[len(vals) // 2])
    oh = onehot_fit(df, categorical)
    w = med / math.sqrt(2.0)
    coded = oh.transform(df, keep_input=True)
    vec_parts = [F.col(c).cast("double") for c in numeric] + \
        [F.col(n).cast("double") * F.lit(w) for n in oh.output_names()]
    base = coded.select(key, label, *numeric, *categorical, F.array(*vec_parts).alias("_v"))
    syn = smote(base.select(key, "_v", label), key, "_v", label, k=k, seed=seed).where("is_synthetic")
    # categorical vote among the neighbours of each synthetic row's base row
    minor = _minority(base, label)
    nn = knn(minor, minor, key, "_v", k, by=[label], exclude_self=True)
    pos = row_number(minor.withColumn("_h", hash32(F.col(key), seed, "smote")), "_h", tiebreak=[key],
                     by=[label], out="_pos")
    syn = syn.withColumn("_m", F.element_at(F.split(F.col(key), "-"), -1).cast("long"))
    counts = base.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    syn = syn.join(counts, label).withColumn("_pos", (F.col("_m") % F.col("_nc")) + 1)
    syn = syn.join(pos.select(label, "_pos", F.col(key).alias("q")), [label, "_pos"])
    votes = nn.join(base.select(label, F.col(key).alias("p"), *categorical), [label, "p"])
    out = syn.select(key, label, "_v", "q")
    for c in categorical:
        mode = (votes.groupBy(label, "q", c).agg(F.count(F.lit(1)).alias("_cnt"))
                .groupBy(label, "q").agg(F.min_by(c, F.struct(-F.col("_cnt"), F.col(c))).alias(c)))
        out = out.join(mode, [label, "q"], "left")
    new = out.select(key, *[F.col("_v")[i].alias(c) for i, c in enumerate(numeric)], *categorical, label,
                     F.lit(True).alias("is_synthetic"))
    orig = df.select(F.col(key).cast("string").alias(key), *numeric, *categorical, label,
                     F.lit(False).alias("is_synthetic"))
    return orig.unionByName(new)


def smoten(df: DataFrame, key: str, categorical: list[str], label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """SMOTE-N for all-categorical data: neighbours under the value difference
    metric, every category of a new row = most frequent value among the base
    row's k neighbours (ties: smallest).

    VDM between values a, b of a feature is Σ_c |P(c|a) − P(c|b)|; each value is
    embedded as its class-probability vector P(·|value) (one grouped count per
    feature), and neighbours are searched in that space with the exact kNN.  For
    two classes the embedding 2·P(1|value) makes the Euclidean distance equal
    to the (Σ_f δ_f²)^½ combination of the per-feature VDM; with more classes it
    is the Euclidean distance of the probability vectors.
    """
    classes = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]  # class list: small
    emb_cols = []
    coded = df
    for c in categorical:
        cnt = df.groupBy(c, label).agg(F.count(F.lit(1)).alias("_n"))
        tot = df.groupBy(c).agg(F.count(F.lit(1)).alias("_t"))
        probs = cnt.join(tot, c).groupBy(c).agg(*[
            F.sum(F.when(F.col(label) == F.lit(cl), F.col("_n") / F.col("_t")).otherwise(0.0)).alias(f"_p_{c}_{i}")
            for i, cl in enumerate(classes)])
        coded = coded.join(probs, c, "left")  # one row per category value
        if len(classes) == 2:
            emb_cols.append(F.col(f"_p_{c}_1") * 2.0)
        else:
            emb_cols += [F.col(f"_p_{c}_{i}") for i in range(len(classes))]
    base = coded.select(key, label, *categorical, F.array(*emb_cols).alias("_v"))
    syn = smote(base.select(key, "_v", label), key, "_v", label, k=k, seed=seed).where("is_synthetic")
    minor = _minority(base, label)
    nn = knn(minor, minor, key, "_v", k, by=[label], exclude_self=True)
    pos = row_number(minor.withColumn("_h", hash32(F.col(key), seed, "smote")), "_h", tiebreak=[key],
                     by=[label], out="_pos")
    syn = syn.withColumn("_m", F.element_at(F.split(F.col(key), "-"), -1).cast("long"))
    counts = base.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    syn = syn.join(counts, label).withColumn("_pos", (F.col("_m") % F.col("_nc")) + 1)
    syn = syn.join(pos.select(label, "_pos", F.col(key).alias("q")), [label, "_pos"])
    votes = nn.join(base.select(label, F.col(key).alias("p"), *categorical), [label, "p"])
    out = syn.select(key, label, "q")
    for c in categorical:
        mode = (votes.groupBy(label, "q", c).agg(F.count(F.lit(1)).alias("_cnt"))
                .groupBy(label, "q").agg(F.min_by(c, F.struct(-F.col("_cnt"), F.col(c))).alias(c)))
        out = out.join(mode, [label, "q"], "left")
    new = out.select(key, *categorical, label, F.lit(True).alias("is_synthetic"))
    orig = df.select(F.col(key).cast("string").alias(key), *categorical, label, F.lit(False).alias("is_synthetic"))
    return orig.unionByName(new)
