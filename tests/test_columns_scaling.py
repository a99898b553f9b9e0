import pytest
from pyspark.sql import functions as F

from moltab.operators import columns, scaling, splits, stats


def test_label_two_class(spark):
    df = spark.createDataFrame([(3.0,), (4.0,), (5.0,), (None,)], "t double")
    got = [r.classes for r in columns.label_two_class(df, "t", 4).collect()]
    assert got == [0, 1, 1, None]


def test_constant_cols(spark):
    df = spark.createDataFrame([(1, 2, i) for i in range(1, 6)], "A int, B int, C int")
    keep = {r.feature: r.keep for r in columns.constant_cols(df, ["A", "B", "C"]).collect()}
    assert keep == {"A": False, "B": False, "C": True}


def test_select_columns_single_pass(spark):
    df = spark.createDataFrame([(i, 0.0, 1.0, float(i) if i % 2 else None) for i in range(10)],
                               "id int, z double, c double, s double")
    out = columns.select_columns(df, ["z", "c", "s"], always=["id"], max_null_frac=0.7)
    assert out.columns == ["id", "s"]


def test_scalers(spark):
    df = spark.createDataFrame([(i, i + 4, i + 8) for i in range(1, 6)], "A int, B int, C int")
    a = scaling.autoscale(df, ["A", "B", "C"])
    m = a.agg(*[F.avg(c).alias(c) for c in "ABC"]).first()
    assert all(abs(m[c]) < 1e-12 for c in "ABC")
    mm = scaling.minmaxscale(df, ["A", "B", "C"]).agg(F.min("A").alias("lo"), F.max("C").alias("hi")).first()
    assert (mm.lo, mm.hi) == (0.0, 1.0)
    lg = scaling.log2_scale(df.withColumn("A", F.col("A") - 1), ["A"]).collect()
    assert lg[0].A is None and lg[1].A == 0.0


def test_feature_prep_apply_golden(spark):
    train = spark.createDataFrame([(1, 10, "A"), (2, 20, "B"), (3, 30, "A"), (4, 40, "B"), (5, 50, "A")],
                                  "x int, y int, cat string")
    test = spark.createDataFrame([(2, 15, "A"), (3, 35, "B")], "x int, y int, cat string")
    model = scaling.FeaturePrep("some_categorical", categorical=["cat"]).fit(train)
    rows = model.transform(test).collect()
    assert [tuple(r) for r in rows] == [(0.25, 0.125, 1, 0), (0.5, 0.625, 0, 1)]
    assert model.feature_names == ["x", "y", "cat_A", "cat_B"]


def test_onehot_unknown_is_zero(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    test = spark.createDataFrame([("z",), (None,)], "c string")
    rows = scaling.onehot_fit(train, ["c"]).transform(test).collect()
    assert [tuple(r) for r in rows] == [(0, 0), (0, 0)]


def test_kfold_sizes(spark):
    df = spark.range(119).withColumnRenamed("id", "k")
    sizes = sorted(r["count"] for r in splits.kfold(df, "k", 10, seed=1).groupBy("fold").count().collect())
    assert sizes == [11] + [12] * 9
    s = splits.split_random(df, "k", 0.2, seed=42).where("is_test").count()
    assert s == 24


def test_corr_pair_and_errors(spark):
    df = spark.createDataFrame([(float(x), float(2 * x)) for x in range(1, 6)], "x double, y double")
    assert stats.corr_pair(df, "x", "y").first().r == pytest.approx(1.0)
    with pytest.raises(ValueError):
        stats.corr_pair(df, "x", "y", "cosine")


def test_constant_corr_is_null(spark):
    df = spark.createDataFrame([(1.0, float(x)) for x in range(5)], "x double, y double")
    assert stats.corr_pair(df, "x", "y").first().r is None


def test_kendall_matches_pair_count(spark):
    import random
    rnd = random.Random(5)
    pts = [(rnd.randint(0, 6), rnd.randint(0, 9)) for _ in range(300)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "x double, y double")
    got = stats.kendall_tau(df, "x", "y").first().tau
    n = len(pts)
    s = sum((1 if (pts[i][0] - pts[j][0]) * (pts[i][1] - pts[j][1]) > 0 else
             -1 if (pts[i][0] - pts[j][0]) * (pts[i][1] - pts[j][1]) < 0 else 0)
            for i in range(n) for j in range(i + 1, n))
    from collections import Counter
    n0 = n * (n - 1) / 2
    n1 = sum(c * (c - 1) / 2 for c in Counter(p[0] for p in pts).values())
    n2 = sum(c * (c - 1) / 2 for c in Counter(p[1] for p in pts).values())
    assert got == pytest.approx(s / ((n0 - n1) * (n0 - n2)) ** 0.5)


def test_exact_quantiles(spark):
    import numpy as np
    vals = [float(v) for v in [5, 1, 3, 3, 9, 2, 8, 8, 8, 4]]
    df = spark.createDataFrame([(v,) for v in vals], "value double")
    q = {r.q: r.quantile for r in stats.exact_quantiles(df, "value", [0.25, 0.5, 0.75]).collect()}
    for p in (0.25, 0.5, 0.75):
        assert q[p] == pytest.approx(float(np.quantile(vals, p)))


def test_folds_of_few_groups_stay_spread(spark):
    """A group's rows are not brought into one task to learn the group's size."""
    n = 4000
    df = spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "m1").otherwise("m2").alias("model"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = splits.kfold(df, "id", 3, seed=3, by=["model"]).withColumn("at", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    held, folds = {}, {}
    for r in got:
        held[r["at"]] = held.get(r["at"], 0) + 1
        folds[r["model"], r["fold"]] = folds.get((r["model"], r["fold"]), 0) + 1
    assert max(held.values()) < 0.45 * n
    assert sorted(folds.values()) == [666, 666, 667, 667, 667, 667] and len({r["id"] for r in got}) == n
