"""Saving and loading of every kind of model; one-hot in long form."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from moltab.operators import gram, models, scaling, sparse
from moltab.operators.joins import join_hot
from moltab.session import scratch_path
from moltab.sources.models import load_model, save_model


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *map(float, rng.normal(size=3)), float(i % 2)) for i in range(80)]
    rows = [(i, a + y, b, c - y, y) for i, a, b, c, y in rows]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label double")
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).checkpoint()


@pytest.mark.parametrize("kind, params", [
    ("logreg", {}), ("dtree_clf", {}), ("dtree_reg", {}), ("forest_reg", {"n_estimators": 3}), ("adaboost", {"n_estimators": 2}),
    ("knn_clf", {"n_neighbors": 3}), ("kernel_reg", {"n_components": 10}), ("bayes_ridge", {}), ("lasso", {"alpha": 0.1})])
def test_a_loaded_model_predicts_alike(spark, data, kind, params):
    model = models.make(kind, **params).fit(data)
    path = save_model(model, scratch_path(spark, "test-model"))
    back = load_model(path)
    assert type(back) is type(model)
    told = [sorted(tuple(r) for r in m.transform(data).select("id", "prediction").collect()) for m in (model, back)]
    assert told[0] == told[1] and len(told[0]) == 80
    with pytest.raises(FileExistsError):
        save_model(model, path)


def test_prepared_features_are_saved(spark, data):
    d = data.select("id", "a", "b", F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y'z").alias("k"), (F.col("id") % 2 == 0).alias("t"))
    for mode in scaling.FeaturePrep.MODES:
        d_ = d if mode != "no_categorical" else d.drop("k")
        model = scaling.FeaturePrep(mode, ["k"] if mode == "some_categorical" else None, exclude=["id"]).fit(d_)
        path = scratch_path(spark, "test-prep")
        save_model(model, path)
        save_model(model, path, overwrite=True)
        back = load_model(path)
        assert back == model
        rows = [sorted(map(str, m.transform(d_, key=["id"]).collect())) for m in (model, back)]
        assert rows[0] == rows[1] and len(rows[0]) == 80


def test_components_are_saved(spark, data):
    model = gram.pca(data, ["a", "b", "c"], whiten=True)
    back = load_model(save_model(model, scratch_path(spark, "test-pca")))
    assert back.cols == model.cols and np.array_equal(back.components, model.components) and back.whiten
    assert sorted(back.transform(data).select("id", "pc1", "pc3").collect()) == sorted(model.transform(data).select("id", "pc1", "pc3").collect())


def test_what_cannot_be_saved(spark):
    with pytest.raises(TypeError):
        save_model(object(), scratch_path(spark, "test-none"))


def test_onehot_long(spark):
    rows = [(i, ["a", "b", None, "z"][i % 4], i % 3 if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, k string, n int")
    known = df.where("k <> 'z' or k is null")
    d = sparse.onehot_dictionary(known, ["k", "n"])
    told = {(r.feature, r.value): r["index"] for r in d.collect()}
    assert told == {("k", "a"): 0, ("k", "b"): 1, ("n", "0"): 2, ("n", "1"): 3, ("n", "2"): 4}
    got = sorted((r.id, r.feature, r["index"]) for r in sparse.onehot_long(df, "id", ["k", "n"], d).collect())
    want = sorted((i, f, told[f, str(v)]) for i, k, n in rows for f, v in (("k", k), ("n", n)) if (f, str(v)) in told and v is not None)
    assert got == want
    wide = scaling.onehot_fit(known, ["k"]).transform(df)
    assert wide.agg(F.sum("k_a")).first()[0] == sum(f == "k" and x == 0 for _, f, x in got)
    empty = sparse.onehot_dictionary(df.limit(0), ["k"])
    assert sparse.onehot_long(df, "id", ["k"], empty).count() == 0


def test_hot_keys_are_joined_once(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 2 == 0, 9).otherwise(F.col("id") % 2500).alias("k"), "id")
    one = rows.groupBy("k").count().withColumn("name", F.concat(F.lit("n"), "k"))
    got = join_hot(rows, one, ["k"], "count", 5000)
    assert got.count() == 5000 and got.where("name <> concat('n', k)").count() == 0 and got.columns == ["k", "id", "name"]
