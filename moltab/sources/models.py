"""Saving and loading of every fitted model of this package.

A model is a folder: ``meta`` holds its kind and numbers as JSON, ``part-*`` the MLlib
models it is made of, ``table`` the rows that a nearest-neighbour model predicts from.
All of it is written and read by Spark, so the folder can lie in any store that Spark
reaches.
"""

from __future__ import annotations

import importlib
import json
from dataclasses import fields

import numpy as np
from pyspark.sql import SparkSession

from moltab.operators import models
from moltab.operators.gram import Pca
from moltab.operators.scaling import FeaturePrepModel, MinMaxModel, OneHotModel

#: Models that are numbers, names and arrays only.
PLAIN = {c.__name__: c for c in (models.BayesRidgeModel, MinMaxModel, OneHotModel, Pca)}


def _plain(model) -> dict:
    return {f.name: _value(getattr(model, f.name)) for f in fields(model)}


def _value(v):
    if isinstance(v, np.ndarray):
        return {"array": v.tolist()}
    if isinstance(v, dict):
        return {"dict": [[k, _value(x)] for k, x in v.items()]}
    if isinstance(v, tuple):
        return {"tuple": [_value(x) for x in v]}
    return v.item() if isinstance(v, np.generic) else v


def _back(v):
    if not isinstance(v, dict):
        return v
    kind, x = next(iter(v.items()))
    if kind == "array":
        return np.array(x)
    return {k: _back(y) for k, y in x} if kind == "dict" else tuple(map(_back, x))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _write_meta(spark: SparkSession, meta: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def _write_ml(model, path: str) -> str:
    model.write().overwrite().save(path)
    return f"{type(model).__module__}.{type(model).__name__}"


def _read_ml(name: str, path: str):
    module, _, cls = name.rpartition(".")
    if not module.startswith("pyspark.ml"):
        raise ValueError(f"{name} is no MLlib model")
    return getattr(importlib.import_module(module), cls).load(path)


def save_model(model, path: str, overwrite: bool = False) -> str:
    """Save a model; an existing folder is an error unless ``overwrite``."""
    spark = SparkSession.getActiveSession()
    if _exists(spark, path) and not overwrite:
        raise FileExistsError(path)
    kind = type(model).__name__
    if kind in PLAIN:
        meta = _plain(model)
    elif isinstance(model, models.MLlibModel):
        meta = {"class": _write_ml(model.model, f"{path}/part-0")}
    elif isinstance(model, models.AdaBoostModel):
        meta = {"class": [_write_ml(m, f"{path}/part-{i}") for i, m in enumerate(model.stumps)],
                "alphas": list(map(float, model.alphas)), "classes": list(map(float, model.classes))}
    elif isinstance(model, models.RffModel):
        meta = {"class": _write_ml(model.linear.model, f"{path}/part-0"), "w": _value(model.w), "b": _value(model.b)}
    elif isinstance(model, models.KnnModel):
        model.train.write.mode("overwrite").parquet(f"{path}/table")
        meta = {"k": model.k, "regression": model.regression, "dim": model.dim}
    elif isinstance(model, FeaturePrepModel):
        meta = {f.name: getattr(model, f.name) for f in fields(model) if f.name not in ("minmax", "onehot")}
        meta |= {"minmax": model.minmax and _plain(model.minmax), "onehot": model.onehot and _plain(model.onehot)}
    elif hasattr(model, "write"):      # an MLlib model or pipeline by itself
        kind, meta = "MLlib", {"class": _write_ml(model, f"{path}/part-0")}
    else:
        raise TypeError(f"{kind} cannot be saved")
    _write_meta(spark, {"kind": kind, **meta}, path)     # last: a folder without it is not a model
    return path


def load_model(path: str):
    """The model that :func:`save_model` wrote."""
    spark = SparkSession.getActiveSession()
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    kind = meta.pop("kind")
    if kind in PLAIN:
        return PLAIN[kind](**{k: _back(v) for k, v in meta.items()})
    if kind == "MLlib":
        return _read_ml(meta["class"], f"{path}/part-0")
    if kind == "MLlibModel":
        return models.MLlibModel(_read_ml(meta["class"], f"{path}/part-0"))
    if kind == "AdaBoostModel":
        stumps = [_read_ml(c, f"{path}/part-{i}") for i, c in enumerate(meta["class"])]
        return models.AdaBoostModel(stumps, meta["alphas"], meta["classes"])
    if kind == "RffModel":
        linear = models.MLlibModel(_read_ml(meta["class"], f"{path}/part-0"))
        return models.RffModel(_back(meta["w"]), _back(meta["b"]), linear)
    if kind == "KnnModel":
        return models.KnnModel(spark.read.parquet(f"{path}/table"), **meta)
    if kind == "FeaturePrepModel":
        part = lambda name, cls: meta[name] and cls(**{k: _back(v) for k, v in meta[name].items()})
        return FeaturePrepModel(**{**meta, "minmax": part("minmax", MinMaxModel), "onehot": part("onehot", OneHotModel)})
    raise ValueError(f"unknown kind of model {kind!r} in {path}")
