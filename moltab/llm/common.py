"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltab.operators.joins import join_hot  # noqa: F401  (used by the operators)
from moltab.session import importable, scratch_path  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_CACHES: list[tuple[str, dict]] = []


def worker_cache(owner: str) -> dict:
    """A dictionary that ``owner``'s tasks find again in the same Python worker."""
    made: dict = {}
    _CACHES.append((owner, made))
    return made


def claim(owner: str) -> None:
    """Empty the caches of the other operators.  Workers serve one stage after another: what
    every operator of a pipeline remembers would add up in each of them."""
    stale = [c for o, c in _CACHES if o != owner and c]
    for c in stale:
        c.clear()
    if stale:
        gc.collect()
        pa.default_memory_pool().release_unused()


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back: cuts the
    lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for t in tables:
        spark, path = t.sparkSession, t.staged_at
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def tmp(name: str) -> str:
    """A column name that cannot clash with a caller's column."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list ``(a, b)``.

    Alternating large-star and small-star rounds: every round is two
    aggregations (``min`` per node, combined map-side) and two equi-joins, so a
    node with very many neighbours is one aggregated row on one side and rows
    that AQE may split on the other; neighbours are never collected.  Returns
    ``(node, component)`` for every node that occurs in an edge, ``component``
    being the smallest node reachable.  Self-loops and repeated edges are
    allowed; an empty edge list gives an empty result.
    """
    e = staged(edges.where("a is not null and b is not null and a <> b")
               .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
               "cc-edges")
    before = None
    for _ in range(max_rounds):
        # large star: neighbours above u are linked to the smallest neighbour of u
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")) \
            .select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        large = (both.where("v > u").join(low, F.col("u") == F.col("k"))
                 .where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: neighbours below u, and u, are linked to the smallest of them
        low2 = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = (large.join(low2, F.col("u") == F.col("k"))
                 .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"),
                         F.col("m").alias("v")).distinct())
        old, e = e, staged(small, "cc-edges")
        forget(old)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.groupBy("u").agg(F.min("v").alias("component")) \
                .withColumnRenamed("u", "node") \
                .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component"))
                             .distinct())
        before = now
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")
