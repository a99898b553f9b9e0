"""Session construction and the shared scratch location.

Library code never picks a machine-local folder: intermediate tables go under
the folder named by ``spark.checkpoint.dir``.  Only when that setting is
absent (tests, local runs) do we create one.
"""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CKPT_KEY = "spark.checkpoint.dir"
_CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BLOCK = threading.local()
_OPEN, _CHANGE = {"blocks": 0, "was": None}, threading.Lock()


def get_spark(master: str | None = None, app: str = "moltab",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off."""
    master = master or os.environ.get("MOLTAB_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("MOLTAB_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("MOLTAB_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder.  Unset: a local one is made if the
    master is local; on a cluster that is an error, since nobody else could read it."""
    path = spark.conf.get(_CKPT_KEY, None) or spark.sparkContext.getConf().get(_CKPT_KEY, None)
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set {_CKPT_KEY} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="moltab-ckpt-")
        spark.conf.set(_CKPT_KEY, path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written table."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/moltab-scratch/{name}-{uuid.uuid4().hex[:12]}"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (on a
    cluster without a shared checkout, submit it with ``--py-files``)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back: the lineage is cut, and a lost
    executor costs only the tasks it ran."""
    path = scratch_path(df.sparkSession, name)
    if getattr(_BLOCK, "made", None) is not None:
        _BLOCK.made.append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def released(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose disk is given back: the files of a job's shuffles go when the job has
    ended, the tables that :func:`stored` wrote in this thread when the block ends, but for
    those handed to the function that the block gets."""
    outer = getattr(_BLOCK, "made", None)
    _BLOCK.made, kept = [], set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.stored_at)
        return df

    with _CHANGE:       # blocks of several threads share the session's setting
        if not _OPEN["blocks"]:
            _OPEN["was"] = spark.conf.get(_CLEAN_KEY, None)
            spark.conf.set(_CLEAN_KEY, "true")
        _OPEN["blocks"] += 1
    try:
        yield keep
    except BaseException:
        kept.clear()
        raise
    finally:
        made, _BLOCK.made = _BLOCK.made, outer
        with _CHANGE:
            _OPEN["blocks"] -= 1
            if not _OPEN["blocks"]:
                spark.conf.unset(_CLEAN_KEY) if _OPEN["was"] is None else spark.conf.set(_CLEAN_KEY, _OPEN["was"])
        for path in made:
            if path not in kept:
                delete(spark, path)
            elif outer is not None:
                outer.append(path)
