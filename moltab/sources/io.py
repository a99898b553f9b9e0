"""Sources and sinks.

Readers always take an explicit schema (no inference in library code).  Row
identity is an explicit ``row_id``: taken from a key column when there is
one, else numbered once at ingest in file order with the distributed
row-number (counts of the earlier file splits plus the position in the own one).
Writers partition per (model, fold) so later reads prune by directory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLF_PRED_SCHEMA = T.StructType([
    T.StructField("pos", T.LongType()), T.StructField("m_index", T.StringType()),
    T.StructField("known", T.DoubleType()), T.StructField("prediction", T.DoubleType()),
    T.StructField("prob0", T.DoubleType()), T.StructField("prob1", T.DoubleType())])

REG_PRED_SCHEMA = T.StructType([
    T.StructField("pos", T.LongType()), T.StructField("index", T.StringType()),
    T.StructField("known", T.DoubleType()), T.StructField("prediction", T.DoubleType())])


def with_row_id(df: DataFrame, out: str = "row_id") -> DataFrame:
    """Consecutive 0-based ids in file order: path, then position in the file.

    A scan may read files in any order, so the id is the exact row count of all
    earlier file splits plus the position inside the row's own split (scan ids are
    consecutive inside a split).  Only one row per split is aggregated and ordered.
    """
    d = df.withColumn("_path", F.col("_metadata.file_path")) \
        .withColumn("_start", F.col("_metadata.file_block_start")) \
        .withColumn("_scan", F.monotonically_increasing_id())
    splits = d.groupBy("_path", "_start").agg(F.min("_scan").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_path", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return d.join(splits, ["_path", "_start"]) \
        .withColumn(out, (F.col("_base") + F.col("_scan") - F.col("_first")).cast("long")) \
        .drop("_path", "_start", "_scan", "_first", "_n", "_base")


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType | str,
             header: bool = True, key: str | None = None, multiline: bool = False,
             sep: str = ",") -> DataFrame:
    """CSV with header (``src_csv``) or without (``src_csv_noheader``: names from the schema)."""
    df = (spark.read.schema(schema).option("header", header).option("multiLine", multiline)
          .option("sep", sep).option("mode", "PERMISSIVE").csv(path))
    if key is None:
        return with_row_id(df)
    return df.withColumnRenamed(key, "row_id") if key != "row_id" else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_aligned(spark: SparkSession, feature_path: str, feature_schema, target_path: str,
                 target_schema) -> DataFrame:
    """Headerless feature and target files that share row order, joined on ``row_id``.
    Different row counts raise."""
    x = read_csv(spark, feature_path, feature_schema, header=False)
    y = read_csv(spark, target_path, target_schema, header=False)
    n, m = x.count(), y.count()
    if n != m:
        raise ValueError(f"{n} feature rows but {m} target rows")
    return x.join(y, "row_id")


def _whole(col: str) -> Column:
    """A whole-number index written as ``12`` or ``12.0``, without passing a double."""
    return F.regexp_replace(F.trim(F.col(col)), r"\.0*$", "").cast("long")


def _folds(df: DataFrame, max_folds: int | None) -> DataFrame:
    """All folds; a limit that would leave folds out raises."""
    if max_folds is not None:
        n = df.select("fold").distinct().count()
        if n > max_folds:
            raise ValueError(f"{n} folds present, at most {max_folds} expected")
    return df


def read_fold_predictions_clf(spark: SparkSession, path: str, max_folds: int | None = None) -> DataFrame:
    """``build_data_from_directory``: union of per-fold files (``fold=K/`` partitions),
    columns ``m_index, known, prediction, prob0, prob1``; when an index appears in
    several folds the first (lowest fold, then file position) is kept; sorted by index.

    The keep-first step is an aggregation (``min_by``) with map-side partial
    aggregation, not a window, so a heavily duplicated index stays cheap.
    """
    df = _folds(spark.read.schema(_with_fold(CLF_PRED_SCHEMA)).option("header", True).csv(path), max_folds) \
        .withColumn("m_index", _whole("m_index"))
    first = df.groupBy("m_index").agg(F.min_by(F.struct("known", "prediction", "prob0", "prob1"),
                                               F.struct("fold", "pos")).alias("_r"))
    return first.select("m_index",
                        F.col("_r.known").cast("int").alias("known"),
                        F.col("_r.prediction").cast("int").alias("prediction"),
                        F.col("_r.prob0").alias("prob0"), F.col("_r.prob1").alias("prob1"))


def read_fold_predictions_reg(spark: SparkSession, path: str, max_folds: int | None = None) -> DataFrame:
    """``build_data_from_directory_regr``: union of folds, ``index, known, prediction``.
    A duplicated index is an error (``verify_integrity``), raised by ``assert_true``
    when the result is evaluated."""
    df = _folds(spark.read.schema(_with_fold(REG_PRED_SCHEMA)).option("header", True).csv(path), max_folds) \
        .withColumn("index", _whole("index"))
    dups = (df.groupBy("index").agg(F.count(F.lit(1)).alias("_n"))
            .select("index", F.assert_true(F.col("_n") == 1,
                                           F.lit("duplicate index in fold predictions")).alias("_ok")))
    # the check joins back by index, so every output row depends on it
    return (df.join(dups.where(F.col("_ok").isNull()), "index")
            .select("index", "known", "prediction", "fold"))


def _with_fold(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField("fold", T.IntegerType())])


def read_prediction_files(spark: SparkSession, paths: dict[str, str], key_type: str = "string") -> DataFrame:
    """Ensemble inputs: ``{model: path}`` of ``pos, actual, predicted`` CSV files →
    ``(model, row_id, actual, predicted)`` with the row id from the file column."""
    schema = f"pos {key_type}, actual DOUBLE, predicted DOUBLE"
    out = None
    for model, p in paths.items():
        d = spark.read.schema(schema).option("header", True).csv(p) \
            .select(F.lit(model).alias("model"), F.col("pos").alias("row_id"), "actual", "predicted")
        out = d if out is None else out.unionByName(d)
    return out


# ------------------------------------------------------------ sinks

def write_table(df: DataFrame, path: str, fmt: str = "parquet", overwrite: bool = False,
                partition_by: Sequence[str] = (), header: bool = True) -> str:
    """Write a snapshot; ``overwrite=False`` refuses an existing target (the guard)."""
    w = df.write.mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w = w.option("header", header)
    w.format(fmt).save(path)
    return path


def write_predictions(df: DataFrame, path: str, overwrite: bool = False, fmt: str = "csv") -> str:
    """One directory per (model, fold) (``sink_predictions``)."""
    parts = [c for c in ("model", "fold") if c in df.columns]
    return write_table(df, path, fmt=fmt, overwrite=overwrite, partition_by=parts)


def write_metrics(df: DataFrame, path: str, fmt: str = "json", overwrite: bool = False) -> str:
    """One record per model (``sink_metrics``)."""
    return write_table(df, path, fmt=fmt, overwrite=overwrite)
