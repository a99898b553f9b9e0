from pyspark.sql import functions as F

from moltab.operators import fingerprints as fp
from moltab.session import scratch_path
from moltab.sources import io
from moltab.streaming.incremental import run_incremental


def test_stream_matches_batch(spark):
    src = scratch_path(spark, "stream-src")
    df = spark.createDataFrame([(i, "CCO" if i % 2 else "c1ccccc1N") for i in range(20)], "id long, s string")
    io.write_table(df, src)
    sink = scratch_path(spark, "stream-sink")
    run_incremental(spark, src, df.schema, lambda d: fp.pattern_fp(d, "id", "s"), sink)
    got = sorted((r.id, tuple(r.bits)) for r in spark.read.parquet(sink).collect())
    exp = sorted((r.id, tuple(r.bits)) for r in fp.pattern_fp(df, "id", "s").collect())
    assert got == exp


def test_fold_readers(spark):
    out = scratch_path(spark, "folds")
    rows = [(f, 0, float(i), 1.0, float(i % 2), 0.3, 0.7) for f in range(3) for i in range(f, 10, 3)]
    rows.append((2, 5, 0.0, 0.0, 0.0, 0.9, 0.1))  # duplicate index 0 in a later fold
    df = spark.createDataFrame(rows, "fold int, pos long, m_index double, known double, prediction double, "
                                     "prob0 double, prob1 double")
    io.write_predictions(df, out)
    got = io.read_fold_predictions_clf(spark, out)
    assert got.count() == 10
    assert got.where("m_index = 0").first().known == 1


def test_reg_reader_rejects_duplicates(spark):
    import pytest
    out = scratch_path(spark, "rfolds")
    df = spark.createDataFrame([(0, 0, 1.0, 1.0, 1.0), (1, 0, 1.0, 2.0, 2.0)],
                               "fold int, pos long, index double, known double, prediction double")
    io.write_predictions(df, out)
    with pytest.raises(Exception):
        io.read_fold_predictions_reg(spark, out).collect()


def test_write_guard(spark):
    import pytest
    out = scratch_path(spark, "guard")
    d = spark.range(3)
    io.write_table(d, out)
    with pytest.raises(Exception):
        io.write_table(d, out)
    assert io.read_parquet(spark, out).agg(F.count("*")).first()[0] == 3


def test_twelve_folds_are_read_and_a_limit_raises(spark):
    import pytest
    out = scratch_path(spark, "folds12")
    rows = [(f, 0, 2 ** 54 + f, 1.0, 1.0, 0.3, 0.7) for f in range(12)]
    io.write_predictions(spark.createDataFrame(
        rows, "fold int, pos long, m_index long, known double, prediction double, prob0 double, prob1 double"), out)
    got = [r.m_index for r in io.read_fold_predictions_clf(spark, out).collect()]
    assert got == [2 ** 54 + f for f in range(12)]     # exact and sorted
    with pytest.raises(ValueError):
        io.read_fold_predictions_clf(spark, out, max_folds=10)


def test_aligned_files_pair_in_file_order(spark):
    import pytest
    x, y, short = (scratch_path(spark, n) for n in "xyz")
    rows = spark.range(1000).withColumn("t", F.col("id") * 2)
    # a small first file and a large last one: a scan reads the large one first
    key = F.when(F.col("id") < 10, 0).when(F.col("id") < 60, 1).otherwise(2)
    rows.repartitionByRange(3, key).sortWithinPartitions("id").select("id") \
        .write.option("header", False).csv(x)
    rows.repartitionByRange(2, "id").sortWithinPartitions("id").select("t") \
        .write.option("header", False).csv(y)
    got = io.read_aligned(spark, x, "id LONG", y, "t LONG").collect()
    assert len(got) == 1000 and all(r.t == 2 * r.id == 2 * r.row_id for r in got)
    rows.limit(5).select("t").write.option("header", False).csv(short)
    with pytest.raises(ValueError):
        io.read_aligned(spark, x, "id LONG", short, "t LONG")


def test_class_report_uses_each_class_own_probability(spark):
    from moltab.operators.curves import curve_summary
    from moltab.operators.reports import all_class_report
    df = spark.createDataFrame([("m", int(i % 5 == 0), int(i % 3 == 0), (i * 37 % 100) / 100) for i in range(200)],
                               "model string, known int, prediction int, prob1 double")
    rep = {r["class"]: r for r in all_class_report(df).collect()}
    own = df.withColumn("neg", 1 - F.col("known")).withColumn("p0", 1 - F.col("prob1"))
    for cls, known, p in ((1, "known", "prob1"), (0, "neg", "p0")):
        want = curve_summary(own, known, p, by=["model"], positive=1).first()
        assert abs(rep[cls].pr_auc - want.pr_auc) <= 0.0051
