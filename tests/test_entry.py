import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "roc_auc" in df.columns


def test_oracles_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
