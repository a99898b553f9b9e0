import numpy as np
import pytest

from moltab.operators import fingerprints as fp
from moltab.operators import similarity as sim


def brute_pairs(x, y, t, dice):
    out = []
    for i, a in x:
        for j, b in (x if y is None else y):
            both = len({*a} & {*b})
            sim = 2 * both / (len(a) + len(b)) if dice else both / (len(a) + len(b) - both)
            if sim >= t and (y is not None or i < j):
                out.append((i, j, round(sim, 9)))
    return sorted(out)


@pytest.mark.parametrize("metric", ["tanimoto", "dice"])
@pytest.mark.parametrize("pays", [True, False])
@pytest.mark.parametrize("copies", [1, 4])
def test_pairs_by_product_by_prefix_and_by_classes(spark, monkeypatch, metric, pays, copies):
    monkeypatch.setattr(sim, "_pays", lambda *a: pays)
    monkeypatch.setattr(sim, "PRODUCT_ROWS", 16)
    rng = np.random.default_rng(copies)
    sets = [sorted(rng.choice(70, size=rng.integers(1, 9), replace=False).tolist()) for _ in range(60)]
    rows = [(i, sets[i % (60 // copies)]) for i in range(60)]
    a, b = rows[:35], rows[35:]
    frame = lambda r: spark.createDataFrame([*r, (99, [])], "id long, bits array<int>")
    for x, y in ((rows, None), (a, b)):
        got = sim.similarity_pairs(frame(x), "id", "bits", y and frame(y), 0.4, metric).collect()
        assert sorted((r.i, r.j, round(r.sim, 9)) for r in got) == brute_pairs(x, y, 0.4, metric == "dice")


def test_copies_of_a_set_are_joined_once(spark):
    rows = spark.range(3000).selectExpr("id", "array(int(id % 3), 10, 11, 12) AS bits")
    _, sets, one_each = sim._classes(rows, "id", "bits")
    assert sets.count() == 3 and not one_each


def test_bit_text_runs_its_bits_once(spark):
    df = spark.createDataFrame([(1, [0, 3]), (2, []), (3, None), (4, [3, 3, None, 9, -1])], "id int, bits array<int>")
    got = df.select("id", fp.bits_to_text("bits", 5).alias("t")).orderBy("id").collect()
    assert [r.t for r in got] == ["10010", "00000", "00000", "00010"]
    plan = fp.ngram_fp(df.selectExpr("id", "'a b' AS s"), "id", "s", 1, 8, "[a-z]").select(fp.bits_to_text("bits", 8).alias("t"))
    assert "sequence(0, 7" not in plan._jdf.queryExecution().optimizedPlan().toString()
