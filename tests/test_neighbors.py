import numpy as np
import pytest

from moltab.operators import neighbors


def brute(q, p, k, exclude_self):
    out = []
    for g, i, x in q:
        near = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(x, y)))), j) for h, j, y in p
                      if h == g and not (exclude_self and i == j))
        out += [(g, i, r + 1, j) for r, (_, j) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("exclude_self", [False, True])
@pytest.mark.parametrize("rows", [3, 50, 1024])
def test_knn_equals_brute_force(spark, monkeypatch, exclude_self, rows):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", rows)
    monkeypatch.setattr(neighbors, "PIVOTS", 12)
    rng = np.random.default_rng(rows)
    pts = [("ab"[i % 2], f"k{i:03d}", [float(v) for v in rng.integers(0, 6, 3)]) for i in range(120)]
    pts += [("a", f"d{i:03d}", [1.0, 1.0, 1.0]) for i in range(60)] + [("c", "only", [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(pts, "g string, id string, v array<double>")
    got = neighbors.knn(df, df, "id", "v", 5, by=["g"], exclude_self=exclude_self)
    assert sorted((r.g, r.q, r["rank"], r.p) for r in got.collect()) == brute(pts, pts, 5, exclude_self)


def test_knn_without_points(spark):
    df = spark.createDataFrame([("x", [1.0])], "id string, v array<double>")
    assert neighbors.knn(df, df.limit(0), "id", "v", 3).count() == 0


def test_leaves_do_not_grow_with_the_points():
    rng = np.random.default_rng(1)
    for n, depth in ((2_000, 5), (16_000, 8)):
        x = rng.normal(size=(n, 3)) * [1.0, 5.0, 0.1]
        tree = neighbors.Tree(x[::4], depth)
        assert np.bincount(tree.leaf(x) - ((1 << depth) - 1), minlength=1 << depth).max() <= 3 * n >> depth


def test_product_screens_exactly():
    rng = np.random.default_rng(2)
    q, p = (1e4 + rng.integers(0, 3, (n, 4)) * 1e-3 for n in (40, 300))
    i, j, dist = neighbors.nearest(q, p, 6)
    for a in range(len(q)):
        d = np.zeros(len(p))
        for c in range(4):
            d += (q[a, c] - p[:, c]) ** 2
        order = np.lexsort((np.arange(len(p)), np.sqrt(d)))[:6]
        assert j[i == a].tolist() == order.tolist()


def test_repeated_keys_and_vectors_without_distance(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 4)
    pts = [("x", [0.0, 0.0])] * 5 + [(f"y{i}", [0.0, 0.0]) for i in range(9)] + [("z", [float(i), 1.0]) for i in range(20)]
    lost = [("n", None), ("m", [float("nan"), 0.0]), ("i", [float("inf"), 0.0])]
    df = spark.createDataFrame(pts + lost, "id string, v array<double>")
    got = {(r.q, r["rank"]): r.p for r in neighbors.knn(df, df, "id", "v", 3, exclude_self=True).collect()}
    # the rows of a repeated key are ranked together, as by the SQL
    assert [got["x", r] for r in (1, 2, 3)] == ["y0", "y0", "y0"]
    assert [got["y0", r] for r in (1, 2, 3)] == ["x", "x", "x"]
    assert {q for q, _ in got} == {p[0] for p in pts}


def test_lists_hold_whatever_part_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 4)
    monkeypatch.setattr(neighbors, "SLICE_ROWS", 40)
    rng = np.random.default_rng(3)
    # part 0 lies close together: its points are most of the nearest ones
    pts = [(0, i, [float(v) * (0.1 if i % 3 == 0 else 1.0) for v in rng.integers(0, 5, 2)], float(rng.integers(0, 50)), i % 3)
           for i in range(150)]
    df = spark.createDataFrame(pts, "g int, id long, v array<double>, y double, part int")
    lists = neighbors.neighbour_lists(df.select("g", "id", "v"), df, 4).collect()
    assert sorted(r.id for r in lists) == list(range(150))
    at = {p[1]: p for p in pts}
    for r in lists:
        for f in range(3):
            near = sorted((np.sqrt(sum((a - b) ** 2 for a, b in zip(at[r.id][2], p[2]))), p[1], p[3]) for p in pts if p[4] != f)
            assert [e.y for e in r.near if e.part != f][:4] == [y for *_, y in near[:4]]


def test_votes_and_means_of_several_k(spark):
    lists = spark.createDataFrame([(1, [(2.0,), (1.0,), (1.0,), (None,)]), (2, [(None,), (0.0,)]), (3, [])],
                                  "id int, near array<struct<y:double>>")
    told = lambda regression: {(r.id, r.cand_id): r for r in
                               neighbors.predictions(lists, [1, 2, 4], regression, ["id"]).collect()}
    clf, reg = told(False), told(True)
    assert {k: (r.prediction, r.prob1) for k, r in clf.items()} == {
        (1, 0): (2.0, 0.0), (1, 1): (1.0, 0.5), (1, 2): (1.0, 0.5),
        (2, 0): (None, 0.0), (2, 1): (None, 0.0), (2, 2): (None, 0.0)}
    assert {k: r.prediction for k, r in reg.items()} == {(1, 0): 2.0, (1, 1): 1.5, (1, 2): 4 / 3, (2, 0): None, (2, 1): 0.0, (2, 2): 0.0}


def test_search_gives_its_disk_back(spark):
    import glob

    from moltab.session import _CLEAN_KEY, ensure_checkpoint_dir
    df = spark.createDataFrame([(i, [float(i % 7), float(i)]) for i in range(200)], "id long, v array<double>")
    tables = lambda: set(glob.glob(ensure_checkpoint_dir(spark).removeprefix("file://") + "/moltab-scratch/*"))
    before, setting = tables(), spark.conf.get(_CLEAN_KEY, None)
    assert neighbors.knn(df, df, "id", "v", 3).count() == 600
    assert spark.conf.get(_CLEAN_KEY, None) == setting
    assert {t.rsplit("/", 1)[1].rsplit("-", 1)[0] for t in tables() - before} == {"knn-lists"}
