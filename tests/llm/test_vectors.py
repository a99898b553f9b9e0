"""Near pairs and top-k of vectors against brute force."""

import math

import numpy as np
import pytest

from moltab.llm import op2_covertree as near
from moltab.llm import op6_topk as topk

SCHEMA = "vec_id long, embedding array<float>, label int, n_links int, score int"
NAN, INF = float("nan"), float("inf")


def vectors(seed=1, n=300, dim=12):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    base[100:200] = base[:100] + rng.normal(size=(100, dim)) * rng.uniform(0.01, 0.3, size=(100, 1))
    base[200:220] = base[0] + rng.normal(size=(20, dim)) * 0.05      # a crowd
    base[220:230] = base[5] * rng.uniform(0.1, 9, size=(10, 1))      # the same direction
    base[230:240] = base[7]                                          # equal vectors
    return base.astype(np.float32)


def odd_rows(dim=12):
    return [None, [], [0.0] * dim, [NAN] + [1.0] * (dim - 1), [INF] + [1.0] * (dim - 1),
            [None] + [1.0] * (dim - 1), [1.0] * (dim - 1), [1.0, 2.0]]


def frame(spark, seed=1):
    x = vectors(seed)
    rows = [(i * 7, [float(v) for v in r], 0, 0, 0) for i, r in enumerate(x)]
    rows += [(100_001 + 50 * i, v, 0, 0, 0) for i, v in enumerate(odd_rows())]
    rows += [rows[0], (None, rows[3][1], 0, 0, 0)]      # a repeated row, a null id
    return spark.createDataFrame(rows, SCHEMA).repartition(4), rows


def usable(v):
    return v and all(c is not None and math.isfinite(c) for c in v)


def test_near_pairs_equal_brute_force(spark):
    df, rows = frame(spark)
    lost = 10 ** 12      # the row without an id links like any other
    rows = [(lost if i is None else i, v) for i, v, *_ in rows]
    good = [(i, v) for i, v, *_ in rows if usable(v) and any(v)]
    unit = [np.array(v, dtype=np.float64) for _, v in good]
    unit = [u / np.linalg.norm(u) for u in unit]
    links, parent = [0] * len(good), {i: i for i, *_ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(good)):
        for b in range(len(good)):
            if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95:
                links[a] += 1
                x, y = find(good[a][0]), find(good[b][0])
                parent[max(x, y)] = min(x, y)
    want = [(None, n, None) if i == lost else (i, n, find(i)) for (i, _), n in zip(good, links)]
    assert any(i is None and n > 0 for i, n, _ in want)
    rest = [(i, v) for i, v, *_ in rows if not (usable(v) and any(v))]
    want += [(i, 0, i) for i, _ in rest]
    got = [(r.vec_id, r.n_links, r.component_id) for r in near.similar_vectors(df, pack_rows=40).collect()]
    key = lambda t: tuple(-1 if x is None else x for x in t)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_a_vector_without_an_id_joins_others(spark):
    turn = lambda d: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]
    rows = [(1, turn(0)), (2, turn(30)), (None, turn(15)), (7, turn(120)), (None, turn(200))]
    df = spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], SCHEMA)
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in near.similar_vectors(df).collect()}
    assert got == {(1, 1, 1, True), (2, 1, 1, False), (None, 2, None, True), (7, 0, 7, True), (None, 0, None, True)}


def test_near_pairs_of_an_empty_table(spark):
    assert near.similar_vectors(frame(spark)[0].limit(0)).count() == 0


def test_dual_traversal_finds_every_pair():
    x = vectors(3).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    reach = math.sqrt(2 - 2 * 0.95)
    a, b = x[:170], x[170:]
    got = {(int(i), int(j)) for p, q in near.near_pairs(near.cover_tree(a, reach), a, near.cover_tree(b, reach), b,
                                                       0.95, reach) for i, j in zip(p, q)}
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(a @ b.T >= 0.95))))


def test_top_k_equals_brute_force(spark):
    df, rows = frame(spark)
    good = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v, *_ in rows
            if i is not None and usable(v)]
    want = []
    for q, x in set(good):
        if q % 50 == 0:
            found = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in good
                            if i != q and len(y) == len(x)))[:5]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in
           topk.top_k(df, query_block=4, candidate_block=16).collect()]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_top_k_holds_groups_and_lanes_of_bounded_size(spark, monkeypatch):
    df, _ = frame(spark)
    want = sorted(topk.top_k(df, query_block=4, candidate_block=16).collect())
    monkeypatch.setattr(topk, "QUERY_BYTES", 400)
    monkeypatch.setattr(topk, "LANE_BYTES", 3000)
    found = topk.top_k(df, query_block=2, candidate_block=16)
    assert sorted(found.collect()) == want
    # pairs of blocks are no rows of a join, which would be as large as both
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_branch_and_bound_drops_only_what_cannot_enter():
    rng = np.random.default_rng(5)
    q, c = rng.integers(-90, 90, (24, 6)), rng.integers(-90, 90, (24, 500))
    low = np.full(6, np.iinfo(np.int64).min)
    i, j, s = topk.block_scores(q, c, np.zeros((6, 500), bool), low, 5, dim_block=5)
    full = q.T @ c
    for n in range(6):
        best = sorted(zip(-full[n], range(500)))[:5]
        mine = sorted(zip(-s[i == n], j[i == n]))[:5]
        assert best == mine


def test_components_too_large_for_64_bits_raise(spark):
    df = spark.createDataFrame([(0, [1e9, 0.0], 0, 0, 0), (1, [1.0, 1.0], 0, 0, 0)], SCHEMA)
    with pytest.raises(Exception, match="31 bits"):
        topk.top_k(df).collect()


def test_near_pairs_in_rounds_give_their_disk_back(spark, monkeypatch):
    import glob

    from moltab.session import ensure_checkpoint_dir
    df, _ = frame(spark)
    df = df.union(spark.createDataFrame([(200_000 + i, [z, 1.0] + [0.0] * 4, 0, 0, 0) for i, z in enumerate([0.0, -0.0])], SCHEMA))
    told = lambda d: sorted(map(str, d.collect()))
    want = told(near.similar_vectors(df, pack_rows=1000))
    assert any(r.vec_id == 200_001 and r.component_id == 200_000 and r.n_links == 1 for r in near.similar_vectors(df).collect())
    monkeypatch.setattr(near, "ROUND_BYTES", 1)
    at = ensure_checkpoint_dir(spark).removeprefix("file://") + "/moltab-scratch/*"
    tables = lambda: set(glob.glob(at))
    before = tables()
    assert told(near.similar_vectors(df, pack_rows=20)) == want
    left = {t.rsplit("/", 1)[1].rsplit("-", 1)[0] for t in tables() - before}
    assert "cover-links" in left and not left & {"cover-whole", "cover-dealt", "cover-packs", "cover-tiles"}
