"""Model queries do the reference's whole search: candidates, folds, repeats."""

import numpy as np
import pytest

from moltab.operators import models
from moltab.operators.splits import kfold
from moltab.plans import q_models, training
from moltab.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """``documents`` and ``labels`` of 60 rows, ``orders`` and ``lineitem`` of 80 orders."""
    rng = np.random.default_rng(5)
    at = str(tmp_path_factory.mktemp("tables"))
    docs, labels = [], []
    for i in range(60):
        text = " ".join(rng.choice(["Ab", "c1", "d", "E\n", "42"], int(rng.integers(3, 40))))
        docs.append((i, text, "en" if i % 3 else "fr", len(text)))
        labels.append((i, int(len(text) + rng.integers(0, 30) > 60)))
    orders, lines = [], []
    for o in range(80):
        prices = rng.uniform(1e3, 9e4, int(rng.integers(1, 7))).tolist()
        orders.append((o, sum(prices) * float(rng.uniform(0.9, 1.1))))
        lines += [(o, float(rng.integers(1, 50)), p, float(rng.uniform(0, 0.1)), float(rng.uniform(0, 0.08))) for p in prices]
    for name, rows, kind in (
            ("documents", docs, "doc_id long, text string, lang string, n_chars long"), ("labels", labels, "doc_id long, quality int"),
            ("orders", orders, "o_orderkey long, o_totalprice double"),
            ("lineitem", lines, "l_orderkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double")):
        spark.createDataFrame(rows, kind).write.parquet(f"{at}/{name}.parquet")
    return at


def test_importance_is_that_of_five_repeats(spark, tables):
    got = {r.feature: r for r in q_models.q_perm_importance(spark, tables).collect()}
    d = q_models.clf_data(spark, tables)
    m = models.make("logreg", C=1.0).fit(training.assemble(d, "doc_id", q_models.CLF_FEATS, "quality"))
    want = {n: {r.feature: r for r in training.permutation_importance(m, d, "doc_id", q_models.CLF_FEATS, "quality", n, 0).collect()}
            for n in (3, 5)}
    assert got.keys() == set(q_models.CLF_FEATS)
    for f, r in got.items():
        assert (r.importance, r.importance_std) == (pytest.approx(want[5][f].importance), pytest.approx(want[5][f].importance_std))
    assert any(abs(got[f].importance_std - r.importance_std) > 1e-9 for f, r in want[3].items())


def brute(train, test, k, regression):
    """Predictions of kNN, ties in distance to the smaller key."""
    out = {}
    for key, (x, _) in test.items():
        near = sorted((float(np.sqrt(((x - z) ** 2).sum())), i, y) for i, (z, y) in train.items())[:k]
        ys = [y for *_, y in near]
        out[key] = np.mean(ys) if regression else min(set(ys), key=lambda c: (-ys.count(c), c))
        if not regression:
            out[key] = out[key], ys.count(1.0) / len(ys)
    return out


@pytest.mark.parametrize("query,key", [("m_knn_clf", "doc_id"), ("m_knn_reg", "o_orderkey")])
def test_knn_models_search_all_candidates_in_five_folds(spark, tables, monkeypatch, query, key):
    grids = []
    real = training.grid_search
    monkeypatch.setattr(training, "grid_search", lambda *a, **b: grids.append(real(*a, **b)) or grids[-1])
    regression = query == "m_knn_reg"
    got = {r[key]: r for r in QUERIES[query](spark, tables).collect()}
    g = grids[0].collect()
    assert {(r.cand_id, r.params) for r in g} == {(i, '{"n_neighbors": %d}' % k) for i, k in enumerate(range(2, 10))}
    assert {(r.cand_id, r.split, r.set, r.metric) for r in g} == {
        (c, f, s, m) for c in range(8) for f in range(5) for s in ("train", "test")
        for m in (training.REG_SCORING if regression else training.CLF_SCORING)}
    # the same by hand
    tr, te = q_models._reg_split(spark, tables) if regression else q_models._clf_split(spark, tables)
    rows = [{r[key]: (r.features.toArray(), r.label) for r in d.collect()} for d in (tr, te)]
    fold = {r[key]: r.fold for r in kfold(tr, key, 5, seed=42, salt="inner").collect()}
    told = {(r.cand_id, r.split, r.set, r.metric): r.score for r in g}
    mean = []
    for c, k in enumerate(range(2, 10)):
        each = []
        for f in range(5):
            test = {i: r for i, r in rows[0].items() if fold[i] == f}
            train = {i: r for i, r in rows[0].items() if fold[i] != f}
            pred = brute(train, test, k, regression)
            y = np.array([test[i][1] for i in pred])
            if regression:
                p = np.array(list(pred.values()))
                each.append(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
                assert told[c, f, "test", "r2"] == pytest.approx(each[-1])
            else:
                s = np.array([x for _, x in pred.values()])
                d = s[y == 1][:, None] - s[y == 0][None, :]
                each.append(((d > 0) + 0.5 * (d == 0)).mean())
                assert told[c, f, "test", "roc_auc"] == pytest.approx(each[-1])
        mean.append(np.mean(each))
    best = 2 + int(np.argmax(np.round(mean, 12)))
    want = brute(rows[0], rows[1], best, regression)
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i].prediction == (pytest.approx(w) if regression else w[0])
        assert got[i].known == rows[1][i][1]
