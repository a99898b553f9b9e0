import random

from moltab.operators import fingerprints as fp
from moltab.operators import similarity as sim


def test_pattern_checks(spark):
    df = spark.createDataFrame([(0, "CCO"), (1, "CCC"), (2, "CCCC")], "id int, s string")
    assert df.select(fp.has_pattern("s", "CC").alias("f")).first().f == 1
    assert [r.id for r in fp.pattern_match_rows(df, "s", "C").collect()] == [0, 1, 2]


def test_ngram_self_similarity(spark):
    df = spark.createDataFrame([(0, "CCO"), (1, "CCC"), (2, "CCCC")], "id int, s string")
    f = fp.ngram_fp(df, "id", "s", n_max=2, n_bits=1024)
    r = f.select(sim.tanimoto_expr("bits", "bits").alias("t")).collect()
    assert all(x.t == 1.0 for x in r)
    assert f.where("id = 1").first().bits != f.where("id = 0").first().bits


import pytest


@pytest.mark.parametrize("width", [40, 63, 64, 100, 300, 5000])  # one mask word, several, arrays
def test_threshold_join_equals_brute_force(spark, width):
    rnd = random.Random(3)
    rows = [(i, sorted(rnd.sample(range(width), rnd.randint(1, 12)))) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, bits array<int>")
    got = {(r.i, r.j) for r in sim.similarity_pairs(df, "id", "bits", min_sim=0.4).collect()}
    exp = set()
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            A, B = set(rows[a][1]), set(rows[b][1])
            if len(A & B) / len(A | B) >= 0.4:
                exp.add((rows[a][0], rows[b][0]))
    assert got == exp


def test_bits_to_text(spark):
    df = spark.createDataFrame([([0, 3],)], "bits array<int>")
    assert df.select(fp.bits_to_text("bits", 5).alias("t")).first().t == "10010"


def test_smiles_tokens(spark):
    df = spark.createDataFrame([("CC(=O)Cl[N+]%12c1",)], "s string")
    toks = fp.tokenize(df, "s").first().tokens
    assert toks == ["C", "C", "(", "=", "O", ")", "Cl", "[N+]", "%12", "c", "1"]


def test_similarity_search_one_reference(spark):
    df = spark.createDataFrame([(0, [1, 2, 3]), (1, [1, 2]), (2, [7])], "id int, bits array<int>")
    got = {r.fp_target: r.similarity for r in sim.similarity_search(df.where("id = 0"), df, "id").collect()}
    assert got == {0: 1.0, 1: 2 / 3}
    with pytest.raises(ValueError):
        sim.similarity_search(df, df, "id")


def test_count_maps_agree_with_long_counts(spark):
    from moltab.operators import fingerprints as fp
    texts = [(1, "a b a b a b c"), (2, "a"), (3, ""), (4, None), (5, "b a"), (6, "x " * 300)]
    df = spark.createDataFrame(texts, "id long, t string")
    word = "[a-z]+"
    maps = {r.id: r.counts for r in fp.ngram_count_map(df, "id", "t", 2, 32, word).collect()}
    long = {}
    for r in fp.ngram_counts(df, "id", "t", 2, 32, word).collect():
        long.setdefault(r.id, {})[r.bit] = r["count"]
    assert {k: v for k, v in maps.items() if v} == long
    assert maps[3] == {} and not maps[4]
    for counts, bits in ((fp.pair_counts(df, "id", "t", 2, 64, word), fp.pair_fp(df, "id", "t", 2, 64, word)),
                         (fp.path_counts(df, "id", "t", 3, 64, word), fp.path_fp(df, "id", "t", 3, 64, word))):
        on = {r.id: list(r.bits or []) for r in bits.collect()}
        got = {r.id: r.counts or {} for r in counts.collect()}
        assert {k: sorted(v) for k, v in got.items()} == on
    pairs = {r.id: sum((r.counts or {}).values()) for r in fp.pair_counts(df, "id", "t", 2, 64, word).collect()}
    assert pairs == {1: 6 + 5, 2: 0, 3: 0, 4: 0, 5: 1, 6: 299 + 298}


def test_hashed_features_equal_md5_by_hand(spark):
    import hashlib
    from collections import Counter
    texts = ["a b a b a", "x", "", None, "b a", "Q1 z z z Q1 " * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    word = "[A-Za-z0-9]+"
    bucket = lambda g: int(hashlib.md5(g.encode()).hexdigest()[:8], 16) % 50
    cut = lambda t: (t or "").split()
    runs = lambda t, n: [t[i:i + n] for i in range(len(t) - n + 1)]
    made = {
        "ngram": lambda t: [" ".join(r) for n in (1, 2, 3) for r in runs(t, n)],
        "pair": lambda t: [f"{min(r[0], r[-1])}|{max(r[0], r[-1])}|{d}" for d in (1, 2) for r in runs(t, d + 1)],
        "path": lambda t: [min(" ".join(r), " ".join(r[::-1])) for r in runs(t, 3)],
    }
    size = {"ngram": 3, "pair": 2, "path": 3}
    counted = {"ngram": fp.ngram_count_map, "pair": fp.pair_counts, "path": fp.path_counts}
    for kind, feats in made.items():
        on = getattr(fp, f"{kind}_fp")(df, "id", "t", size[kind], 50, word)
        assert "lambda" not in on._jdf.queryExecution().toString()      # no interpreted lambda per feature
        assert {r.id: r.bits for r in on.collect()} == \
            {i: sorted({bucket(g) for g in feats(cut(t))}) for i, t in enumerate(texts)}
        assert {r.id: r.counts for r in counted[kind](df, "id", "t", size[kind], 50, word).collect()} == \
            {i: dict(Counter(map(bucket, feats(cut(t))))) for i, t in enumerate(texts)}
    assert {(r.id, r.bit): r["count"] for r in fp.ngram_counts(df, "id", "t", 3, 50, word).collect()} == \
        {(i, b): n for i, t in enumerate(texts) for b, n in Counter(map(bucket, made["ngram"](cut(t)))).items()}
