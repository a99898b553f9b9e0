"""Mixing, sharding, components and the pipeline."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from moltab.llm import op4_mixing as mix
from moltab.llm import op7_sharding as shard
from moltab.llm.common import components

SCHEMA = "doc_id long, text string, shard int, rate double, n long"


def frame(spark, docs):
    return spark.createDataFrame([(d, t, 1, 1.0, 1) for d, t in docs], SCHEMA).repartition(3)


# ---------------------------------------------------------------- sharding

def jump(key, n):
    key, b, j = key & (1 << 64) - 1, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 40, 1000])
def test_shards_follow_the_published_hash(spark, n):
    docs = [(i * 7919 - 300_000, f"t{i % 9}") for i in range(200)] + [(None, None), (5, ""), (5, ""), (5, "é")]
    rows = shard.shard_documents(frame(spark, docs), n_shards=n, rows_per_slice=1).collect()
    assert len(rows) == len(docs)
    slots: dict = {}
    for r in rows:
        k = r.doc_id or 0
        assert (r.shard, r.grown_shard) == (jump(k, n), jump(k, n + 1)) and r.grown_shard in (r.shard, n)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in docs)
    assert sorted((r["size"], r.text_crc32) for r in rows) == want
    assert shard.shard_documents(frame(spark, docs).limit(0), n_shards=n).count() == 0


def test_written_shards_hold_every_document(spark):
    from moltab.session import scratch_path
    docs = frame(spark, [(i, f"t{i}") for i in range(50)]).select("doc_id", "text")
    path = scratch_path(spark, "shards")
    shard.write_shards(docs, shard.shard_documents(docs, n_shards=4), path)
    back = spark.read.parquet(path)
    assert back.count() == 50 and back.where(F.col("doc_id") == 3).first()["shard"] == jump(3, 4)


def test_written_shards_hold_null_keys_and_a_shard_column(spark):
    from moltab.session import scratch_path
    docs = frame(spark, [(i, f"t{i}") for i in range(20)] + [(None, "a"), (None, "b"), (0, "c")])
    path = scratch_path(spark, "shards")
    name = shard.write_shards(docs, shard.shard_documents(docs, n_shards=4), path)
    back = spark.read.parquet(path).collect()
    assert sorted(r.text for r in back) == sorted(r.text for r in docs.collect())
    assert all(r["shard"] == 1 and r[name] == jump(r.doc_id or 0, 4) for r in back)


# ---------------------------------------------------------------- mixing

def corpus(n=600, seed=1):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        kind = rnd.choices(["good", "plain", "toxic"], [6, 3, 1])[0]
        words = [rnd.choice("abcdefgh") + rnd.choice("aeiou") + rnd.choice("klmnop") for _ in range(rnd.randint(5, 60))]
        words += {"good": ["fine"] * 2, "plain": ["dull#"], "toxic": ["vile!"]}[kind]
        rnd.shuffle(words)
        docs.append((i, " ".join(words)))
        if i % 2:
            labels.append((i, int(kind != "plain"), int(kind == "toxic")))
    return docs, labels


def test_rates_meet_the_targets(spark):
    docs, labels = corpus()
    df = frame(spark, docs + [(9000, None), (9001, ""), (9002, "fine " * 20_000), (3, docs[3][1])])
    lab = spark.createDataFrame(labels + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    c, fit = mix.fit_mixture(df, lab)
    assert fit.worst <= 1e-3
    rated, m, r = mix.with_rates(df, c, fit)
    rows = rated.select("doc_id", F.col(m).alias("m"), F.col(r).alias("r")).collect()
    assert len(rows) == len(docs) + 4 and all(x.r >= 0 for x in rows)
    for d in mix.DOMAINS:     # the replayed rates give the fitted totals
        assert sum(x.m.n * x.r * x.m[d] for x in rows) == pytest.approx(fit.targets[d], rel=2e-3)
    assert all(abs(x.m.good + x.m.plain + x.m.toxic - 1) < 1e-9 for x in rows)
    truth = {i: t for i, _, t in labels}
    right = [(x.m.toxic > 0.5) == bool(truth[x.doc_id]) for x in rows if x.doc_id in truth]
    assert sum(right) > 0.97 * len(right)
    assert {x.m.n for x in rows if x.doc_id in (9000, 9001)} == {0}


def test_projection_equals_a_plain_solver(spark):
    rnd = random.Random(2)
    rows = []
    for _ in range(200):
        a, b = rnd.random(), rnd.random()
        rows.append((rnd.randint(1, 50), a * b, a * (1 - b), 1 - a))
    members = spark.createDataFrame(rows, "n long, good double, plain double, toxic double")
    total = sum(r[0] for r in rows)
    fit = mix.fit_rates(members, {"good": 0.7 * total, "plain": 0.25 * total, "toxic": 0.05 * total})
    r = [1.0] * len(rows)
    for s in fit.steps:
        r = [max(0.0, x - sum(s[k] * row[k + 1] for k in range(3))) for x, row in zip(r, rows)]
    for k, d in enumerate(mix.DOMAINS):
        assert sum(x * row[0] * row[k + 1] for x, row in zip(r, rows)) == pytest.approx(fit.totals[d])
        assert fit.totals[d] == pytest.approx(fit.targets[d], rel=2e-3)


def test_mixing_without_labels_or_rows(spark):
    docs, labels = corpus(60)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="targets cannot be met"):
        c, fit = mix.fit_mixture(frame(spark, docs), lab.limit(0))
    assert mix.mix(frame(spark, docs), c, fit).columns == ["doc_id", "text", "shard", "rate", "n"]
    empty = frame(spark, docs).limit(0)
    c, fit = mix.fit_mixture(empty, lab)
    assert mix.mix(empty, c, fit).count() == 0


def test_copies_follow_the_rates(spark):
    docs, labels = corpus()
    df, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    c, fit = mix.fit_mixture(df, lab, multiples={"good": 2.5, "plain": 1.0, "toxic": 0.2})
    rated, _, r = mix.with_rates(df, c, fit)
    rate = {x.doc_id: x.r for x in rated.select("doc_id", F.col(r).alias("r")).collect()}
    n = {x.doc_id: x["count"] for x in mix.mix(df, c, fit).groupBy("doc_id").count().collect()}
    for d, x in rate.items():
        assert int(x) <= n.get(d, 0) <= int(x) + 1 and (x < 0.5 or n[d] >= 1)


def test_drawn_totals_meet_the_targets(spark):
    docs, labels = corpus(4000)
    df, lab = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    c, fit = mix.fit_mixture(df, lab, multiples={"good": 1.05, "plain": 1.0, "toxic": 0.5}, keep=0.5)
    assert fit.worst <= 1e-3
    rated, m, _ = mix.with_rates(df, c, fit)
    of = {x.doc_id: x.m for x in rated.select("doc_id", F.col(m).alias("m")).collect()}
    n = {x.doc_id: x["count"] for x in mix.mix(df, c, fit).groupBy("doc_id").count().collect()}
    for d, most in (("good", 0.03), ("plain", 0.03), ("toxic", 0.15)):
        assert sum(k * of[i].n * of[i][d] for i, k in n.items()) == pytest.approx(fit.targets[d], rel=most)
    assert all(i in n for i, x in of.items() if x.toxic < 0.5)


# ---------------------------------------------------------------- components

def test_components_equal_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)]
    edges += [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(80)] + [(7, 7), (None, 3)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- pipeline

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p
    rnd = random.Random(4)
    en, de = ["the", "of", "and", "tion", "with", "house"], ["der", "und", "nicht", "schön", "haus", "wir"]
    docs = []
    for i in range(120):
        words = [rnd.choice(de if i % 3 == 0 else en) + rnd.choice("abcdefgh") for _ in range(rnd.randint(30, 60))]
        docs.append((i, " ".join(words), "de" if i % 3 == 0 else "en", "s", 0))
    docs += [(500, docs[4][1], "en", "s", 0), (501, docs[5][1] + " more", "en", "s", 0)]
    docs += [(502, None, None, "s", 0), (503, "12 34 !!", "en", "s", 0)]
    docs += [(504, docs[6][1][:50] + " password=abcdef123456 " + "zu fo bo " * 9 + "wa we wi " * 9, "en", "s", 0)]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{d}/labels.parquet")
    out = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = out.columns, []
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, out, d)
        assert out.columns == columns, name
        kept.append({r.doc_id: r.text for r in out.collect()})
    assert set(kept[0]) == {i for i, *_ in docs} - {502, 503}         # language
    assert set(kept[1]) == set(kept[0]) - {500, 501}                  # near-duplicates
    assert "[SECRET]" in kept[2][504] and "abcdef123456" not in kept[2][504]
    assert {i: t for i, t in kept[2].items() if i != 504} == {i: t for i, t in kept[1].items() if i != 504}
    assert set(kept[3]) <= set(kept[2])
    packed = p.packing(spark, out, d)
    assert {r.doc_id for r in packed.collect()} == set(kept[3])
    assert p.run(spark, d).count() == packed.count()
