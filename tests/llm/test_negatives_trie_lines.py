"""Hard negatives, conversation trie and line rules against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from moltab.llm import op11_hard_negatives as neg
from moltab.llm import op12_conversation_trie as trie
from moltab.llm import op13_line_rules as lines
from moltab.llm.common import join_hot

NAN, INF = float("nan"), float("inf")


# ------------------------------------------------------------------ hard negatives

def brute_negatives(rows, every, k_pos, k_neg, lo, hi):
    """(anchor, positive, rank, negative, scores) over rows (id, label, vector)."""
    ok = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in rows
          if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for i, y, q in {(i, y, tuple(q)) for i, y, q in ok if i % every == 0}:
        at = [(-sum(a * b for a, b in zip(q, c)), j, z) for j, z, c in ok if len(c) == len(q)]
        for p, j, _ in sorted(x for x in at if x[2] == y and x[1] != i)[:k_pos]:
            p = -p
            found = sorted((s, n) for s, n, z in at if z != y and lo * p <= -100 * s <= hi * p)[:k_neg]
            for r, (s, n) in enumerate(found, 1):
                out[i, j, r, n, p, -s] += 1
    return out


def negatives_frame(spark, seed=3, n=260, dim=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dim))
    rows = []
    for i in range(n):
        v = centres[i % 5] * rng.uniform(0, 1.5) + rng.normal(size=dim) * rng.choice([0.02, 0.4, 1.0])
        if i % 9 == 0:
            v[dim // 2:] = 0         # little mass in the last dimensions
        rows.append((i, int(rng.integers(0, 4)), [float(x) for x in v.astype(np.float32)]))
    one = rows[7][2]
    rows += [(900 + j, j % 3, one) for j in range(6)]                       # equal scores
    rows += [(rows[10][0], rows[10][1], rows[10][2]), (20, 3, rows[21][2])]  # a repeated row, a second version
    rows += [(1000, 1, [0.0] * dim), (1010, 1, [-x for x in one]), (1020, None, one), (None, 1, one), (1030, 1, None),
             (1040, 1, []), (1050, 1, [NAN] + one[1:]), (1060, 1, [INF] + one[1:]), (1070, 1, [None] + one[1:]),
             (1080, 1, [1.0, 2.0]), (1081, 1, [2.0, 2.0]), (1082, 2, [1.0, 1.0])]
    schema = "vec_id long, label int, embedding array<float>, score string, a int, w int, win int"
    return spark.createDataFrame([(*r, "x", 1, 1, 1) for r in rows], schema).repartition(5), rows


@pytest.mark.parametrize("k_pos, k_neg, lo, hi", [(5, 3, 50, 95), (2, 7, -20, 60), (1, 1, 0, 100)])
def test_negatives_equal_brute_force(spark, k_pos, k_neg, lo, hi, monkeypatch):
    monkeypatch.setattr(neg, "ANCHOR_BLOCK", 7)
    monkeypatch.setattr(neg, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(neg, "GROUP", 9)
    df, rows = negatives_frame(spark)
    got = neg.hard_negatives(df, every=10, k_pos=k_pos, k_neg=k_neg, lo_pct=lo, hi_pct=hi)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, got.collect())) == brute_negatives(rows, 10, k_pos, k_neg, lo, hi)


def test_negatives_of_an_empty_table(spark):
    df, _ = negatives_frame(spark)
    assert neg.hard_negatives(df.limit(0)).count() == 0


def test_large_components_stay_exact_or_raise(spark):
    big = [(0, 1, [2.0 ** 17 + 1, 1.0]), (1, 1, [2.0 ** 17 + 3, 2.0]), (2, 2, [2.0 ** 16 + 5, 3.0]), (3, 2, [2.0 ** 16 + 5, 2.0])]
    df = spark.createDataFrame(big, "vec_id long, label int, embedding array<double>")
    assert Counter(map(tuple, neg.hard_negatives(df).collect())) == brute_negatives(big, 50, 5, 3, 50, 95)
    huge = spark.createDataFrame([(0, 1, [2.0 ** 30]), (1, 1, [2.0 ** 30])], df.schema)
    with pytest.raises(Exception, match="62 bits"):
        neg.hard_negatives(huge).collect()


@pytest.mark.parametrize("share", [-0.5, 0.0, 0.2, 0.6, 0.95])
def test_threshold_pairs_are_whole(share):
    rng = np.random.default_rng(5)
    q, c = (rng.integers(-256, 257, size=(n, 50)) for n in (40, 300))
    c[:, 30:] //= 20
    c[5] = 0
    q[3] = 0
    c[7] = q[8]
    t = np.linspace(0.9, 1.1, 40) * share * (q * q).sum(axis=1)
    t = np.floor(t).astype(np.int64)
    full = q @ c.T
    i, j, s = neg.threshold_pairs(q.astype(float), c.astype(float), t)
    assert sorted(zip(i, j, s)) == sorted((a, b, full[a, b]) for a, b in zip(*np.nonzero(full >= t[:, None])))


# ------------------------------------------------------------------ conversation trie

def brute_trie(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            dg = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs[c].append((t is not None, t or 0, dg, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - math.fmod(c, 5)
        seqs[c] = own.get(int(base), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1].encode()) if k else 0)
    return {(min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
             hashlib.sha256(",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(k)))).encode()).hexdigest())
            for k, m in members.items()}


def talk(seed, convs, most=12):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.randint(1, most)):
            rows.append((c, t, rng.choice(["user", "user", "", None]), rng.choice(["a", "ü", "bb", None, "ab"])))
    return rows


def trie_rows(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows],
                               "conv_id long, turn long, role string, text string, depth string, n int")
    return df.repartition(6)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rows = talk(seed, [*range(0, 60), *range(-12, 0), 1_000_003, 77, 78])
    rows += [(200 + i, 0, "user", "same") for i in range(40)]                       # equal conversations
    rows += [(300, i % 50, "u", str(i % 7)) for i in range(700)]                    # a long one, ties
    rows += [(301, None, "u", "x"), (301, None, "u", "x"), (301, 3, None, None), (301, -5, "u", "y" * 10_000)]
    rows += [(None, 1, "u", "lost"), (403, 0, "u", "only own"), (404, 0, "u", "own")]
    rows += rows[:5]                                                               # repeated rows
    got = trie.conversation_trie(trie_rows(spark, rows))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
                           "saved_tokens", "ends_sha256"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_trie(rows)


def test_trie_pieces_and_hot_parents(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = [(c, 0, "u", "hello") for c in range(1000, 1100)] + [(c, 1, "u", str(c % 30)) for c in range(1000, 1090)]
    assert {tuple(r) for r in trie.conversation_trie(trie_rows(spark, rows)).collect()} == brute_trie(rows)


def test_trie_without_rows(spark):
    assert trie.conversation_trie(trie_rows(spark, [(1, 1, "u", "t")]).limit(0)).count() == 0
    assert trie.conversation_trie(trie_rows(spark, [(None, 1, "u", "t")])).count() == 0


def test_trie_of_turnless_conversations(spark):
    rows = [(c, 0, "u", "t") for c in (1, 2, 3, 4, 7, 8)]     # their first turns come from absent conversations
    assert {tuple(r) for r in trie.conversation_trie(trie_rows(spark, rows)).collect()} == brute_trie(rows)


# ------------------------------------------------------------------ line rules

def brute_rules(rows, rules):
    docs = [(i, s, t or "") for i, s, t in rows]
    zero = str.maketrans("123456789", "0" * 9)
    norm = lambda x: b" ".join(x.lower().translate(zero).encode().split())
    held = defaultdict(set)
    for i, s, t in docs:
        for x in t.split("\n"):
            if x.encode().split():
                held[s, norm(x)].add((i, t))
    out = []
    for i, s, t in docs:
        words = [w.decode() for w in t.encode().split()]
        grams = Counter(tuple(words[k:k + 5]) for k in range(len(words) - 4))
        places = {p for k in range(len(words) - 4) if grams[tuple(words[k:k + 5])] > 1 for p in range(k, k + 5)}
        full = [x for x in t.split("\n") if x.encode().split()]
        gone = [x for x in full if len(held[s, norm(x)]) > rules.most_docs]
        left = len(words) - sum(len(x.encode().split()) for x in gone)
        failed = len(words) < 10 or 100 * len(places) > 20 * len(words)
        kept = not failed and left >= rules.least_words and left >= rules.least_share * len(words)
        out.append((i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)),
                    len(places), failed, len({norm(x) for x in gone}), left, kept))
    return out


def line_docs():
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "beta", "Ünder", "x#y", "7", "42", "$", "tau tau", "pi"])
    line = lambda n: " ".join(word() for _ in range(n))
    common = [line(6) for _ in range(4)]
    rows = []
    for i in range(160):
        body = [line(rng.randint(3, 9)) for _ in range(rng.randint(0, 6))]
        body += rng.sample(common, rng.randint(0, 3))
        rng.shuffle(body)
        rows.append((i, rng.choice(["a", "a", "b", "", None]), "\n".join(body)))
    rows += [(200 + i, "a", "Visit  us 2%d\r\n\t\n  \n%s" % (i % 10, line(12))) for i in range(9)]     # digits alike
    rows += [rows[3], rows[3], (4, "a", "another text under an id " * 3), (None, "a", common[0]), (None, None, common[0])]
    rows += [(300, "a", None), (301, "a", ""), (302, "a", "\n \n\t"), (303, "b", "w " * 9 + "\n" + common[1]),
             (304, "b", " ".join(f"v{k}" for k in range(60_000))), (305, "b", "one two three four five " * 2)]
    return rows


def docs_frame(spark, rows):
    schema = "doc_id long, source string, text string, kept string, lines int, h int, doc int, lang string"
    return spark.createDataFrame([(*r, "x", 1, 1, 1, None) for r in rows], schema).repartition(5)


@pytest.mark.parametrize("rules", [lines.Rules(most_docs=6), lines.Rules(most_docs=2, least_words=4, least_share=0.6)])
def test_line_rules_equal_brute_force(spark, rules):
    rows = line_docs()
    got = lines.line_rules(docs_frame(spark, rows), rules)
    want = Counter(brute_rules(rows, rules))
    assert Counter(tuple(r) for r in got.collect()) == want
    assert any(r[6] is False and r[9] is False for r in want) and any(r[9] for r in want)


def test_cleaned_texts(spark):
    rows, rules = line_docs(), lines.Rules(most_docs=6)
    df = docs_frame(spark, rows)
    got = lines.cleaned(df, rules)
    assert got.columns == df.columns and got.schema == df.schema
    kept = [r for r in brute_rules(rows, rules) if r[9]]
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r[0] for r in kept)
    left = Counter((r[0], r[8]) for r in kept)
    assert Counter((r["doc_id"], len(r["text"].encode().split())) for r in got.collect()) == left


def test_lines_of_an_empty_table(spark):
    df = docs_frame(spark, line_docs()).limit(0)
    assert lines.line_rules(df).count() == 0 and lines.cleaned(df).count() == 0


def test_join_hot_is_a_join(spark):
    rows = spark.createDataFrame([(i % 3 if i % 2 else 9, i) for i in range(5000)], "k long, v long")
    one = rows.groupBy("k").count()
    assert join_hot(rows, one, ["k"], "count", 5000).count() == 5000
