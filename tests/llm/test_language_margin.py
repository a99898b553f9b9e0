"""Language ID: case, long words, posteriors by brute force, texts of no learned language."""

import math
import random

import numpy as np
import public_tokenizers
import pytest

from moltab.llm import clean
from moltab.llm import op5_language_id as lid

VOCAB = public_tokenizers.path("piece_bpe_32k.model")
PARTS = {"aa": ["tha", "ing", "er", "won", "the"], "bb": ["eau", "que", "ille", "oux", "é"], "cc": ["sch", "ung", "ver", "zu", "ä"]}


def prose(lang, seed, words=60):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(words))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, margin string").repartition(3)


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, prose(l, i), l, "x") for i, l in enumerate(["aa", "bb"] * 60)]
    return lid.fit(frame(spark, rows), VOCAB, docs_per_lang=40)


def test_case_does_not_matter(spark, model):
    texts = [prose(l, 1000 + i) for i, l in enumerate(["aa", "bb"] * 10)]
    mixed = ["".join(c.upper() if k % 3 else c for k, c in enumerate(t)) for t in texts]
    seen = [{r.doc_id: (r.lang_pred, r.score, r.margin) for r in lid.predict(frame(spark, [
        (i, t, None, None) for i, t in enumerate(v)]), model).collect()}
        for v in (texts, [t.upper() for t in texts], mixed)]
    assert seen[0] == seen[1] == seen[2]


def test_posterior_equals_brute_force(spark, model):
    texts = ["Tha ingwon, eau!", "zz ilque 7 ouxer", "É é THE", "q", prose("aa", 5), "won" * 30]
    at = {p: i for i, p in enumerate(model.pieces)}

    def word(w):
        """Sum over all segmentations, one language after the other."""
        total = [np.zeros(len(model.langs))] * len(w) + [np.ones(len(model.langs))]
        for k in range(len(w) - 1, -1, -1):
            total[k] = lid.UNKNOWN * total[k + 1] + sum(
                (model.probs[at[w[k:e]]] * total[e] for e in range(k + 1, len(w) + 1) if w[k:e] in at), 0)
        return np.log(total[0])

    rows = {r.doc_id: r for r in lid.predict(frame(spark, [(i, t, None, None) for i, t in enumerate(texts)]), model).collect()}
    for i, t in enumerate(texts):
        words = lid.words_of(t)
        s = sum(word(w) for w in words)
        assert rows[i].lang_pred == model.langs[int(s.argmax())]
        assert rows[i].score == pytest.approx(1 / np.exp(s - s.max()).sum())
        back = sum(model.letters.get(c, model.unseen) for w in words for c in w)
        assert rows[i].margin == pytest.approx((s.max() - back) / sum(map(len, words)))


def test_long_words_are_counted_alike(model):
    lattice = lid.Lattice(model.pieces)
    words, n = ["▁thainger", "▁queilleoux", "▁zzz"], np.array([[2.0, 1.0], [1.0, 3.0], [1.0, 1.0]])
    short = lattice._expected_short(words, n, model.probs)
    long = np.zeros_like(short)
    for w, k in zip(words, n):
        lattice._expected_long(w, k, model.probs, long)
    assert np.allclose(short, long)
    assert lattice.expected(["▁" + "tha" * 40], n[:1], model.probs).sum() > 10


def test_a_language_of_long_words_is_learned(spark):
    glue = lambda l, i: prose(l, i, 30).replace(" ", "")
    rows = [(i, glue(l, i), l, None) for i, l in enumerate(["aa", "bb"] * 40)]
    m = lid.fit(frame(spark, rows), VOCAB, docs_per_lang=40)
    got = lid.predict(frame(spark, [(i, glue(l, 500 + i), None, None) for i, l in enumerate(["aa", "bb"] * 5)]), m).collect()
    assert all(r.lang_pred == ["aa", "bb"][r.doc_id % 2] for r in got)


def test_only_texts_of_a_learned_language_stay(spark):
    rng = random.Random(2)
    noise = lambda: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(40))  # noqa: E731, E501
    rows = [(i, prose(l, i), l, "x") for i, l in enumerate(["aa", "bb"] * 60)]
    bad = [(1000 + i, noise(), None, "x") for i in range(20)] + [(2000 + i, prose("cc", i), None, "x") for i in range(20)]
    odd = [(3000, None, "aa", "x"), (3001, "", None, "x"), (3002, "12 ! 34", "aa", "x"), rows[0], (None, prose("aa", 7), None, "x"),
           (3003, prose("bb", 9, 20_000).upper(), None, "x")]
    df = frame(spark, rows + bad + odd)
    kept = clean.keep_identified(df, VOCAB)
    assert kept.schema == df.schema
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert ids == sorted([*range(120), 0, -1, 3003])
    assert clean.keep_identified(df.limit(0), VOCAB).count() == 0
    assert math.isfinite(lid.Model((), (), np.zeros((0, 0))).unseen)
