"""Secrets, licenses, language, near-duplicates against plain Python."""

import hashlib
import random
import re

import pytest
import public_tokenizers

from moltab.llm import op5_language_id as lid
from moltab.llm import op8_secret_scan as sec
from moltab.llm import op9_minhash as mh
from moltab.llm import op10_license_scan as lic
from moltab.session import scratch_path

SCHEMA = "doc_id long, text string, lang string, score double, blob string"


def frame(spark, docs, langs=None):
    return spark.createDataFrame([(d, t, langs[i] if langs else None, 0.5, "x")
                                  for i, (d, t) in enumerate(docs)], SCHEMA).repartition(3)


# ---------------------------------------------------------------- secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def base_spans(t):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(t) if len(m[0]) >= 24]
    return sorted(out)


def secret_texts():
    h = "0123456789abcdef" * 2
    docs = [None, "", "plain", f"password={h}", f"Api_Key = '{h[:12]}' x", "secret: token: abcdefg",
            "token=token=abcdef", "AKIA" + "A1" * 8, "AKIAAKIA" + "B2" * 8, "AKIA1234", f"é🙂{h}é PASSWD:abcdef",
            f"{h} {h}", "a" * 23, "a" * 24, "token=short token=abcdef", "-----BEGIN RSA PRIVATE KEY-----",
            "ghp_" + "a1B2" * 9, "x" * 50_000 + " secret=abc.def-gh", "token\x20\x20:\x20\x20\"abcdefgh\""]
    rnd = random.Random(1)
    words = ["token", "=", ":", " ", "secret", "AKIA", "AB12CD34", h[:9], "'", "zz", "é", "\n", "api_key"]
    docs += ["".join(rnd.choice(words) for _ in range(30)) for _ in range(60)]
    return list(enumerate(docs)) + [(3, docs[3]), (None, docs[4])]


def check_report(rows, docs):
    want = []
    for d, t in docs:
        spans = base_spans(t or "")
        line = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
        want.append((d if d is not None else -1, *(sum(s[2] == k for s in spans) for k in ("assign", "access", "hex")),
                     hashlib.sha256(line.encode()).hexdigest()))
    got = [(r.doc_id if r.doc_id is not None else -1, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows]
    assert sorted(got) == sorted(want)


def test_secrets_equal_plain_scan(spark):
    docs = secret_texts()
    rows = sec.report(sec.scan(frame(spark, docs), scratch_path(spark, "ledger"))).collect()
    check_report(rows, docs)
    by = {r.doc_id: r.spans for r in rows}
    assert by[15].startswith("pem:0:") and by[16].startswith("github:0:")
    assert sec.report(sec.scan(frame(spark, docs).limit(0), scratch_path(spark, "ledger"))).count() == 0


def test_ledger_scans_only_unseen_pairs(spark):
    docs, ledger = secret_texts(), scratch_path(spark, "ledger")
    old, new = docs[:30], docs
    check_report(sec.report(sec.scan(frame(spark, old), ledger)).collect(), old)
    seen = spark.read.parquet(ledger).count()
    check_report(sec.report(sec.scan(frame(spark, new), ledger)).collect(), new)
    rows = spark.read.parquet(ledger)
    assert rows.count() == rows.select("blob").distinct().count() == len({t or "" for _, t in docs}) > seen
    # a new rule version makes its own pairs unseen, and only those
    rules = (sec.BASE[0], sec.BASE[1], sec.Rule("hex", r"[0-9a-f]{26,}", version=2, quick=r"[0-9a-f]{26}"))
    found = sec.scan(frame(spark, new), ledger, rules)
    last = spark.read.parquet(ledger).where("size(rules) = 1")
    assert {r.rules[0] for r in last.collect()} == {"hex@2"} and last.select("blob").distinct().count() == \
        rows.select("blob").distinct().count()
    assert {s.kind for r in found.collect() for s in r.found} <= {"assign", "access", "hex"}


# ---------------------------------------------------------------- licenses

def test_license_places_and_fuzzy_spans(spark):
    docs = [(1, None), (2, ""), (3, "the MIT License, mit license"), (4, "GNU General Public License" * 2),
            (5, "mitlicense mit-license"), (6, "CC BY CC BY cc by-nc"), (7, "Relesed under the MIT Licence"),
            (8, "x " * 30_000 + "licensd under the Apache Licence, Version 2.0"), (9, "nothing here " * 50), (9, "é apache license")]
    got = {(r.doc_id, r.n_words): r for r in lic.scan_licenses(frame(spark, docs)).collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        r = got[d, len(words)]
        places, labels = [], set()
        for p, label in lic.PHRASES.items():
            w = p.split()
            for i in range(len(words) - len(w) + 1):
                if words[i:i + len(w)] == w:
                    places.append(i)
                    labels.add(label)
        assert (r.n_base, r.first_word, r.last_word) == (len(places), min(places, default=None), max(places, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and 0 <= r.score <= 1
        assert labels <= set(r.labels.split(","))
    assert got[7, 5].labels == "near-mit" and got[7, 5].spans[0].edits == 2
    (span,) = got[8, 30_008].spans
    assert (span.label, span.first_word, span.last_word) == ("near-apache", 30_000, 30_007)
    assert got[9, 100].labels == "" and got[9, 100].score == 0
    assert lic.scan_licenses(frame(spark, docs).limit(0)).count() == 0


def test_every_edit_within_the_bound_is_found():
    index, rnd = lic.NoticeIndex(lic.NOTICES), random.Random(3)
    for label, text, k, _ in index.notices:
        for _ in range(20):
            s = list(text)
            for _ in range(k):
                at = rnd.randrange(len(s))
                s[at:at + 1] = rnd.choice(["", "q", s[at] + "q"])
            found = index.find("zz " * 20 + "".join(s) + " yy" * 20)
            assert any(f[0] == label for f in found), "".join(s)


# ---------------------------------------------------------------- language

def test_forward_sums_all_segmentations():
    pieces = ("a", "ab", "abc", "b", "bc", "c", "▁", "▁a", "中")
    import numpy as np
    lattice, p = lid.Lattice(pieces), np.random.default_rng(1).random((len(pieces), 2)) * 0.1

    def brute(w):
        if not w:
            return np.ones(2)
        return lid.UNKNOWN * brute(w[1:]) + sum((p[pieces.index(w[:n])] * brute(w[n:])
                                                 for n in range(1, len(w) + 1) if w[:n] in pieces), np.zeros(2))

    words = ["▁abcabc", "▁", "▁a中b", "▁xyz", "▁cab"]
    want = np.log([brute(w) for w in words])
    assert np.allclose(lattice.log_likelihood(words, p), want)
    assert np.allclose([lattice._long(w, p) for w in words], want)
    # expected piece counts: a word's counts weigh its segmentations
    counts = lattice.expected(["▁a"], np.ones((1, 2)), p)
    whole = p[pieces.index("▁a")] / np.exp(want := lattice.log_likelihood(["▁a"], p)[0])
    assert np.allclose(counts[pieces.index("▁a")], whole) and want.shape == (2,)


def test_language_prediction(spark):
    rnd = random.Random(4)
    words = {"aa": ["der", "und", "nicht", "schön"], "bb": ["the", "of", "tion", "with"], "cc": ["que", "los", "ción", "para"]}
    docs, langs = [], []
    for i in range(240):
        l = rnd.choice(list(words))
        docs.append((i, " ".join(rnd.choice(words[l]) for _ in range(rnd.randint(5, 40)))))
        langs.append(l)
    docs += [(1000, None), (1001, ""), (1002, "12 !? 3"), (1003, "w" * 5000), (7, docs[7][1]), (None, docs[8][1])]
    langs += [None, "aa", None, None, langs[7], None]
    df = frame(spark, docs, langs)
    model = lid.fit(df, public_tokenizers.path("piece_bpe_32k.model"), docs_per_lang=30)
    assert model.langs == ("aa", "bb", "cc")
    rows = lid.predict(df, model).collect()
    assert len(rows) == len(docs)
    by = {r.doc_id: r for r in rows}
    assert all(by[i].lang_pred == langs[i] for i in range(240))
    import zlib
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(240))
    assert {by[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and by[1000].score == 0
    assert by[1003].lang_pred in model.langs and 0 <= by[1003].score <= 1
    none = lid.fit(frame(spark, docs), public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.lang_pred for r in lid.predict(df, none).collect()} == {"und"}
    assert lid.predict(df.limit(0), model).count() == 0


# ---------------------------------------------------------------- near-duplicates

def plain_shingles(text, words):
    """Distinct shingles as tuples of words, independent of the operator's hashes."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(found[i:i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def brute_components(docs, near):
    sets = [(d, plain_shingles(t, near.words)) for d, t in docs]
    parent = {d: d for d, _ in docs if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            both = len(s & t)
            if a is not None and b is not None and both and near.den * both >= near.num * (len(s) + len(t) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d) if d is not None else None) for d, s in sets}


@pytest.mark.parametrize("near", [mh.CONTRACT, mh.Near()])
def test_near_duplicates_equal_brute_force(spark, near):
    rnd = random.Random(5)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice("aeiou") + rnd.choice("klmnop")
    passage = [word() for _ in range(60)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "one two\tthree"),
            (7, "one  two three"), (8, "É one"), (9, "é one")]
    for g in range(12):      # groups of near copies, some chained
        t = [word() for _ in range(rnd.randint(20, 200))]
        for _ in range(12):
            docs.append((len(docs), " ".join(t)))
            if rnd.random() < 0.7:
                t[rnd.randrange(len(t))] = word()
    for _ in range(40):      # a passage that many documents share
        docs.append((len(docs), " ".join([word() for _ in range(rnd.randint(5, 40))] + passage)))
    docs += [(20, docs[20][1]), (None, docs[21][1])]
    rows = mh.near_duplicates(frame(spark, docs), near).collect()
    want = brute_components(docs, near)
    assert len(rows) == len(docs)
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
    assert mh.near_duplicates(frame(spark, docs).limit(0), near).count() == 0


def test_crowded_buckets_lose_no_link(spark):
    """Pairs at the limit are found however many others share their bucket."""
    rnd = random.Random(9)
    near = mh.Near(words=1, num=50, den=100, groups=12, width=1)
    docs = []
    passage = [f"p{i}" for i in range(38)]
    for g in range(120):     # a hot passage, and pairs just at or just below the limit
        own, both = [f"x{g}y{i}" for i in range(22)], 1 + rnd.randint(0, 1)
        docs.append((2 * g, " ".join(passage + own)))
        docs.append((2 * g + 1, " ".join(passage + own[:both] + [f"z{g}y{i}" for i in range(22 - both)])))
    want = brute_components(docs, near)
    assert len({c for _, c in want.values()}) < len(docs)
    crowded = {r.doc_id: r.component_id for r in mh.near_duplicates(frame(spark, docs), near).collect()}
    # 0.3 % of the pairs at the limit agree in fewer than two of 12 collections
    assert sum(c != want[d][1] for d, c in crowded.items()) <= 2


def test_versions_of_one_id(spark):
    from moltab.llm.clean import keep_representatives
    rnd = random.Random(10)
    text = lambda: [rnd.choice("abcdefgh") + rnd.choice("aeiou") + rnd.choice("klmnop") for _ in range(80)]
    docs, apart = [], []
    for g in range(12):      # two texts of equal set size under id 10 g, a near copy of each elsewhere
        one, two = text(), text()
        docs += [(10 * g, " ".join(one)), (10 * g, " ".join(two)),
                 (10 * g + 1, " ".join(one + ["end"])), (10 * g + 2, " ".join(two + ["end"]))]
        apart += [(10 * g, " ".join(one)), (10 * g, " ".join(two))]
    docs += [(5, docs[2][1]), (5, " ".join(text())), (5, docs[2][1])]    # one version copies another document
    rows = mh.near_duplicates(frame(spark, docs), mh.CONTRACT).collect()
    want = brute_components(docs, mh.CONTRACT)
    assert sorted((r.doc_id, r.component_id) for r in rows) == sorted((d, want[d][1]) for d, _ in docs)
    kept = keep_representatives(frame(spark, docs).select("doc_id", "text"), mh.CONTRACT).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted(apart + [docs[-2]])


def test_leaders_stand_in_the_middle_of_their_group(spark, monkeypatch):
    """Copies that are near one text only, which has the largest id, are linked by leaders;
    none of them is left to be compared with the others."""
    rnd = random.Random(12)
    near = mh.Near(words=1, num=85, den=100, groups=16)
    middle = [f"m{i}" for i in range(200)]
    docs = [(1000, " ".join(middle))]
    for g in range(60):
        t = list(middle)
        for at in rnd.sample(range(200), 13):
            t[at] = f"x{g}y{at}"
        docs.append((g, " ".join(t)))
    want = brute_components(docs, near)
    assert {c for _, c in want.values()} == {0}
    left, old = [], mh._prefix_links
    monkeypatch.setattr(mh, "_prefix_links", lambda rows, *a: left.append(rows.count()) or old(rows, *a))
    rows = mh.near_duplicates(frame(spark, docs), near).collect()
    assert {r.component_id for r in rows} == {0} and left == [0]


def test_links_are_decided_without_leaving_the_jvm(spark):
    """Full sets of thousands of pairs are not sent to Python workers at a time."""
    sets = spark.createDataFrame(
        [(1, 0, list(range(20))), (2, 0, list(range(17))), (3, 0, list(range(16))), (4, -1, [-5]), (5, 0, [-5]),
         (6, 0, list(range(10, 30)))], "c long, v long, s array<long>")
    pairs = spark.createDataFrame([(1, 0, 2, 0), (1, 0, 3, 0), (4, -1, 5, 0), (2, 0, 3, 0), (1, 0, 6, 0), (4, 0, 5, 0)],
                                  "a long, va long, b long, vb long")
    linked = mh._verified(pairs, sets, mh.CONTRACT)      # 17 of 20 is 0.85
    assert sorted(map(tuple, linked.collect())) == [(1, 2), (2, 3), (4, 5)]
    assert "InArrow" not in linked._jdf.queryExecution().toString()
