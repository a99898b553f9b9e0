"""Token counts and packing against the tokenizer library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from moltab.llm import op1_packing as pack
from moltab.llm import op3_token_counts as tok

DOC = "doc_id long, text string, doc_tokens int, n_tokens int"   # two clashing names
PARTS = ["the", "ing", "'s", "'ll", " ", "  ", "\n", "\t", " \n ", "0", "12", ".", ",", "!?", "-", "é",
         "ü", "中文", "🙂", "́", " ", "\x1c", "\x85", "<|endoftext|>", "<|endo", "Abc", "zzxq"]


def texts(n, seed, most=40):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def test_transducer_counts_like_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), tok.TextCounter(path)
    for t in texts(400, 1):
        want = len(lib.encode(t, add_special_tokens=False).ids)
        for chunk in (1 << 16, 7, 1):   # wherever the cuts fall
            assert own.count(t, chunk) == want, (t, chunk)


def test_adjacent_pairs_follow_the_merges():
    fst = tok.TextCounter(public_tokenizers.path("byte_bpe_50k.json")).fst
    rnd = random.Random(2)
    short = [t for t in fst.token_at if t and len(t) <= 3]
    for _ in range(3000):
        a, b = rnd.choice(short), rnd.choice(short)
        assert fst._stays(a, b) == (fst.encode(a + b) == [a, b])


def test_long_word_and_table_resets(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    monkeypatch.setattr(tok, "MAX_STATES", 50)
    monkeypatch.setattr(tok, "MAX_WORDS", 5)
    own = tok.TextCounter(path)
    for t in ["ab" * 5000, "x" * 3000 + " y", *texts(60, 3)]:
        assert own.count(t, 999) == len(lib.encode(t, add_special_tokens=False).ids)


def test_count_tokens_rows(spark):
    rows = [(1, None, 0, 0), (2, "", 0, 0), (3, "the end", 0, 0), (3, "the end", 0, 0), (None, "é a", 0, 0)]
    df = spark.createDataFrame(rows, DOC)
    got = tok.count_tokens(df, public_tokenizers.path("byte_bpe_50k.json"), limit=1).collect()
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == [
        (0, 4, 2, True), (1, 0, 0, False), (2, 0, 0, False), (3, 7, 2, True), (3, 7, 2, True)]
    assert tok.count_tokens(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def check_pieces(rows, docs, limits):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4") for _, t in docs]
    want = sorted((d, len(i)) for (d, _), i in zip(docs, ids))
    by_doc: dict = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for (d, _), i in zip(docs, ids):
        cover = sorted((r.start, r.length, r.ids_crc32) for r in by_doc[d])
        copies = sum(x == d for x, _ in docs)
        assert sum(c[1] for c in cover) == copies * len(i)
        for start, n, crc in cover:
            assert zlib.crc32(i[start:start + n].tobytes()) == crc
    assert len(want) == len(docs)
    by_seq: dict = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limits.tokens and len(pieces) <= limits.segments
        assert sum(p.loss_tokens for p in pieces) <= limits.loss


@pytest.mark.parametrize("limits", [pack.Limits(), pack.Limits(tokens=64, segments=3, loss=50, pool=8, min_cut=4),
                                    pack.Limits(tokens=16, segments=16, loss=16, pool=1, min_cut=1)])
def test_packing_round_trip(spark, limits):
    docs = [(i, t) for i, t in enumerate(texts(60, 4, 60))] + [(60, None), (61, ""), (62, "word " * 3000)]
    docs += [(5, docs[5][1])]     # a repeated row
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], DOC).repartition(3)
    rows = pack.pack_documents(df, public_tokenizers.path("word_bpe_49k.json"), limits).collect()
    check_pieces(rows, docs, limits)
    assert pack.pack_documents(df.limit(0), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_little_padding():
    rnd, packer, rows = random.Random(6), pack.Packer(pack.Limits()), []
    for i in range(4000):
        n = int(rnd.lognormvariate(6.5, 1)) + 1
        rows += packer.add(i, n, n - 1)
    rows += packer.finish()
    used: dict = {}
    for r in rows:
        used[r[4]] = used.get(r[4], 0) + r[2]
    padding = sum(0 if n & (n - 1) == 0 else 4096 - n for n in used.values())
    assert padding < 0.01 * sum(used.values()) and max(used.values()) <= 4096
    assert len(rows) < 4000 * 1.2      # few cuts


def test_pack_items_refuses_bad_counts(spark):
    ok = spark.createDataFrame([(1, 10, 4), (2, 7, 0), (3, 30, 30)], "i long, t long, l long")
    got = pack.pack_items(ok.coalesce(1), pack.Limits(tokens=16, loss=12, segments=4, min_cut=2), "i", "t", "l").collect()
    assert sum(r.length for r in got) == 47 and sum(r.loss_tokens for r in got) == 34
    bad = spark.createDataFrame([(1, 0, 0)], "i long, t long, l long")
    with pytest.raises(Exception, match="item 1"):
        pack.pack_items(bad, pack.Limits(), "i", "t", "l").collect()


def test_a_worker_keeps_the_words_of_one_operator():
    from moltab.llm import common, op5_language_id
    kept = {"counts": tok._COUNTERS, "language": op5_language_id._SCORES, "packing": pack._WORDS}
    before = {k: dict(v) for k, v in kept.items()}
    try:
        for v in kept.values():
            v["x"] = ()
        common.claim("packing")
        assert "x" in pack._WORDS and not kept["counts"] and not kept["language"]
    finally:
        for k, v in kept.items():
            v.clear()
            v.update(before[k])


def test_words_of_letters_follow_the_normaliser():
    words = pack.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    text = " ".join(f"A{chr(c)}b" for c in range(0x80, 0x400) if chr(c).isalpha()) + " ΟΔΟΣ Straße x'll"
    assert words["Abc"]                      # made when it is first asked for
    got = np.frombuffer(next(words.texts(pa.array([text]))), dtype="<u4").tolist()
    assert got == words.lib.encode(text, add_special_tokens=False).ids


def test_the_library_sees_marks_and_stems_once():
    """Words of letters and marks are put together from both, whatever the marks."""
    words = pack.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    lib, seen = words.lib, []

    class Counted:
        def encode(self, text, **how):
            seen.append(text)
            return lib.encode(text, **how)

    words.lib = Counted()
    stems = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}É" for i in range(200)]
    marks = ["", ".", "...", "$$$", "!?", '")', "<|", "|>", "=", "-"]
    text = " ".join(s + m for s in stems for m in marks)
    got = [np.frombuffer(x, dtype="<u4").tolist() for x in words.texts(pa.array(["", text, " \n", f"\t{text} "]))]
    want = lib.encode(text, add_special_tokens=False).ids
    assert got == [[], want, [], want]
    assert sorted(filter(None, seen)) == sorted(filter(None, marks))
    odd = ["x'll.", "x's", "it's$$$", "'re", "a<|endoftext|>", "<|endoftext|>.", "12$$", "a1$$", "≠", "a̸.", "$$$", "#a#"]
    for w in odd:
        assert np.frombuffer(next(words.texts(pa.array([w]))), dtype="<u4").tolist() == \
            lib.encode(w, add_special_tokens=False).ids


def test_ids_are_laid_out_in_parts(monkeypatch):
    monkeypatch.setattr(pack, "SLICE_WORDS", 3)
    words = pack.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    docs = texts(40, 8) + ["", "word " * 50]
    col = pa.array(docs)
    cuts = list(pack._slices(col, 100))
    assert [i for a, b in cuts for i in range(a, b)] == list(range(len(docs)))
    got = [x for a, b in cuts for x in words.texts(col.slice(a, b - a))]
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == \
        [words.lib.encode(t, add_special_tokens=False).ids for t in docs]
