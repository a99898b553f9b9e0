"""Language identification with segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary file.  Per language a unigram
distribution over pieces is fitted with expectation maximisation on labelled
words; a word's likelihood is the sum over all its segmentations into pieces
(forward algorithm), a text's the product over its words.  The prediction is the
language with the largest posterior under equal priors.

Words are the runs of letters of the lower-cased text.  Likelihoods of words are
remembered per worker, so the forward pass runs once per new word, vectorised
over all new words of a slice.

A background model (letters of all labelled languages, drawn one by one) gives every
prediction a ``margin`` that tells text from letter noise.

``fit`` uses at most ``docs_per_lang`` labelled documents per language (those with
the smallest hash of their id: a bounded sample); everything else covers all
rows and whole texts.

Prediction of null texts and texts without a letter: ``und`` with score 0.  Ties
go to the language first in alphabetical order.  Without any labelled row every
text is ``und``.  Repeated rows give repeated results; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moltab.llm.common import claim, importable, staged, table, worker_cache

LETTERS = regex.compile(r"\p{L}+")
#: Mark that starts a word in the vocabulary.
WORD_MARK = "▁"
#: Probability of a character that no piece covers, and of pieces never expected.
UNKNOWN, FLOOR = 1e-8, 1e-9
#: Words longer than this are scored by the scalar recursion.
SHORT = 40
MAX_WORDS = 500_000
SLICE_CHARS = 1 << 21


@dataclass(frozen=True)
class Model:
    """``pieces[i]`` has probability ``probs[i, l]`` in language ``langs[l]``."""
    langs: tuple[str, ...]
    pieces: tuple[str, ...]
    probs: np.ndarray
    #: Log probabilities of letters and of the word mark over all languages, and of others.
    letters: dict[str, float] = field(default_factory=dict)
    unseen: float = 0.0

    def background(self, word: str) -> float:
        """Log likelihood of a word as letters drawn one by one."""
        return sum(self.letters.get(c, self.unseen) for c in word)


def vocabulary(path: str) -> tuple[str, ...]:
    """Pieces of a sentencepiece file that consist of lower-case letters and the
    word mark."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {sp.id_to_piece(i) for i in range(sp.get_piece_size())
             if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    keep = {p for p in found if p.lower() == p and LETTERS.fullmatch(p.removeprefix(WORD_MARK) or "a")}
    return tuple(sorted(keep))


class Lattice:
    """All segmentations of words into pieces, as a dense trie walked for every
    (word, start) at once."""

    def __init__(self, pieces: tuple[str, ...]):
        # characters that are a piece of their own only need no column of the table
        self.chars = {c: i + 1 for i, c in enumerate(sorted({c for p in pieces if len(p) > 1 for c in p}))}
        self.lone = {p: i for i, p in enumerate(pieces) if p not in self.chars and len(p) == 1}
        nodes: list[dict[int, int]] = [{}]
        ids = [-1]
        for i, p in enumerate(pieces):
            if p in self.lone:
                continue
            n = 0
            for c in p:
                k = self.chars[c]
                if k not in nodes[n]:
                    nodes[n][k] = len(nodes)
                    nodes.append({})
                    ids.append(-1)
                n = nodes[n][k]
            ids[n] = i
        self.next = np.full((len(nodes), len(self.chars) + 1), -1, dtype=np.int32)
        for n, kids in enumerate(nodes):
            for k, m in kids.items():
                self.next[n, k] = m
        self.piece = np.array(ids, dtype=np.int32)
        self.depth = max(map(len, pieces), default=1)

    def edges(self, words: list[str]) -> tuple[np.ndarray, list[tuple]]:
        """Word lengths and, by start then length, ``(start, size, word rows, piece ids)``."""
        size = np.array([len(w) for w in words])
        code = np.zeros((len(words), size.max()), dtype=np.int32)
        get, out, lone = self.chars.get, [], {}
        for r, w in enumerate(words):
            code[r, :len(w)] = [get(c, 0) for c in w]
            if not code[r, :len(w)].all():
                for at, c in enumerate(w):
                    if c in self.lone:
                        lone.setdefault(at, []).append((r, self.lone[c]))
        for at, found in lone.items():
            rp = np.array(found)
            out.append((at, 1, rp[:, 0], rp[:, 1]))
        for start in range(code.shape[1]):
            rows = np.nonzero(size > start)[0]
            node = np.zeros(len(rows), dtype=np.int32)
            for n in range(1, min(self.depth, code.shape[1] - start) + 1):
                node = self.next[node, code[rows, start + n - 1]]
                alive = node >= 0
                rows, node = rows[alive], node[alive]
                if not len(rows):
                    break
                p = self.piece[node]
                ends = p >= 0
                if ends.any():
                    out.append((start, n, rows[ends], p[ends]))
        return size, out

    def forward(self, words: list[str], probs: np.ndarray):
        """Forward sums ``alpha[word, position, language]`` and the edges used."""
        size, edges = self.edges(words)
        alpha = np.zeros((len(words), size.max() + 1, probs.shape[1]))
        alpha[:, 0] = 1.0
        by_start: dict[int, list] = {}
        for e in edges:
            by_start.setdefault(e[0], []).append(e)
        for start in range(size.max()):
            # an uncovered character is stepped over with the unknown probability
            alpha[:, start + 1] += alpha[:, start] * UNKNOWN
            for _, n, rows, p in by_start.get(start, ()):
                alpha[rows, start + n] += alpha[rows, start] * probs[p]
        return size, edges, alpha

    def log_likelihood(self, words: list[str], probs: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), probs.shape[1]))
        order = sorted((i for i, w in enumerate(words) if len(w) <= SHORT), key=lambda i: len(words[i]))
        for at in range(0, len(order), 8192):   # words of like length together
            part = order[at:at + 8192]
            size, _, alpha = self.forward([words[i] for i in part], probs)
            out[part] = np.log(alpha[np.arange(len(part)), size])
        for i, w in enumerate(words):
            if len(w) > SHORT:
                out[i] = self._long(w, probs)
        return out

    def _long(self, word: str, probs: np.ndarray) -> np.ndarray:
        """The same sum for one long word, rescaled as it goes."""
        ring = np.zeros((self.depth + 1, probs.shape[1]))
        ring[0] = 1.0
        log = np.zeros(probs.shape[1])
        code = [self.chars.get(c, 0) for c in word]
        for start in range(len(code)):
            here = ring[0]
            ring[1] += here * UNKNOWN
            if word[start] in self.lone:
                ring[1] += here * probs[self.lone[word[start]]]
            node = 0
            for n in range(1, min(self.depth, len(code) - start) + 1):
                node = self.next[node, code[start + n - 1]]
                if node < 0:
                    break
                if self.piece[node] >= 0:
                    ring[n] += here * probs[self.piece[node]]
            ring = np.roll(ring, -1, axis=0)
            ring[-1] = 0.0
            scale = ring.max(axis=0)
            ring /= scale
            log += np.log(scale)
        return log + np.log(ring[0])

    def expected(self, words: list[str], weights: np.ndarray, probs: np.ndarray) -> np.ndarray:
        """Expected piece counts of weighted words (``weights[word, language]``)."""
        short = [i for i, w in enumerate(words) if len(w) <= SHORT]
        counts = self._expected_short([words[i] for i in short], weights[short], probs) if short else np.zeros_like(probs)
        for i, w in enumerate(words):
            if len(w) > SHORT:
                self._expected_long(w, weights[i], probs, counts)
        return counts

    def _expected_long(self, word: str, weights: np.ndarray, probs: np.ndarray, counts: np.ndarray) -> None:
        """The same for one long word, in logarithms; adds to ``counts``."""
        n, edges = len(word), []
        code = [self.chars.get(c, 0) for c in word]
        for start in range(n):
            edges.append((start, start + 1, -1))
            if word[start] in self.lone:
                edges.append((start, start + 1, self.lone[word[start]]))
            node = 0
            for k in range(1, min(self.depth, n - start) + 1):
                node = self.next[node, code[start + k - 1]]
                if node < 0:
                    break
                if self.piece[node] >= 0:
                    edges.append((start, start + k, int(self.piece[node])))
        with np.errstate(divide="ignore"):
            price = lambda p: np.log(UNKNOWN) if p < 0 else np.log(probs[p])
            alpha = np.full((n + 1, probs.shape[1]), -np.inf)
            beta = alpha.copy()
            alpha[0] = beta[n] = 0.0
            for a, b, p in edges:                    # by start
                alpha[b] = np.logaddexp(alpha[b], alpha[a] + price(p))
            for a, b, p in reversed(edges):
                beta[a] = np.logaddexp(beta[a], beta[b] + price(p))
            for a, b, p in edges:
                if p >= 0:
                    counts[p] += weights * np.exp(alpha[a] + price(p) + beta[b] - alpha[n])

    def _expected_short(self, words: list[str], weights: np.ndarray, probs: np.ndarray) -> np.ndarray:
        size, edges, alpha = self.forward(words, probs)
        w = np.arange(len(words))
        beta = np.zeros_like(alpha)
        beta[w, size] = 1.0
        counts = np.zeros_like(probs)
        total = alpha[w, size]
        by_start: dict[int, list] = {}
        for e in edges:
            by_start.setdefault(e[0], []).append(e)
        for start in range(size.max() - 1, -1, -1):
            inside = size > start
            beta[inside, start] += beta[inside, start + 1] * UNKNOWN
            for _, n, rows, p in by_start.get(start, ()):
                beta[rows, start] += probs[p] * beta[rows, start + n]
                share = alpha[rows, start] * probs[p] * beta[rows, start + n] / total[rows]
                np.add.at(counts, p, share * weights[rows])
        return counts


def words_of(text: str) -> list[str]:
    return [WORD_MARK + w for w in LETTERS.findall(text.lower())]


def in_fold(key) -> F.Column:
    """Whether a row is held out: crc32 of its id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, vocab: str, docs_per_lang: int = 400, rounds: int = 3,
        key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit piece probabilities on labelled rows that are not held out.

    Words are counted per language by Spark; a round of expectation maximisation
    is a job whose tasks add up expected counts, of which at most (pieces x
    languages) rows come back.
    """
    spark = docs.sparkSession
    importable(spark)
    pieces = vocabulary(vocab)
    rows = docs.where(~in_fold(key) & F.col(lang).isNotNull() & F.col(text).isNotNull()) \
        .select(F.col(key).cast("string").alias("k"), F.col(lang).cast("string").alias("lang"),
                F.col(text).alias("text"))
    # bounded sample without a sort of the corpus: keep what the hash threshold lets
    # through (a quarter above the bound on average), then rank that small part
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = tuple(sorted(sizes))
    if not langs:
        return Model((), pieces, np.zeros((len(pieces), 0)))
    h = F.coalesce(F.crc32(F.md5(F.col("k").cast("binary")).cast("binary")), F.lit(0)).cast("double") / 2 ** 32
    share = F.create_map(*[x for l in langs for x in (
        F.lit(l), F.lit(min(1.0, (1.25 * docs_per_lang + 50) / sizes[l])))])
    near = rows.withColumn("h", h).where(F.col("h") < share[F.col("lang")])
    w = Window.partitionBy("lang").orderBy("h", "k", F.xxhash64("text"))
    sample = near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= docs_per_lang)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter
        for b in batches:
            n: Counter = Counter()
            for l, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for x in words_of(t):
                    n[x, l] += 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()),
                 pa.array(list(n.values()), pa.int64())], names=["word", "lang", "n"])

    counted = sample.select("lang", "text").mapInArrow(words, "word string, lang string, n long")
    per_word = staged(counted.groupBy("word").agg(*[
        F.coalesce(F.sum(F.when(F.col("lang") == l, F.col("n"))), F.lit(0)).alias(f"n{i}")
        for i, l in enumerate(langs)]), "lid-words")
    # start: shorter pieces likelier, alike in all languages
    first = np.array([8.0 ** -len(p) for p in pieces])
    probs = np.repeat((first / first.sum())[:, None], len(langs), axis=1)
    for _ in range(rounds):
        now = spark.sparkContext.broadcast((pieces, probs))   # vocabulary x languages

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            claim("language")
            _SCORES.clear()                      # of an earlier model
            vocab_, p = now.value
            lattice, total = _lattice(vocab_), np.zeros_like(p)
            for b in batches:
                ws = b.column(0).to_pylist()
                n = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns[1:]], axis=1)
                for at in range(0, len(ws), 4096):
                    total += lattice.expected(ws[at:at + 4096], n[at:at + 4096].astype(float), p)
            i, l = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(l), pa.array(total[i, l])],
                                             names=["i", "l", "n"])

        got = per_word.mapInArrow(expect, "i long, l long, n double") \
            .groupBy("i", "l").agg(F.sum("n").alias("n")).collect()
        counts = np.zeros_like(probs)
        for r in got:
            counts[r["i"], r["l"]] = r["n"]
        probs = np.maximum(counts / np.maximum(counts.sum(axis=0), 1e-300), FLOOR)
        probs /= probs.sum(axis=0)
        now.unpersist()
    letters = {r["c"]: r["n"] for r in per_word.select(
        F.explode(F.split("word", "")).alias("c"), sum(F.col(f"n{i}") for i in range(len(langs))).alias("n"))
        .groupBy("c").agg(F.sum("n").alias("n")).collect() if r["c"]}       # as many rows as letters
    all_ = sum(letters.values()) + len(letters) + 1
    return Model(langs, pieces, probs, {c: math.log((n + 1) / all_) for c, n in letters.items()}, -math.log(all_))


_LATTICES: dict[int, tuple[tuple, Lattice]] = worker_cache("language")


def _lattice(pieces: tuple[str, ...]) -> Lattice:
    k = hash(pieces)
    if k not in _LATTICES or _LATTICES[k][0] != pieces:
        _LATTICES.clear()
        _LATTICES[k] = pieces, Lattice(pieces)
    return _LATTICES[k][1]


class WordScores(dict):
    """Row of the score table of every known blank-separated token."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.lattice = model, _lattice(model.pieces)
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.words: dict[str, int] = {}      # row of a word by itself
        # log likelihood per language, of the background, words, letters with word marks
        self.table = np.zeros((1024, len(self.model.langs) + 3))
        self.used = 0

    def learn(self, tokens: set[str]) -> None:
        new = tokens.difference(self)
        if len(self) + len(new) > MAX_WORDS:
            self.clear()
            new = tokens
        low = {t: t.lower() for t in new}
        split = {t: [WORD_MARK + x] if x.isalpha() else words_of(t) for t, x in low.items()}
        fresh = list({w for ws in split.values() for w in ws}.difference(self.words))
        more = [t for t, ws in split.items() if len(ws) != 1]
        while self.used + len(fresh) + len(more) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if fresh:
            to = self.used + len(fresh)
            self.table[self.used:to, :-3] = self.lattice.log_likelihood(fresh, self.model.probs)
            self.table[self.used:to, -3] = [self.model.background(w) for w in fresh]
            self.table[self.used:to, -2] = 1
            self.table[self.used:to, -1] = [len(w) for w in fresh]
            self.words.update(zip(fresh, range(self.used, to)))
            self.used = to
        for t, ws in split.items():
            if len(ws) == 1:     # most tokens: a word and its marks share a row
                self[t] = self.words[ws[0]]
                continue
            self.table[self.used] = self.table[[self.words[w] for w in ws]].sum(axis=0) if ws else 0.0
            self[t] = self.used
            self.used += 1

    def texts(self, texts: list[str]) -> Iterator[np.ndarray]:
        split = [t.split() for t in texts]
        self.learn(set().union(*split))
        for tokens in split:
            at = np.fromiter(map(self.__getitem__, tokens), dtype=np.int64, count=len(tokens))
            yield self.table[at].sum(axis=0)


_SCORES: dict[int, WordScores] = worker_cache("language")


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text",
            keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, margin`` per row, and the columns of ``keep``
    (whose names must differ from those five).

    ``score`` compares the languages with each other and nears 1 after a few words whatever
    the text; ``margin`` is the mean log-likelihood ratio per letter of the predicted
    language to letters drawn one by one.  It does not grow with the text and is negative
    for texts in none of the languages."""
    spark = docs.sparkSession
    importable(spark)
    sent = spark.sparkContext.broadcast(model)   # vocabulary x languages
    stamp = hash((model.langs, model.pieces, model.probs.tobytes()))
    rest = [k for k in keep if k != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("language")
        if stamp not in _SCORES:
            _SCORES.clear()
            _SCORES[stamp] = WordScores(sent.value)
        scores, langs = _SCORES[stamp], sent.value.langs
        for b in batches:
            lang, best, margin = [], [], []
            texts, n = [], 0

            def flush():
                for s in scores.texts(texts):
                    if not langs or s[-2] == 0:
                        lang.append("und")
                        best.append(0.0)
                        margin.append(None)
                    else:
                        i = int(s[:-3].argmax())
                        lang.append(langs[i])
                        best.append(float(1.0 / np.exp(s[:-3] - s[i]).sum()))
                        margin.append(float((s[i] - s[-3]) / s[-1]))
                texts.clear()

            for t in b.column(2):
                texts.append(t.as_py() or "")
                n += len(texts[-1])
                if n >= SLICE_CHARS:
                    flush()
                    n = 0
            if texts:
                flush()
            kept = [b.column(2) if k == text else b.column(3 + rest.index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(best, pa.float64()),
                 pa.array(margin, pa.float64()), *kept], names=["doc_id", "held_out", "lang_pred", "score", "margin", *keep])

    rows = docs.select(F.col(key).cast("long").alias("__key"), in_fold(key).alias("__held"),
                       F.col(text).alias("__text"), *[F.col(f"`{k}`") for k in rest])
    kinds = dict(docs.dtypes)
    out = "doc_id long, held_out boolean, lang_pred string, score double, margin double" + \
        "".join(f", `{k}` {kinds[k]}" for k in keep)
    return rows.mapInArrow(run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs, public_tokenizers.path("piece_bpe_32k.model")))
