"""Sequence packing: vector bin packing with the dot-product heuristic.

A sequence has three limits that hold together: tokens, segments, and
loss-bearing tokens.  A sequence is filled one segment at a time with the open
item whose demand vector has the largest dot product with what is left of the
limits (both scaled by the limits).  When nothing fits and more than
``min_cut`` tokens are free, the longest open item is cut to fill them.

Documents are packed where they were tokenised: each input partition is one
stream with a bounded pool of open items, so nothing is shuffled and no hot key
matters.  Items longer than a sequence are first cut into whole sequences and a
rest.  What is left when a partition ends is closed in sequences whose lengths
are powers of two (which need no padding).  ``sequence_id`` is the partition
number and a running number, both fixed by the input's splits, so a task that
is run again gives the same rows.

Null text counts as empty (one end token).  Repeated rows are separate items.  An
empty table gives an empty result.  Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from struct import Struct, pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltab.llm.common import claim, importable, table, worker_cache

END_ID = 2
#: Words remembered per worker and generation; words seen again move to the new one.
MAX_WORDS = 300_000
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, loss_tokens long, sequence_tokens long")
#: Texts tokenised at a time, in bytes, and words whose ids are laid out at a time.
SLICE_BYTES = 1 << 22
SLICE_WORDS = 1 << 18


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 128
    loss: int = 4096
    #: open items per partition, and the fewest free tokens worth a cut
    pool: int = 2048
    min_cut: int = 32

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss, self.pool, self.min_cut) < 1:
            raise ValueError("limits must be positive")
        if self.min_cut > min(self.tokens, self.loss):
            raise ValueError("min_cut must not exceed the token and loss limits")


class Packer:
    """Packs items ``(payload, n_tokens, n_loss)`` of one stream.

    ``n_loss`` counts the loss-bearing tokens, which stand at the end of the item
    (the answer after a prompt).  ``emit`` rows are ``(payload, start, length,
    loss, sequence, offset, sequence_tokens)``.
    """

    def __init__(self, limits: Limits):
        self.lim = limits
        self.cap = np.array([limits.tokens, 1, limits.loss], dtype=np.float64)
        self.demand = np.zeros((2 * limits.pool, 2), dtype=np.int64)   # tokens, loss; 0: free slot
        self.free = list(range(2 * limits.pool))[::-1]
        self.slots: list[tuple | None] = [None] * (2 * limits.pool)
        self.open = 0
        self.seq = 0

    @staticmethod
    def _loss(item: tuple, start: int, length: int) -> int:
        _, total, loss, base = item
        return max(0, base + start + length - max(base + start, total - loss))

    def add(self, payload, n_tokens: int, n_loss: int) -> Iterator[tuple]:
        """Open an item (whole sequences of a long one leave at once)."""
        item, at = (payload, n_tokens, n_loss, 0), 0
        whole = min(self.lim.tokens, self.lim.loss)
        while n_tokens - at > self.lim.tokens or self._loss(item, at, n_tokens - at) > self.lim.loss:
            n = min(whole, n_tokens - at)
            yield payload, at, n, self._loss(item, at, n), self.seq, 0, n
            self.seq += 1
            at += n
        if at < n_tokens:
            self._put((payload, n_tokens, n_loss, at), n_tokens - at)
        while self.open >= self.lim.pool:
            yield from self._fill()

    def _put(self, item: tuple, n: int) -> None:
        s = self.free.pop()
        self.slots[s] = item
        self.demand[s] = n, self._loss(item, 0, n)
        self.open += 1

    def _take(self, s: int) -> tuple[tuple, int, int]:
        item, (n, loss) = self.slots[s], self.demand[s]
        self.slots[s] = None
        self.demand[s] = 0
        self.free.append(s)
        self.open -= 1
        return item, int(n), int(loss)

    def _fill(self) -> Iterator[tuple]:
        """One sequence."""
        lim, rows = self.lim, []
        left, segs, loss_left = lim.tokens, lim.segments, lim.loss
        size, loss = self.demand[:, 0], self.demand[:, 1]
        while segs and left and self.open:
            fits = (size > 0) & (size <= left) & (loss <= loss_left)
            if fits.any():
                # scaled demand times scaled remaining room; the segment demand is 1
                # for every item and does not change the order
                score = np.where(fits, size * (left / lim.tokens ** 2)
                                 + loss * (loss_left / lim.loss ** 2), -1.0)
                item, n, l = self._take(int(score.argmax()))
            elif min(left, loss_left) >= lim.min_cut:
                # cut the shortest item that is too long
                s = int(np.where(size > 0, size, 1 << 60).argmin())
                item, rest, _ = self._take(s)
                n = min(left, loss_left, rest)
                l = self._loss(item, 0, n)
                if n < rest:
                    self._put((*item[:3], item[3] + n), rest - n)
            else:
                break
            rows.append((item, n, l))
            left, segs, loss_left = left - n, segs - 1, loss_left - l
        yield from self._close(rows)

    def _close(self, rows: list) -> Iterator[tuple]:
        total, at = sum(r[1] for r in rows), 0
        for item, n, l in rows:
            yield item[0], item[3], n, l, self.seq, at, total
            at += n
        self.seq += 1

    def finish(self) -> Iterator[tuple]:
        """Close what is left: full sequences, then powers of two."""
        while self.open and int(self.demand[:, 0].sum()) >= self.lim.tokens:
            yield from self._fill()
        while self.open:
            room = 1 << (min(int(self.demand[:, 0].sum()), self.lim.loss).bit_length() - 1)
            rows, segs = [], self.lim.segments
            while room and segs and self.open:
                s = int(self.demand[:, 0].argmax())
                item, rest, _ = self._take(s)
                n = min(room, rest)
                rows.append((item, n, self._loss(item, 0, n)))
                if n < rest:
                    self._put((*item[:3], item[3] + n), rest - n)
                room, segs = room - n, segs - 1
            yield from self._close(rows)


class WordIds(dict):
    """Ids of texts as little-endian 32-bit bytes.  White space never joins tokens
    of this tokenizer family, so a text's ids are those of its words in turn; of the texts
    given at a time every different word is looked up once.  A word of
    letters is one pre-token: the library's model is asked directly, once for all
    spellings of its case and for what ends in marks (a pre-token of their own); other
    words are encoded by the library when they first occur."""

    def __init__(self, path: str):
        super().__init__()
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.model, self.normal = self.lib.model, self.lib.normalizer
        self.ends: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.roots: dict[str, bytes] = {}
        self.old_roots: dict[str, bytes] = {}

    @staticmethod
    def _ids(ids: list[int]) -> bytes:
        return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else pack(f"<{len(ids)}I", *ids)

    def _letters(self, word: str) -> bytes | None:
        """Ids of a word of letters; None if its normal form is not one."""
        # below the combining marks the normaliser only changes the case
        low = word.lower() if word.isascii() or max(word) < "\u0300" else self.normal.normalize_str(word)
        ids = self.roots.get(low)
        if ids is None and low.isalpha():
            ids = self.old_roots.get(low)
            if ids is None:
                form = low if low.isascii() else low.encode().decode("latin-1").translate(_BYTE_LETTERS)
                ids = self._ids([t.id for t in self.model.tokenize(form)])
            self.roots[low] = ids
        return ids

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MAX_WORDS:
            self.old = dict(self)
            self.clear()
        if len(self.roots) > MAX_WORDS:
            self.old_roots, self.roots = self.roots, {}
        ids = self.old.get(word)
        if ids is None:
            if word.isalpha():
                ids = self._letters(word)
            elif (stem := word.rstrip(_MARKS)).isalpha():
                ids = self._letters(stem)
                ids = ids and ids + self._marks(word[len(stem):])
            if ids is None:
                ids = self._encoded(word)
        self[word] = ids
        return ids

    def _encoded(self, word: str) -> bytes:
        return self._ids(self.lib.encode(word, add_special_tokens=False).ids)

    def _marks(self, marks: str) -> bytes:
        if len(marks) > 4:
            return self._encoded(marks)
        ids = self.ends.get(marks)
        if ids is None:
            if len(self.ends) > MAX_WORDS:
                self.ends.clear()
            ids = self.ends[marks] = self._encoded(marks)
        return ids

    def texts(self, texts: pa.Array) -> Iterator[bytes]:
        words = pc.ascii_split_whitespace(texts)    # a blank and the characters 9 to 13
        coded = words.flatten().dictionary_encode()
        place = coded.indices.to_numpy()
        ids = list(map(self.__getitem__, coded.dictionary.to_pylist()))
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        first = np.cumsum(size) - size
        pool = np.frombuffer(b"".join(ids), dtype="<u4")
        ends = np.concatenate([[0], np.cumsum(size[place])])    # of each word's ids
        out = np.empty(ends[-1], dtype="<u4")
        for at in range(0, len(place), SLICE_WORDS):
            part, stand = place[at:at + SLICE_WORDS], ends[at:at + SLICE_WORDS + 1]
            out[stand[0]:stand[-1]] = pool[np.repeat(first[part] - stand[:-1], size[part])
                                           + np.arange(stand[0], stand[-1])]
        cuts = ends[words.offsets.to_numpy() - words.offsets[0].as_py()] if len(words) else ends
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield out[a:b].tobytes()


#: The printable letter that byte-level vocabularies use for each byte.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
#: ASCII marks; an apostrophe may begin a pre-token with letters.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PACK = [Struct(f"<{n}I").pack for n in range(16)]
_WORDS: dict[str, WordIds] = worker_cache("packing")


def _slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    ends, at = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64), 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        to = min(int(np.searchsorted(ends, before + size)) + 1, len(texts))
        yield at, to
        at = to


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(),
                   key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> DataFrame:
    """One row per piece (columns of ``SCHEMA``); ``tokenizer`` is the path of the
    vocabulary file on every executor.  All tokens of a document but its first
    bear loss."""
    importable(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing")
        words = _WORDS.setdefault(tokenizer, None) or WordIds(tokenizer)
        _WORDS[tokenizer] = words
        packer, base = Packer(limits), TaskContext.get().partitionId() << 36
        out: list[tuple] = []

        def rows(pieces):
            for (doc, ids), start, n, loss, seq, at, total in pieces:
                yield (doc, start, n, zlib.crc32(memoryview(ids)[4 * start:4 * (start + n)]),
                       len(ids) // 4, base + seq, at, loss, total)

        def batch():
            cols = [pa.array(c, pa.int64()) for c in zip(*out)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCHEMA.split(", ")])

        for b in batches:
            docs_of, texts = b.column(0).to_pylist(), pc.fill_null(b.column(1), "")
            for at, to in _slices(texts):
                for doc, ids in zip(docs_of[at:to], words.texts(texts.slice(at, to - at))):
                    ids += end
                    n = len(ids) // 4
                    out.extend(rows(packer.add((doc, ids), n, n - 1)))
                    if len(out) >= 10_000:
                        yield batch()
        out.extend(rows(packer.finish()))
        if out:
            yield batch()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")) \
        .mapInArrow(run, SCHEMA)


def pack_items(items: DataFrame, limits: Limits, id_col: str, tokens_col: str,
               loss_col: str) -> DataFrame:
    """Packing of ready-made items by their token and loss counts: ``item_id, start,
    length, loss_tokens, sequence_id, offset``.  Items with null or non-positive
    token counts are refused."""
    importable(items.sparkSession)
    names = ["item_id", "start", "length", "loss_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base = Packer(limits), TaskContext.get().partitionId() << 36

        def batch(pieces):
            rows = [(p, s, n, l, base + q, o) for p, s, n, l, q, o, _ in pieces]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names=names)

        for b in batches:
            pieces: list[tuple] = []
            for i, n, l in zip(*(c.to_pylist() for c in b.columns)):
                if not n or n < 1 or l is None or not 0 <= l <= n:
                    raise ValueError(f"item {i} has {n} tokens and {l} loss-bearing tokens")
                pieces.extend(packer.add(i, n, l))
            yield batch(pieces)
        yield batch(list(packer.finish()))

    return items.select(F.col(id_col).cast("long"), F.col(tokens_col).cast("long"),
                        F.col(loss_col).cast("long")) \
        .mapInArrow(run, ", ".join(f"{n} long" for n in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
