"""Token counts by a compiled finite-state transducer.

The byte-level BPE of a public tokenizer file is compiled, lazily, into a
deterministic transducer.  A token sequence is the library's output exactly when
every token encodes to itself and every adjacent pair of tokens encodes to that
pair, so valid tokenisations form a local language over bytes.  A state is the
set of hypotheses (last finished token, trie node of the unfinished one, tokens
owed); a transition emits as many tokens as all hypotheses have in common, and
the final state pays what is still owed.

Texts are read in chunks.  A chunk's state map is ``(head, mid, tail)``: the
text before its first certain pre-token boundary, the tokens between its first
and last one, and the text after the last one; a chunk without a boundary is all
head.  Maps compose associatively, so a text is a tree reduction over its chunks
wherever the cuts fall.  Every text is handled inside its own task: no shuffle.

Null text counts as empty: 0 bytes, 0 tokens, not over the limit.  Repeated rows
give repeated results; an empty table an empty one; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltab.llm.common import claim, table, worker_cache

#: Fixed pre-token pattern of the byte-level tokenizer family.
PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Marks that are a pre-token of one token after a word.
ENDS = frozenset(".,;:!?)")
#: White space as the tokenizer sees it; the class of a certain boundary's left side.
SPACE = regex.compile(r"\s")
CHUNK_CHARS = 1 << 16
#: Compiled states kept per worker; beyond it the transducer is compiled anew.
MAX_STATES = 250_000
#: Remembered words per generation: words seen again move to the new generation.
MAX_WORDS = 250_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class CountTransducer:
    """Deterministic transducer whose total output on the bytes of one pre-token
    is its number of BPE tokens."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") or model.get("byte_fallback"):
            raise ValueError("only plain byte-level BPE files can be compiled")
        letters = _byte_letters()
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"]
               if all(c in letters for c in t)}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.ranks[raw[a], raw[b]] = r
            self.made.setdefault(raw[a] + raw[b], (r, raw[a], raw[b]))
        self.specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[bytes | None] = [None]
        for tok in set(raw.values()):
            if len(tok) == 1 or self.encode(tok) == [tok]:
                n = 0
                for b in tok:
                    n2 = self.children[n].get(b)
                    if n2 is None:
                        n2 = self.children[n][b] = len(self.children)
                        self.children.append({})
                        self.token_at.append(None)
                    n = n2
                self.token_at[n] = tok
        self.pairs: dict[tuple[bytes | None, bytes], bool] = {}
        self.reset()

    def encode(self, word: bytes) -> list[bytes]:
        """Merge the lowest-ranked adjacent pair until none is left."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1),
                       key=lambda i: self.ranks.get((parts[i], parts[i + 1]), 1 << 60))
            pair = parts[best], parts[best + 1]
            if pair not in self.ranks:
                break
            i, out = 0, []
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.hyps: list[tuple] = []
        self.next: list[dict[int, tuple[int, int]]] = []
        self.owed: list[int] = []
        self.start = self._state(((None, 0, 0),))

    def _state(self, hyps: tuple) -> int:
        s = self.states.get(hyps)
        if s is None:
            s = self.states[hyps] = len(self.hyps)
            self.hyps.append(hyps)
            self.next.append({})
            self.owed.append(next((k for _, node, k in hyps if node == 0), -1))
        return s

    def _fits(self, left: bytes | None, right: bytes) -> bool:
        if left is None:
            return True
        ok = self.pairs.get((left, right))
        if ok is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            ok = self.pairs[left, right] = self._stays(left, right)
        return ok

    def _stays(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens that each encode to themselves stay apart.  Undoing
        the later merge at the border again and again shows every two pieces that
        ever met there; they must not have merged before one was used up (by equal
        ranks the leftmost pair merges first)."""
        never = 1 << 60
        used_left = used_right = never
        while True:
            r = self.ranks.get((left, right), never)
            if r < used_left and (r <= used_right and r < never):
                return False
            a, b = self.made.get(left), self.made.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                used_left, left = a[0], a[2]
            else:
                used_right, right = b[0], b[1]

    def _compile(self, s: int, byte: int) -> tuple[int, int]:
        children, token_at = self.children, self.token_at
        out, done, emit = [], None, 1 << 60
        for last, node, owed in self.hyps[s]:
            n = children[node].get(byte)
            if n is None:
                continue
            if children[n]:
                out.append((last, n, owed))
                if owed < emit:
                    emit = owed
            if done is None:
                tok = token_at[n]
                if tok is not None and self._fits(last, tok):
                    done = tok
                    ended = owed + 1
        if done is not None:
            out.append((done, 0, ended))
            if ended < emit:
                emit = ended
        if emit:
            out = [(a, n, k - emit) for a, n, k in out]
        t = self.next[s][byte] = self._state(tuple(out)), emit
        return t

    def count(self, word: bytes) -> int:
        if len(self.hyps) > MAX_STATES:
            self.reset()
        s, n, nxt = self.start, 0, self.next
        for b in word:
            t = nxt[s].get(b)
            if t is None:
                t = self._compile(s, b)
            s = t[0]
            n += t[1]
        return n + max(self.owed[s], 0)


class TextCounter(dict):
    """Counts whole texts; as a dict, remembers the tokens of ``' ' + word`` (None
    where the word ends in white space, so that its right side is not certain)."""

    def __init__(self, path: str):
        super().__init__()
        self.fst = CountTransducer(path)
        self.old: dict[str, int | None] = {}
        self.special = regex.compile("|".join(map(regex.escape, self.fst.specials)) or r"(?!)")

    def segment(self, text: str) -> int:
        """Tokens of a text between two certain boundaries."""
        n, at = 0, 0
        for m in self.special.finditer(text) if any(x in text for x in self.fst.specials) else ():
            n += self._plain(text[at:m.start()]) + 1
            at = m.end()
        return n + self._plain(text[at:])

    def _plain(self, text: str) -> int:
        count = self.fst.count
        return sum(count(w.encode()) for w in PRETOKEN.findall(text))

    def __missing__(self, word: str) -> int | None:
        if len(self) > MAX_WORDS:
            self.old = dict(self)
            self.clear()
        if word in self.old:
            n = self.old[word]
        elif word.isalpha():   # one pre-token
            n = self.fst.count(b" " + word.encode())
        elif not word or SPACE.match(word[-1]):
            n = None
        elif word[-1] in ENDS and word[:-1].isalpha():   # two, the second one byte
            n = self[word[:-1]] + 1
        else:
            n = self.segment(" " + word)
        self[word] = n
        return n

    def chunk_map(self, chunk: str) -> tuple[str, int, str | None]:
        """``(head, mid, tail)``; tail None: no certain boundary inside."""
        words = chunk.split(" ")
        ends = lambda w: w and not SPACE.match(w[-1])
        first = next((i for i in range(1, len(words)) if ends(words[i - 1])), None)
        if first is None:
            return chunk, 0, None
        last = next(i for i in range(len(words) - 1, 0, -1) if ends(words[i - 1]))
        try:
            mid = sum(map(self.__getitem__, words[first:last]))
        except TypeError:   # runs of white space: join what has no certain boundary between
            mid, open_ = 0, ""
            for w in words[first:last]:
                if not open_ and (n := self[w]) is not None:
                    mid += n
                    continue
                open_ += " " + w
                if ends(w):
                    mid, open_ = mid + self.segment(open_), ""
        return " ".join(words[:first]), mid, " " + " ".join(words[last:])

    def compose(self, a, b):
        if a[2] is None:
            return (a[0] + b[0], b[1], b[2]) if b[2] is not None else (a[0] + b[0], 0, None)
        if b[2] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self._join(a[2], b[0]) + b[1], b[2]

    def _join(self, tail: str, head: str) -> int:
        h, m, t = self.chunk_map(tail + head)
        return self.segment(h) + m + (self.segment(t) if t else 0)

    def count(self, text: str, chunk_chars: int = CHUNK_CHARS) -> int:
        maps = [self.chunk_map(text[i:i + chunk_chars])
                for i in range(0, max(len(text), 1), chunk_chars)]
        while len(maps) > 1:   # the levels of the scan tree
            maps = [self.compose(maps[i], maps[i + 1]) if i + 1 < len(maps) else maps[i]
                    for i in range(0, len(maps), 2)]
        head, mid, tail = maps[0]
        return self.segment(head) + mid + (self.segment(tail) if tail else 0)


_COUNTERS: dict[str, TextCounter] = worker_cache("counts")


def _counter(path: str) -> TextCounter:
    claim("counts")
    if path not in _COUNTERS:
        _COUNTERS[path] = TextCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, key: str = "doc_id",
                 text: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row.  ``tokenizer`` is the path
    of a byte-level BPE file, present on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = _counter(tokenizer)
        for b in batches:
            n = [c.count(t.as_py(), chunk_chars) if t.is_valid else 0 for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"),
                       F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
                       F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
