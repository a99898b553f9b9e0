"""License scan: exact phrases plus fuzzy search for short notices.

A notice that occurs with at most ``k`` edits contains one of ``k + 1`` disjoint
parts of itself unchanged (pigeonhole).  One automaton over the parts of all
notices finds those seeds in the normalised text; every seed opens a window in
which the ``regex`` library's bounded-error matching decides and reports the
span and the number of edits.  Nothing is shuffled.

Normalised text: ASCII letters in lower case, words joined by one space.
Null text counts as empty: no words, no labels, score 0.  Repeated rows give
repeated results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltab.llm.common import table

#: Exact phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Short notices searched with errors (label, notice in normalised form).
NOTICES = [
    ("near-gpl", "licensed under the gnu general public license"),
    ("near-gpl", "under the terms of the gnu general public license as published by the free software foundation"),
    ("near-lgpl", "under the terms of the gnu lesser general public license"),
    ("near-apache", "licensed under the apache license version 2 0"),
    ("near-mit", "released under the mit license"),
    ("near-mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("near-cc-by", "licensed under cc by nc 4 0"),
    ("near-cc-by", "licensed under a creative commons attribution"),
    ("near-bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("near-mpl", "subject to the terms of the mozilla public license"),
]
#: One edit is allowed for so many characters of a notice: seeds are then at least
#: ten characters long, which ordinary prose seldom holds by chance.
CHARS_PER_EDIT = 14

SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
          "base_labels string, labels string, score double, "
          "spans array<struct<label:string,first_word:long,last_word:long,edits:int>>")

#: Bytes outside words become spaces, A-Z their lower case.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256))


class NoticeIndex:
    """Seed automaton and error-bounded patterns of a list of notices."""

    def __init__(self, notices: list[tuple[str, str]], chars_per_edit: int = CHARS_PER_EDIT):
        self.notices = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (label, text) in enumerate(notices):
            k = max(1, len(text) // chars_per_edit)
            pattern = regex.compile(rf"(?b)(?:{regex.escape(text)}){{e<={k}}}")
            self.notices.append((label, text, k, pattern))
            step, more, at = len(text) // (k + 1), len(text) % (k + 1), 0
            for i in range(k + 1):
                size = step + (i < more)
                seeds.setdefault(text[at:at + size], []).append((n, at))
                at += size
        self.automaton = ahocorasick.Automaton()
        for part, where in seeds.items():
            self.automaton.add_word(part, (len(part), where))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """``(label, start, end, edits, notice length)`` of the best match of every
        stretch of overlapping windows of a notice."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, where) in self.automaton.iter(text):
            start = end - size + 1
            for n, at in where:
                _, notice, k, _ = self.notices[n]
                a = max(0, start - at - k)
                b = min(len(text), start - at + len(notice) + k)
                own = windows.setdefault(n, [])
                # windows of one notice arrive by seed end; joined only where they
                # are about one occurrence, so a window stays short
                if not (own and a <= own[-1][0] + 2 * k and b <= own[-1][1] + 2 * k):
                    own.append([a, b])
                else:
                    own[-1] = [min(own[-1][0], a), max(own[-1][1], b)]
        found = set()
        for n, own in windows.items():
            label, notice, _, pattern = self.notices[n]
            for a, b in own:
                for m in pattern.finditer(text, a, b):
                    found.add((n, label, m.start(), m.end(), sum(m.fuzzy_counts), len(notice)))
        best: list[tuple] = []
        for f in sorted(found, key=lambda f: (f[0], f[2], f[3])):
            if best and best[-1][0] == f[0] and f[2] < best[-1][3]:
                if (f[4], f[2]) < (best[-1][4], best[-1][2]):
                    best[-1] = f
            else:
                best.append(f)
        return [f[1:] for f in best]


def scan_text(text: str | None, phrases: dict[bytes, str], index: NoticeIndex) -> tuple:
    words = (text or "").encode().translate(_WORD_BYTES).split(b" ")
    words = [w for w in words if w]
    line = b" ".join(words)
    padded = b" " + line + b" "
    places, base = [], set()
    for phrase, label in phrases.items():
        at = padded.find(phrase)
        while at >= 0:
            places.append(padded.count(b" ", 0, at + 1) - 1)
            base.add(label)
            at = padded.find(phrase, at + 1)
    plain = line.decode()
    spans = []
    for label, a, b, edits, size in index.find(plain):
        spans.append((label, plain.count(" ", 0, a), plain.count(" ", 0, max(a, b - 1)), edits,
                      1.0 - edits / size))
    labels = base | {s[0] for s in spans}
    score = 1.0 if base else max((s[4] for s in spans), default=0.0)
    return (len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base)), ",".join(sorted(labels)), score,
            [{"label": s[0], "first_word": s[1], "last_word": s[2], "edits": s[3]} for s in sorted(spans)])


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None,
                  notices: list[tuple[str, str]] | None = None, key: str = "doc_id",
                  text: str = "text") -> DataFrame:
    """One row per input row (columns of ``SCHEMA``); ``spans`` are the fuzzy matches
    in words of the normalised text, with their edits."""
    exact = {b" " + p.encode() + b" ": label for p, label in (phrases or PHRASES).items()}
    listed = NOTICES if notices is None else notices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = NoticeIndex(listed)
        kinds = _schema()
        for b in batches:
            rows = [scan_text(t.as_py(), exact, index) for t in b.column(1)]
            cols = [list(c) for c in zip(*rows)] if rows else [[] for _ in range(8)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, kinds.field(i + 1).type) for i, c in enumerate(cols))],
                schema=kinds)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")) \
        .mapInArrow(run, SCHEMA)


def _schema() -> pa.Schema:
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()),
                      ("last_word", pa.int64()), ("edits", pa.int32())])
    return pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()),
                      ("first_word", pa.int64()), ("last_word", pa.int64()),
                      ("base_labels", pa.string()), ("labels", pa.string()),
                      ("score", pa.float64()), ("spans", pa.list_(span))])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
