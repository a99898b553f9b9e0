"""Quality rules: how many documents of a host share a line.

1. Every line is normalised (lower case, digits to 0, runs of white space to one blank)
   and hashed together with its host; a document's text is never shuffled.
2. The distinct documents of every (host, line) are counted.  A line that more than
   ``most_docs`` documents of its host hold is boilerplate and is removed from all of them.
3. A document is rejected as depleted if fewer than ``least_words`` words or less than
   ``least_share`` of its words remain.

Beside that stand the base counts of the whole text; a document that fails them
(``base_failed``) is rejected whatever remains of it.

A line of many documents is one key.  Its count is combined before the shuffle, and where
the removed lines meet the documents again, the hottest lines, of which there can only be
a bounded number, are broadcast, so no task gets a hot line.

A document is an (id, host, text): rows that repeat all three are one document, each with
its own result; different texts under one id are documents of their own, and so is one
with a null id.  A null host is a host of its own.  Null and empty texts have no lines and
no words and fail the base rule.  Lines without a word are never removed.  An empty table
gives an empty result.  Further columns are not read by ``line_rules`` and pass through
``cleaned`` unchanged, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moltab.llm.common import importable, join_hot, staged, table, tmp

#: Words of a window of the base rule.
WINDOW = 5
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\v\f\r"
_DIGITS = re.compile(rb"[0-9]")


@dataclass(frozen=True)
class Rules:
    most_docs: int = 10
    least_words: int = 10
    least_share: float = 0.3


def repeated_words(words: list, size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words found twice or more in the text."""
    if len(words) <= size:
        return 0
    known: dict = {}
    code = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, count=len(words))
    # a window's number, one word at a time; equal numbers are equal windows
    window = code
    for j in range(1, size):
        pair = window[:len(code) - j] * len(known) + code[j:]
        found, window = np.unique(pair, return_inverse=True)
        kinds = len(found)
    if kinds == len(window):
        return 0
    again = np.flatnonzero(np.bincount(window)[window] > 1)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(covered, again, 1)
    np.add.at(covered, again + size, -1)
    return int((np.cumsum(covered) > 0).sum())


def host_tag(host: str | None) -> bytes:
    return b"\0" if host is None else b"\1" + host.encode() + b"\n"


def line_key(tag: bytes, line: str) -> int:
    """Key of a line with at least one word: host and normalised line."""
    low = b" ".join(_DIGITS.sub(b"0", line.lower().encode()).split())
    return xxhash.xxh64_intdigest(tag + low) - (1 << 63)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``."""
    words = text.encode().split()
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.encode().split():
            seen.add(line)
    return (len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)),
            dup, repeated_words(words))


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_LINES = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64())]))


def _doc_key(doc: int | None, tag: bytes, text: str) -> int:
    name = b"" if doc is None else str(doc).encode()
    return xxhash.xxh64_intdigest(name + b"\n" + tag + text.encode()) - (1 << 63)


def _counted(docs: DataFrame, key: str, host: str, text: str) -> DataFrame:
    """``doc_id, doc, <counts>, lines`` per row; ``lines`` has each distinct line's key
    and the words in all its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, counts, lines = [], [], []
            for i, s, t in zip(*(c.to_pylist() for c in batch.columns)):
                t = t or ""
                tag, own = host_tag(s), {}
                for line in t.split("\n"):
                    if n := len(line.encode().split()):
                        h = line_key(tag, line)
                        own[h] = own.get(h, 0) + n
                names.append(_doc_key(i, tag, t))
                counts.append(base_counts(t))
                lines.append([{"h": h, "w": w} for h, w in own.items()])
            cols = list(zip(*counts)) if counts else [[]] * len(_COUNTS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.int64()), *[pa.array(c, pa.int64()) for c in cols],
                 pa.array(lines, _LINES)], names=["doc_id", "doc", *_COUNTS, "lines"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"),
                       F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, doc long, " + ", ".join(f"{c} long" for c in _COUNTS)
        + ", lines array<struct<h: long, w: long>>")


def _removed(rows: DataFrame, rules: Rules) -> DataFrame:
    """``doc, h, w``: the lines that a document loses, with their words."""
    held = rows.select("doc", F.explode("lines").alias("l")).select("doc", "l.h", "l.w")
    # a document counts once, however often its row is repeated
    per_line = held.groupBy("h", "doc").agg(F.max("w").alias("w")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    above = staged(per_line.where(F.col("n") > rules.most_docs), "line-limits")
    places = rows.agg(F.sum(F.size("lines")).alias("n")).first()["n"] or 0
    return join_hot(held, above, ["h"], "n", places)


def line_rules(docs: DataFrame, rules: Rules = Rules(), key: str = "doc_id", host: str = "source",
               text: str = "text") -> DataFrame:
    """Per row: ``doc_id``, the base counts, ``base_failed``, ``n_removed_lines`` (distinct
    lines above the limit), ``words_left`` and ``kept``."""
    importable(docs.sparkSession)
    rows = staged(_counted(docs, key, host, text), "line-rows")
    lost = _removed(rows, rules).groupBy("doc", "h").agg(F.max("w").alias("w")) \
        .groupBy(F.col("doc").alias("d")).agg(F.count(F.lit(1)).alias("lost"), F.sum("w").alias("lost_words"))
    left = F.col("n_words") - F.coalesce("lost_words", F.lit(0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    enough = (left >= rules.least_words) & (left >= rules.least_share * F.col("n_words"))
    return rows.join(lost, F.col("doc") == F.col("d"), "left").select(
        "doc_id", *_COUNTS, failed.alias("base_failed"),
        F.coalesce("lost", F.lit(0)).cast("long").alias("n_removed_lines"), left.cast("long").alias("words_left"),
        (~failed & enough).alias("kept"))


def cleaned(docs: DataFrame, rules: Rules = Rules(), key: str = "doc_id", host: str = "source",
            text: str = "text") -> DataFrame:
    """The documents that stay, with their columns; ``text`` without the removed lines."""
    importable(docs.sparkSession)
    rows = staged(_counted(docs, key, host, text), "line-rows")
    lost = _removed(rows, rules).groupBy("doc").agg(F.collect_set("h").alias("hs"))   # a document's own lines
    mark, drop = tmp("doc"), tmp("drop")

    @F.pandas_udf("long")
    def doc_key(i, s, t):
        import pandas as pd
        return pd.Series([_doc_key(None if pd.isna(a) else int(a), host_tag(b), c or "") for a, b, c in zip(i, s, t)],
                         dtype="int64")

    @F.pandas_udf("string")
    def rest(s, t, hs):
        import pandas as pd
        out = []
        for b, c, gone in zip(s, t, hs):
            if c is None or gone is None:
                out.append(c)
                continue
            tag, bad = host_tag(b), set(gone)
            out.append("\n".join(x for x in c.split("\n") if not x.encode().split() or line_key(tag, x) not in bad))
        return pd.Series(out, dtype=object)

    @F.pandas_udf("boolean")
    def enough(t, left):
        import pandas as pd
        out = []
        for a, b in zip(t, left):
            n, _, _, _, again = base_counts(a or "")
            k = len((b or "").encode().split())
            out.append(n >= 10 and 100 * again <= 20 * n and k >= rules.least_words and k >= rules.least_share * n)
        return pd.Series(out, dtype=bool)

    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = {n: F.col(f"c{i}") for i, n in enumerate(names)}
    body, site = at[text], at[host].cast("string")
    # ids travel as text: a long column with nulls would reach pandas as doubles
    both = plain.withColumn(mark, doc_key(at[key].cast("long").cast("string"), site, body)) \
        .join(lost.select(F.col("doc").alias(mark), F.col("hs").alias(drop)), mark, "left")
    new = tmp("text")
    done = both.withColumn(new, F.when(F.col(drop).isNull(), body).otherwise(rest(site, body, F.col(drop))))
    return done.where(enough(body, F.col(new))).select(
        *[(F.col(new) if n == text else F.col(f"c{i}")).alias(n) for i, n in enumerate(names)])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
line AS (
  SELECT doc_id, source, i, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, source, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM t)),
worded AS (
  SELECT doc_id, source, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
    array_to_string(regexp_extract_all(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[^\x20\x09-\x0D]+'), ' ') AS norm
  FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (
  SELECT doc_id, count(*) AS n_dup_lines FROM (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS k FROM worded) WHERE k > 1 GROUP BY doc_id),
frequent AS (SELECT source, norm FROM worded GROUP BY source, norm HAVING count(DISTINCT doc_id) > 10),
lost AS (
  SELECT doc_id, count(DISTINCT x.norm) AS n, sum(x.n) AS words
  FROM worded x JOIN frequent f ON f.norm = x.norm AND f.source IS NOT DISTINCT FROM x.source GROUP BY doc_id),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
again AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM windows) WHERE k > 1) GROUP BY doc_id),
rows_ AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(again.n, 0)::BIGINT AS n_repeat_words,
    coalesce(lost.n, 0)::BIGINT AS n_removed_lines, (len(ws) - coalesce(lost.words, 0))::BIGINT AS words_left
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN again USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND words_left >= 10 AND words_left >= 0.3 * n_words AS kept
FROM rows_
"""
