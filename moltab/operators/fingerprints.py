"""String → feature-id fingerprints and pattern membership.

Tokens are cut by an expression; the features of hashed fingerprints are formed and hashed in
Arrow batches, where a feature costs a fraction of an interpreted lambda.  No explode
and no shuffle.  Feature ids are ``md5(feature text)`` folded into ``n_bits``,
so a fingerprint is reproducible in SQL.  The whole text is processed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moltab.functions.text import SMILES_PATTERN, tokens
from moltab.session import importable

# A small fragment dictionary for SMILES-like strings
# (key, pattern, min_count, label).  Bit k is set when the pattern occurs more
# than min_count times.  Pattern '?' marks an undefined key (always 0).
FRAGMENT_KEYS = [
    (1, "?", 0, "undefined"),
    (2, "N", 0, "nitrogen"),
    (3, "O", 0, "oxygen"),
    (4, "S", 0, "sulfur"),
    (5, "F|Cl|Br|I", 0, "halogen"),
    (6, "C=O", 0, "carbonyl"),
    (7, "C#N", 0, "nitrile"),
    (8, "c1ccccc1", 0, "benzene ring"),
    (9, "N=C=S|NC\\(=S\\)N", 0, "thiourea-like"),
    (10, "O", 1, "two or more oxygens"),
    (11, "N", 1, "two or more nitrogens"),
    (12, "\\[[^\\]]*[+-]\\]", 0, "charged atom"),
    (13, "[0-9]", 1, "ring closure"),
    (14, "\\(", 2, "three or more branches"),
]


def tokenize(df: DataFrame, text: str, pattern: str = SMILES_PATTERN, out: str = "tokens") -> DataFrame:
    return df.withColumn(out, tokens(text, pattern))


#: Rows whose tokens are Python objects at a time.
ROWS = 256


def _ngrams(tok: list[str], n_max: int) -> list[str]:
    """All contiguous runs of 1..n_max tokens, joined by a space."""
    out, runs = list(tok), tok
    for n in range(1, n_max):
        runs = [f"{a} {b}" for a, b in zip(runs, tok[n:])]
        out += runs
    return out


def _buckets(feats: Sequence[str], n_bits: int) -> np.ndarray:
    """``bucket_of`` for many features: the first 32 bits of the md5, folded."""
    digests = b"".join([md5(f.encode()).digest() for f in feats])
    return np.frombuffer(digests, dtype=">u4")[::4].astype(np.int64) % n_bits


def _hashed(df: DataFrame, key: str, text: str, pattern: str, features: Callable[[list[str]], list[str]],
            n_bits: int, out: str, counts: bool = False) -> DataFrame:
    """``(key, out)``: sorted on-bits, or bucket and number of features in it, of the features
    of each row's tokens.  A feature that repeats in a row is hashed once."""
    importable(df.sparkSession)
    rows = _with_tokens(df, key, text, pattern)
    kind = T.MapType(T.IntegerType(), T.LongType()) if counts else T.ArrayType(T.IntegerType())
    n_bits = int(n_bits)

    def one(tok: list[str]) -> tuple[np.ndarray, np.ndarray | None]:
        if not counts:
            return np.unique(_buckets(list(set(features(tok))), n_bits)), None
        found = Counter(features(tok))
        on, at = np.unique(_buckets(list(found), n_bits), return_inverse=True)
        n = np.zeros(len(on), dtype=np.int64)
        np.add.at(n, at, np.fromiter(found.values(), dtype=np.int64, count=len(found)))
        return on, n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                part = b.slice(lo, ROWS)
                tok = part.column(1)
                flat = tok.flatten().to_pylist()
                ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(tok), 0)))
                done = [one(flat[x:y]) for x, y in zip([0, *ends[:-1]], ends)]
                at = pa.array(np.cumsum([0, *(len(on) for on, _ in done)]), pa.int32())
                on = pa.array(np.concatenate([on for on, _ in done]), pa.int32())
                made = pa.MapArray.from_arrays(at, on, pa.array(np.concatenate([n for _, n in done]), pa.int64())) \
                    if counts else pa.ListArray.from_arrays(at, on)
                yield pa.RecordBatch.from_arrays([part.column(0), made], names=[key, out])

    schema = T.StructType([rows.schema.fields[0], T.StructField(out, kind)])
    return rows.mapInArrow(run, schema)


def _with_tokens(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Tokenise once into ``_tok``."""
    return df.select(key, tokens(text, pattern).alias("_tok"))


def ngram_fp(df: DataFrame, key: str, text: str, n_max: int = 3, n_bits: int = 1024,
             pattern: str = SMILES_PATTERN, out: str = "bits") -> DataFrame:
    """Token n-grams of length 1..n_max hashed into ``n_bits``: ``(key, bits ARRAY<INT>)``
    (sorted on-bits).  ``n_max = radius + 1`` for a circular-fingerprint analogue."""
    return _hashed(df, key, text, pattern, lambda tok: _ngrams(tok, n_max), n_bits, out)


def ngram_counts(df: DataFrame, key: str, text: str, n_max: int = 3, n_bits: int = 1024,
                 pattern: str = SMILES_PATTERN) -> DataFrame:
    """Count fingerprint in long form ``(key, bit, count)``: one row per non-zero entry."""
    per_row = _hashed(df, key, text, pattern, lambda tok: _ngrams(tok, n_max), n_bits, "_counts", counts=True)
    return per_row.select(key, F.explode("_counts").alias("bit", "count")) \
        .groupBy(key, "bit").agg(F.sum("count").alias("count"))


def ngram_count_map(df: DataFrame, key: str, text: str, n_max: int = 3, n_bits: int = 1024,
                    pattern: str = SMILES_PATTERN, out: str = "counts") -> DataFrame:
    """Count form of :func:`ngram_fp`: ``(key, counts)``; a null text has a null map."""
    return _hashed(df, key, text, pattern, lambda tok: _ngrams(tok, n_max), n_bits, out, counts=True)


def fp_nonzero(counts_long: DataFrame, key: str) -> DataFrame:
    """``GetNonzeroElements``: ``(key, counts MAP<INT, BIGINT>)``."""
    return counts_long.groupBy(key).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("bit", "count")))).alias("counts"))


def _pairs(tok: list[str], max_distance: int) -> list[str]:
    return [f"{a}|{b}|{d}" if a <= b else f"{b}|{a}|{d}"
            for d in range(1, max_distance + 1) for a, b in zip(tok, tok[d:])]


def _paths(tok: list[str], length: int) -> list[str]:
    runs = [tok[i:i + length] for i in range(len(tok) - length + 1)]
    return [min(" ".join(r), " ".join(r[::-1])) for r in runs]


def pair_fp(df: DataFrame, key: str, text: str, max_distance: int = 3, n_bits: int = 1024,
            pattern: str = SMILES_PATTERN, out: str = "bits") -> DataFrame:
    """Atom-pair analogue: every (token_i, token_j, j − i) with 0 < j − i ≤ max_distance,
    order-insensitive in the two tokens, hashed into ``n_bits``."""
    return _hashed(df, key, text, pattern, lambda tok: _pairs(tok, max_distance), n_bits, out)


def pair_counts(df: DataFrame, key: str, text: str, max_distance: int = 3, n_bits: int = 1024,
                pattern: str = SMILES_PATTERN, out: str = "counts") -> DataFrame:
    """Count form of :func:`pair_fp`: ``(key, counts MAP<INT, BIGINT>)``."""
    return _hashed(df, key, text, pattern, lambda tok: _pairs(tok, max_distance), n_bits, out, counts=True)


def path_fp(df: DataFrame, key: str, text: str, length: int = 4, n_bits: int = 1024,
            pattern: str = SMILES_PATTERN, out: str = "bits") -> DataFrame:
    """Torsion analogue: paths of ``length`` consecutive tokens, direction-insensitive
    (the smaller of the path text and its reverse), hashed into ``n_bits``."""
    return _hashed(df, key, text, pattern, lambda tok: _paths(tok, length), n_bits, out)


def path_counts(df: DataFrame, key: str, text: str, length: int = 4, n_bits: int = 1024,
                pattern: str = SMILES_PATTERN, out: str = "counts") -> DataFrame:
    """Count form of :func:`path_fp`: ``(key, counts MAP<INT, BIGINT>)``."""
    return _hashed(df, key, text, pattern, lambda tok: _paths(tok, length), n_bits, out, counts=True)


def pattern_fp(df: DataFrame, key: str, text: str, dictionary: Sequence[tuple] = FRAGMENT_KEYS,
               out: str = "bits") -> DataFrame:
    """Dictionary fingerprint: on-bits ``k`` whose pattern occurs more than ``min_count`` times.

    The dictionary is a fixed literal list (like a key table), so it becomes one
    projection with one pattern test per key: no join, no shuffle.
    """
    t = F.col(text)
    # one occurrence is enough where the count does not matter: stop at the first
    hit = lambda p, mc: t.rlike(p) if int(mc) == 0 else F.regexp_count(t, F.lit(p)) > F.lit(int(mc))
    flags = [F.when(hit(p, mc), F.lit(int(k))) for k, p, mc, *_ in dictionary if p != "?"]
    return df.select(key, F.filter(F.array(*flags), lambda x: x.isNotNull()).alias(out))


def pattern_onehot(df: DataFrame, text: str, patterns: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """One 0/1 column per named pattern (substructure one-hot columns)."""
    t = F.col(text)
    return df.select(*keep, *[t.rlike(p).cast("int").alias(name) for name, p in patterns.items()])


def fp_to_columns(df: DataFrame, key: str, bits: str = "bits", n_bits: int = 1024,
                  prefix: str = "fp_") -> DataFrame:
    """Dense 0/1 columns ``fp_0..fp_{n-1}`` (a projection, no pivot shuffle)."""
    b = F.col(bits)
    return df.select(key, *[F.array_contains(b, F.lit(k)).cast("int").alias(f"{prefix}{k}")
                            for k in range(n_bits)])


def fp_to_vector(df: DataFrame, bits: str = "bits", n_bits: int = 1024, out: str = "features") -> DataFrame:
    """MLlib vector from on-bits for model training (JVM-side, no Python UDF)."""
    from pyspark.ml.functions import array_to_vector

    b = F.col(bits)
    dense = F.transform(F.sequence(F.lit(0), F.lit(n_bits - 1)),
                        lambda k: F.when(F.array_contains(b, k), F.lit(1.0)).otherwise(F.lit(0.0)))
    return df.withColumn(out, array_to_vector(dense))


def bits_to_text(bits: str | Column, n_bits: int) -> Column:
    """'0101…' of length ``n_bits``."""
    b = F.col(bits) if isinstance(bits, str) else bits
    none = F.lit("0" * n_bits)
    # the bits stand outside of the lambda: there their expression would be run per position
    on = F.filter(b, lambda k: (k >= 0) & (k < n_bits))
    return F.coalesce(F.aggregate(on, none, lambda acc, k: F.overlay(acc, F.lit("1"), k.cast("int") + 1, F.lit(1))), none)


def has_pattern(text: str | Column, pattern: str) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return c.rlike(pattern).cast("int")


def pattern_match_rows(df: DataFrame, text: str, pattern: str) -> DataFrame:
    return df.where(F.col(text).rlike(pattern))


def pattern_locate(df: DataFrame, text: str, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """Position (1-based, 0 = absent) and text of the first match."""
    t = F.col(text)
    return df.select(*keep, F.regexp_instr(t, F.lit(pattern)).alias("match_pos"),
                     F.regexp_substr(t, F.lit(pattern)).alias("match_text"))
