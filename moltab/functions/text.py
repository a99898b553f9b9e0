"""Tokeniser patterns and hashing of string features.

Patterns use the subset of regular-expression syntax that Java and RE2 read
alike (no look-around, no back-references), so Spark and DuckDB tokenise the
same way.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokeniser patterns.
# SMILES-like: bracket atoms, two-letter halogens, one-letter atoms (aliphatic
# and aromatic), bond / branch / charge symbols, two-digit and one-digit ring labels.
SMILES_PATTERN = r"\[[^\]]+\]|Br|Cl|[BCNOPSFIbcnops]|[=#$/\\()+.~:@*-]|%[0-9]{2}|[0-9]"
# Words: runs of letters and digits.
WORD_PATTERN = r"[A-Za-z0-9]+"


def tokens(text: str | Column, pattern: str = SMILES_PATTERN) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(c, F.lit(pattern), 0)


def bucket_of(s: Column, n_bits: int) -> Column:
    """md5-based hash of a string into ``[0, n_bits)`` as INT (reproducible in SQL)."""
    return (F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint") % F.lit(int(n_bits))).cast("int")


def sql_bucket_of(expr: str, n_bits: int) -> str:
    return f"CAST(CAST(('0x' || substr(md5({expr}), 1, 8)) AS BIGINT) % {int(n_bits)} AS INTEGER)"
