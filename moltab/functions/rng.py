"""Seeded pseudo-randomness as a pure function of (key, seed, salt).

``u01`` is the first 32 bits of ``md5(key|seed|salt)`` divided by 2^32.  It
does not depend on partitioning or task retries, and the same number comes out
of DuckDB with :func:`sql_u01`, which is how the SQL oracles reproduce random
splits, folds and permutations bit for bit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _parts(parts) -> list[Column]:
    out = []
    for p in parts:
        if isinstance(p, Column):
            out.append(p.cast("string"))
        else:
            out.append(F.lit(str(p)))
    return out


def hash32(*parts) -> Column:
    """Unsigned 32-bit hash (as BIGINT) of the given columns / literals."""
    digest = F.md5(F.concat_ws("|", *_parts(parts)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def u01(*parts) -> Column:
    """Uniform [0, 1) double from the hash of the parts."""
    return hash32(*parts) / F.lit(TWO32)


def sql_hash32(*parts: str) -> str:
    """DuckDB twin of :func:`hash32`; parts are SQL expressions (already text)."""
    inner = ", ".join(parts)
    return f"CAST(('0x' || substr(md5(concat_ws('|', {inner})), 1, 8)) AS BIGINT)"


def sql_u01(*parts: str) -> str:
    return f"({sql_hash32(*parts)} / {TWO32})"


def sql_key(col: str) -> str:
    return f"CAST({col} AS VARCHAR)"


def sql_lit(v) -> str:
    return "'" + str(v).replace("'", "''") + "'"
