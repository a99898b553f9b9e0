"""Sharding by jump consistent hashing (native).

A shard is a pure function of the stable key and the shard count: the published
jump hash (a 64-bit linear congruential sequence seeded with the key decides at
which shard counts the key jumps to the newest shard).  No ring table exists;
with one more shard exactly the keys that jump land in the new shard and nobody
else moves.  The law that holds is ``key``.

Null key: treated as 0.  Null text: size 16, crc of the empty string.
Repeated rows get the same shard and different slots.  An empty table gives an
empty result; other input columns are ignored, so they cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moltab.llm.common import table, tmp

#: Multiplier of the published generator, as two 32-bit halves.
LCG_HI, LCG_LO = 0x27BB2EE6, 0x87B0B0FD
MASK = 0xFFFFFFFF
#: Steps tried first; keys that need more (well under 1 in 1,000) take the rest.
FIRST_STEPS = 12


def _mul32(a: Column, c: int) -> tuple[Column, Column]:
    """``a * c`` for unsigned 32-bit values as (carry, low 32 bits), without the
    64-bit overflow that ANSI mode rejects."""
    t0, t1 = a.bitwiseAND(0xFFFF) * F.lit(c), F.shiftright(a, 16) * F.lit(c)
    s = t0 + F.shiftleft(t1.bitwiseAND(0xFFFF), 16)
    return F.shiftright(s, 32) + F.shiftright(t1, 16), s.bitwiseAND(MASK)


def _step(s: Column, n: int) -> Column:
    carry, low = _mul32(s["l"], LCG_LO)
    hi = carry + _mul32(s["l"], LCG_HI)[1] + _mul32(s["h"], LCG_LO)[1]
    low1 = low + F.lit(1)
    h = (hi + F.shiftright(low1, 32)).bitwiseAND(MASK)
    jump = F.floor((s["j"] + 1).cast("double")
                   * (F.lit(2147483648.0) / (F.shiftright(h, 1) + 1).cast("double"))).cast("long")
    return F.when(s["j"] < n, F.struct(s["j"].alias("b"), jump.alias("j"), h.alias("h"),
                                       low1.bitwiseAND(MASK).alias("l"))).otherwise(s)


def jump_state(key: Column, n: int) -> Column:
    """Struct whose ``b`` is the shard of ``key`` among ``n`` and ``j`` the next
    shard it would jump to."""
    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"),
                     F.shiftrightunsigned(key, 32).alias("h"), key.bitwiseAND(MASK).alias("l"))
    first = min(n, FIRST_STEPS)
    s = F.aggregate(F.sequence(F.lit(1), F.lit(first)), start, lambda a, _: _step(a, n))
    if n > first:   # each step moves to a larger shard, so n steps always suffice
        s = F.transform(F.array(s), lambda a: F.when(
            a["j"] < n, F.aggregate(F.sequence(F.lit(first + 1), F.lit(n)), a,
                                    lambda b, _: _step(b, n))).otherwise(a))[0]
    return s


def shard_documents(docs: DataFrame, n_shards: int = 40, key: str = "doc_id",
                    text: str = "text", rows_per_slice: int = 50_000) -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Slots number the rows of a shard by ``md5(key)``.  A shard is cut into slices
    of the md5 range (about ``rows_per_slice`` rows each); rows are numbered
    inside a slice and the exact counts of the lower slices are added, so no task
    has to sort a whole shard.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    body = F.coalesce(F.col(text), F.lit(""))
    slices = max(64, math.ceil(docs.count() / (n_shards * rows_per_slice)))

    def placed(d: DataFrame) -> DataFrame:
        d = d.withColumn("order_key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
                                            .cast("binary")))
        d = d.withColumn("state", jump_state(F.coalesce("doc_id", F.lit(0).cast("long")), n_shards))
        part = F.conv(F.substring("order_key", 1, 8), 16, 10).cast("long")
        return (d.withColumn("shard", F.col("state.b").cast("int"))
                .withColumn("grown_shard", F.when(F.col("state.j") == n_shards, F.lit(n_shards))
                            .otherwise(F.col("state.b")).cast("int"))
                .withColumn("slice", F.shiftright(part * slices, 32)).drop("state"))

    rows = placed(docs.select(F.col(key).cast("long").alias("doc_id"),
                              (F.octet_length(body) + 16).cast("long").alias("size"),
                              F.crc32(body.cast("binary")).alias("text_crc32")))
    counts = placed(docs.select(F.col(key).cast("long").alias("doc_id"))) \
        .groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window as W
    before = W.partitionBy("shard").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("shard", "slice",
                         F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("shard", "slice").orderBy("order_key", "doc_id", "size", "text_crc32")
    return (rows.withColumn("rn", F.row_number().over(inside))
            .join(base, ["shard", "slice"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("base") + F.col("rn") - 1).cast("long").alias("slot"), "grown_shard"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str, key: str = "doc_id") -> str:
    """Write the documents, null keys among them, as one folder per shard (``shard=K/``).
    Returns the folder column's name, which has leading underscores if ``docs`` has a
    column of that name."""
    name = "shard"
    while name in {c.lower() for c in docs.columns}:
        name = "_" + name
    k, zero = tmp("key"), F.lit(0).cast("long")
    at = placed.select(F.coalesce("doc_id", zero).alias(k), F.col("shard").alias(name)).distinct()
    docs.withColumn(k, F.coalesce(F.col(key).cast("long"), zero)).join(at, k).drop(k) \
        .write.partitionBy(name).parquet(path)
    return name


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
jump AS (
  SELECT DISTINCT doc_id, doc_id::HUGEINT AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM documents
  UNION ALL
  SELECT doc_id, k2, j, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 >> 33) + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, b, j, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2
        FROM jump WHERE j < 40)),
ended AS (
  SELECT doc_id, max(b) AS b, max(j) AS j FROM jump GROUP BY doc_id),
bytes AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
rows_ AS (
  SELECT d.doc_id, (octet_length(encode(coalesce(d.text, ''))) + 16)::BIGINT AS size,
    (SELECT xor(list_reduce(list_prepend(4294967295::BIGINT,
              list_transform(range(octet_length(encode(coalesce(d.text, '')))),
                             lambda p: ('0x' || hex(encode(coalesce(d.text, '')))[2*p+1:2*p+2])::BIGINT)),
              lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) FROM crc_table) AS text_crc32,
    e.b, e.j
  FROM documents d JOIN ended e USING (doc_id))
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'key' AS law, b::INT AS shard,
  (row_number() OVER (PARTITION BY b ORDER BY md5(doc_id::VARCHAR), doc_id) - 1)::BIGINT AS slot,
  (CASE WHEN j = 40 THEN 40 ELSE b END)::INT AS grown_shard
FROM rows_
"""
