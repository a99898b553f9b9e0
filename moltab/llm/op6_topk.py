"""Exact top-k search: columnar branch and bound.

Vectors are quantised to ``floor(256 * x)`` and scored by integer inner product.
Candidates and queries are packed into blocks; each (query block, candidate
block) pair is scored dimension block by dimension block in vertical layout
(dimensions outermost).  After each dimension block a (query, candidate) pair
survives only if its partial score plus the Cauchy-Schwarz bound on the
remaining mass reaches the query's k-th best score known so far; survivors are
compacted.  Each task walks many candidate blocks and keeps a running top k per
query, so only ``k`` rows per query and task are shuffled to the final merge.

The query set is stated (ids divisible by ``every``) and meets the candidates
in blocks.  A task holds one group of query blocks and one lane of candidate blocks, each
of bounded size: a block is shuffled once per group or lane of the other side, in the
smallest integers that hold it, and block pairs are never rows of a table.  Vectors that are null or hold null or non-finite components take no
part; vectors of different lengths never meet (a query sees candidates of its own
length).  Repeated rows are separate candidates and one query; a query does not see
candidates with its own id.  A
component of 2**31 or more after scaling raises, since scores could leave 64 bits.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from moltab.llm.common import table

QUERY_BLOCK = 256
CANDIDATE_BLOCK = 4096
DIM_BLOCK = 8
#: Bytes of the query vectors and of the candidate vectors that a task holds (about).
QUERY_BYTES, LANE_BYTES = 1 << 25, 1 << 26


def _usable(df: DataFrame, key: str, vec: str) -> DataFrame:
    v = F.col(vec)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = df.where(v.isNotNull() & (F.size(v) > 0) & ~bad & F.col(key).isNotNull())
    return ok.select(F.col(key).cast("long").alias("id"), F.transform(
        v, lambda x: F.floor(x.cast("double") * 256)).alias("x"))


def _packed(df: DataFrame, block_rows: int) -> DataFrame:
    """Blocks of vectors of one length: ``dim, ids, data`` (dimension-major, in the smallest
    integers that hold them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[list, list]] = {}

        def packed(dim):
            ids, rows = open_.pop(dim)
            m = np.array(rows, dtype=np.int64)
            most = np.abs(m).max()
            if most >= 1 << 31:
                raise ValueError("a scaled component needs more than 31 bits")
            kind = next(z for z in (np.int8, np.int16, np.int32) if most <= np.iinfo(z).max)
            return (dim, np.array(ids, dtype=np.int64).tobytes(),
                    np.ascontiguousarray(m.T.astype(kind)).tobytes())

        def batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                 pa.array([r[2] for r in rows], pa.binary())], names=["dim", "ids", "data"])

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids, rows = open_.setdefault(len(x), ([], []))
                ids.append(i)
                rows.append(x)
                if len(ids) >= block_rows:
                    yield batch([packed(len(x))])
        if open_:
            yield batch([packed(d) for d in list(open_)])

    return df.mapInArrow(run, "dim int, ids binary, data binary")


def _unpacked(dim: int, ids: pa.Scalar, data: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (dimension-major int64) of a block."""
    ids, data = np.frombuffer(ids.as_buffer(), np.int64), data.as_buffer()
    kind = np.dtype(f"i{len(data) // (dim * len(ids))}")
    return ids, np.frombuffer(data, kind).reshape(dim, -1).astype(np.int64)


def block_scores(q: np.ndarray, c: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int,
                 dim_block: int = DIM_BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Branch and bound of query block ``q`` and candidate block ``c`` (both
    dimension-major).  ``own[i, j]`` marks pairs that must not meet, ``floor[i]`` is
    query i's k-th best score so far (or the smallest integer).  Returns the
    (query, candidate, score) triples that may enter the top k."""
    dims = q.shape[0]
    # remaining mass: norms of the dimensions from each block start on
    rest = lambda m: np.sqrt(np.cumsum((m.astype(np.float64) ** 2)[::-1], axis=0)[::-1])
    rq, rc = rest(q), rest(c)
    part = q[:dim_block].T @ c[:dim_block]
    at = min(dim_block, dims)
    # a first guess of the k-th best from the pairs with the best partial scores
    if c.shape[1] > 4 * k:
        top = np.argpartition(part, -2 * k, axis=1)[:, -2 * k:]
        full = np.einsum("dq,dqk->qk", q, c[:, top])
        hidden = np.take_along_axis(own, top, axis=1)
        full = np.where(hidden, np.iinfo(np.int64).min, full)
        floor = np.maximum(floor, np.sort(full, axis=1)[:, -k])
    bound = part + (rq[at][:, None] * rc[at][None, :] + 1.0 if at < dims else 0.0)
    qi, ci = np.nonzero((bound >= floor[:, None]) & ~own)
    score = part[qi, ci]
    while at < dims:
        to = min(at + dim_block, dims)
        for d in range(at, to):
            score = score + q[d, qi] * c[d, ci]
        at = to
        if at < dims:   # compaction of the surviving pairs
            keep = score + rq[at, qi] * rc[at, ci] + 1.0 >= floor[qi]
            qi, ci, score = qi[keep], ci[keep], score[keep]
    keep = score >= floor[qi]
    return qi[keep], ci[keep], score[keep]


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id",
          vec: str = "embedding", query_block: int = QUERY_BLOCK,
          candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best candidates of every query."""
    spark = vectors.sparkSession
    rows = _usable(vectors, key, vec)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    asks = F.col("id") % every == 0
    size = F.size("x").cast("long") * 8
    of = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"), F.sum(F.when(asks, size)).alias("asked")).first()
    # groups of query blocks, lanes of candidate blocks; more lanes only to occupy all cores,
    # since what a lane has seen bounds what is left of it
    groups = max(1, -(-(of["asked"] or 0) // QUERY_BYTES))
    lanes = max(1, -(-(of["bytes"] or 0) // LANE_BYTES),
                min(-(-of["n"] // candidate_block), -(-spark.sparkContext.defaultParallelism // groups)))
    queries = rows.where(asks).dropDuplicates(["id", "x"])
    qb = _packed(queries.repartition(max(1, parts // 8), "id"), query_block) \
        .withColumn("group", F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")) \
        .withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    # blocks in turn, within a partition and from one partition to the next
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = F.pmod(at + F.spark_partition_id(), F.lit(lanes))
    cb = _packed(rows, candidate_block) \
        .withColumn("lane", dealt.cast("int")) \
        .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(asked: pa.Table, lane: pa.Table) -> pa.Table:
        best: list[list] = []
        if lane.num_rows:
            for dim, ids, data in zip(asked.column("dim").to_pylist(), asked.column("ids"), asked.column("data")):
                q_ids, q = _unpacked(dim, ids, data)
                none = np.empty(0, np.int64)
                best.append([q_ids, q, np.full(len(q_ids), np.iinfo(np.int64).min), (none, none, none)])
        for dim, ids, data in zip(lane.column("dim").to_pylist(), lane.column("ids"), lane.column("data")) if best else ():
            c_ids, c = _unpacked(dim, ids, data)
            for of_block in best:
                q_ids, q, floor, old = of_block
                a, e, s = block_scores(q, c, q_ids[:, None] == c_ids[None, :], floor, k)
                a, e, s = (np.concatenate(x) for x in zip(old, (a, c_ids[e], s)))
                order = np.lexsort((e, -s, a))
                a, e, s = a[order], e[order], s[order]
                starts = np.searchsorted(a, np.arange(len(q_ids)))
                keep = np.arange(len(a)) - starts[a] < k
                a, e, s = a[keep], e[keep], s[keep]
                n = np.bincount(a, minlength=len(q_ids))
                floor = np.full(len(q_ids), np.iinfo(np.int64).min)
                full = n == k
                last = np.cumsum(n) - 1
                floor[full] = s[last[full]]
                of_block[2:] = floor, (a, e, s)
        found = [(q_ids[a], e, s) for q_ids, _, _, (a, e, s) in best] or [(np.empty(0, np.int64),) * 3]
        return pa.table({c: pa.array(np.concatenate(x)) for c, x in zip(("query_id", "vec_id", "score"), zip(*found))})

    found = qb.groupBy("dim", "group", "lane").cogroup(cb.groupBy("dim", "group", "lane")) \
        .applyInArrow(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT a.vec_id AS query_id,
  row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.q, b.q) DESC, b.vec_id)::INT AS rank,
  b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
QUALIFY rank <= 5
"""
