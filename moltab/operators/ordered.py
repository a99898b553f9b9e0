"""Order-dependent primitives that never put a whole table into one task.

A window ``OVER (ORDER BY x)`` without ``PARTITION BY`` runs in a single task.  Here the
rows are range-partitioned once by (group, order, tiebreak), sorted inside the partitions
and summed up there in one streaming pass; what earlier partitions hold of a group is added
afterwards.  Only the one group that a partition's first row continues needs such an
offset, so there are fewer offsets than partitions and they can be broadcast whatever the
data.  Rows that are equal in all these columns are parted by a row number, so a value
that very many rows share is spread over partitions like any others.

The partitioned rows are written to the shared scratch folder before the offsets are read
from them: range bounds come from a sample, and both passes must see the same ones.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moltab.session import stored


def _asc(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).asc_nulls_last()


def _desc(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).desc_nulls_last()


def _local_sums(by: list[str], values: list[str], floats: list[bool], outs: list[str]):
    """Streaming pass over a sorted partition: running sums per group, the partition's
    number and whether the row belongs to the group of the partition's first row."""

    def starts(batch: pa.RecordBatch) -> np.ndarray:
        """Rows (but the first) whose group differs from the row before."""
        new = np.zeros(batch.num_rows - 1, dtype=bool)
        for c in by:
            x = batch.column(c)
            a, b = x.slice(1), x.slice(0, len(x) - 1)
            differ = pc.fill_null(pc.not_equal(a, b), False)
            one_null = pc.xor(pc.is_null(a), pc.is_null(b))
            new |= np.asarray(pc.or_(differ, one_null))
        return np.flatnonzero(new) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, first = None, True
        carry: list = [0] * len(values)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cuts = starts(batch)
            head = tuple(batch.column(c)[0].as_py() for c in by)
            if last is not None and head != last:
                carry, first = [0] * len(values), False
            sums = []
            for i, v in enumerate(values):
                kind = np.float64 if floats[i] else np.int64
                x = np.asarray(pc.fill_null(batch.column(v), 0)).astype(kind)
                total = np.cumsum(x)
                base = np.zeros(n, dtype=kind)       # the sum before the row's group began
                base[cuts] = total[cuts - 1]
                if len(cuts):
                    group = np.zeros(n, dtype=np.int64)
                    group[cuts] = cuts
                    base = base[np.maximum.accumulate(group)]
                total = total - base
                total[:cuts[0] if len(cuts) else n] += carry[i]
                carry[i] = total[-1]
                sums.append(total)
            lead = np.zeros(n, dtype=bool)
            if first:
                lead[:cuts[0] if len(cuts) else n] = True
                first = not len(cuts)
            last = tuple(batch.column(c)[n - 1].as_py() for c in by)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(s) for s in sums], pa.array(np.full(n, part, dtype=np.int64)), pa.array(lead)],
                names=[*batch.schema.names, *outs, "_part", "_lead"])

    return run


def running_sum(df: DataFrame, order_col: str, values: Sequence[str], by: Sequence[str] = (),
                descending: bool = False, tiebreak: Sequence[str] = (),
                prefix: str = "cum_", n_buckets: int | None = None) -> DataFrame:
    """Add ``cum_<v>``: sum of ``v`` over all rows up to and including this one.

    Rows are ordered by ``order_col`` (asc or desc) then ``tiebreak`` (asc) inside each
    ``by`` group.  Null values add nothing.  ``n_buckets`` is the number of range
    partitions (default: the session's shuffle partitions).
    """
    by, values = list(by), list(values)
    keys = [F.col(b) for b in by] + [_desc(order_col) if descending else _asc(order_col)] \
        + [_asc(t) for t in tiebreak] + [F.col("_row")]
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    parted = rows.repartitionByRange(int(n_buckets), *keys) if n_buckets else rows.repartitionByRange(*keys)
    fields = {f.name: f.dataType for f in df.schema.fields}
    floats = [isinstance(fields[v], (T.DoubleType, T.FloatType, T.DecimalType)) for v in values]
    outs = [f"{prefix}{v}" for v in values]
    schema = T.StructType([*df.schema.fields,
                           *[T.StructField(o, T.DoubleType() if d else T.LongType()) for o, d in zip(outs, floats)],
                           T.StructField("_part", T.LongType()), T.StructField("_lead", T.BooleanType())])
    local = stored(parted.sortWithinPartitions(*keys).drop("_row")
                   .mapInArrow(_local_sums(by, values, floats, outs), schema), "ordered")

    # a group that goes on in a later partition is that partition's leading group
    sums = local.groupBy(*by, "_part").agg(F.max("_lead").alias("_lead"), *[F.sum(v).alias(f"_t_{v}") for v in values])
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, "_part", "_lead", *[F.sum(f"_t_{v}").over(w).alias(f"_off_{v}") for v in values]) \
        .where(F.col("_lead") & F.coalesce(*[F.col(f"_off_{v}") for v in values]).isNotNull())
    offsets = before.select(F.col("_part").alias("_p"), *[f"_off_{v}" for v in values])   # at most one row a partition
    out = local.join(F.broadcast(offsets), F.col("_lead") & (F.col("_part") == F.col("_p")), "left")
    return out.select(*[F.col(c) for c in df.columns], *[
        (F.col(o) + F.coalesce(F.col(f"_off_{v}"), F.lit(0))).alias(o) for o, v in zip(outs, values)])


def row_number(df: DataFrame, order_col: str, tiebreak: Sequence[str] = (), by: Sequence[str] = (),
               descending: bool = False, out: str = "rn", n_buckets: int | None = None) -> DataFrame:
    """Exact ``row_number()`` (1-based) over ``order_col, tiebreak`` within ``by``."""
    tmp = df.withColumn("_one", F.lit(1).cast("long"))
    res = running_sum(tmp, order_col, ["_one"], by=by, descending=descending,
                      tiebreak=tiebreak, prefix="_rn", n_buckets=n_buckets)
    return res.withColumnRenamed("_rn_one", out).drop("_one")


def rank_table(df: DataFrame, value_col: str, by: Sequence[str] = (), out: str = "rank",
               n_buckets: int | None = None) -> DataFrame:
    """Tie-averaged 1-based rank of every distinct non-null value within ``by``; a value
    that very many rows share is one row."""
    by = list(by)
    counts = (df.where(F.col(value_col).isNotNull())
              .groupBy(*by, value_col).agg(F.count(F.lit(1)).alias("_cnt")))
    cum = running_sum(counts, value_col, ["_cnt"], by=by, prefix="_cum", n_buckets=n_buckets)
    return cum.select(*by, value_col, ((F.col("_cum_cnt") - F.col("_cnt")) + (F.col("_cnt") + 1) / 2.0).alias(out))


def average_rank(df: DataFrame, value_col: str, by: Sequence[str] = (), out: str = "rank",
                 n_buckets: int | None = None) -> DataFrame:
    """``df`` with the tie-averaged rank of ``value_col`` within ``by`` (SQL: rank +
    (ties-1)/2), joined by value; null values get a null rank."""
    return df.join(rank_table(df, value_col, by, out, n_buckets), [*by, value_col], "left")
