"""Stateless operators on streams.

The reference has no streaming concept (SURVEY §2.13), so there are no
streaming operators here.  Every row-wise operator of the library (labels,
casts, fingerprints, pattern flags, fitted scalers and model ``transform``)
is a plain column expression and therefore runs unchanged on a streaming
DataFrame.  This helper runs such a transform incrementally over new files of
a directory with an exactly-once file sink; the checkpoint lives under the
cluster's ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from moltab.session import scratch_path


def run_incremental(spark: SparkSession, source: str, schema, transform: Callable[[DataFrame], DataFrame],
                    sink: str, fmt: str = "parquet", glob: str | None = None,
                    checkpoint: str | None = None) -> str:
    """Process all files currently in ``source`` (``availableNow`` trigger) and stop.

    Re-running picks up only files added since the last run.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = transform(reader.load(source))
    ckpt = checkpoint or scratch_path(spark, "stream-ckpt")
    q = (stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return sink
