"""moltab: Spark-native operators for shallow machine learning on feature tables.

Every operator takes and returns a ``pyspark.sql.DataFrame``.  Row identity is
an explicit key column; every random choice is a hash of ``(key, seed)`` so a
result does not depend on partitioning and can be reproduced in SQL.
"""

from moltab.session import get_spark, scratch_path

__all__ = ["get_spark", "scratch_path"]
