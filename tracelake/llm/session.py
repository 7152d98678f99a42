"""What the operators ask of the session: bounded Arrow batches and the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.operators.checkpoints import scratch as shared_dir
from tracelake.operators.checkpoints import written

__all__ = ["bounded_batches", "shared_dir", "table", "written"]

BATCH_ROWS, BATCH_BYTES = 2000, 12 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows and BATCH_BYTES, for whole texts of any length.

    This is a setting of the session that stays, as what the operators return
    runs later; a smaller bound that the caller has set is kept.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key)
        if not (now.isdigit() and 0 < int(now) < most):
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
