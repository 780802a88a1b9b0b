"""The row-wise steps on a stream of pairs, as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from editpairs.operators.filters import valid_pairs, with_drop_reasons


def read_pair_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def screened(pairs: DataFrame, resize=None, **thresholds) -> DataFrame:
    """Valid pairs with their drop reasons: no state, so batch and stream agree."""
    return with_drop_reasons(valid_pairs(pairs, resize), **thresholds)


def write_screened(pairs: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append screened pairs to a Parquet table, exactly once by the checkpoint."""
    out = screened(pairs).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()
