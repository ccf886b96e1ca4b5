"""Style features of documents as they arrive.

The feature projection keeps no state, so the same expressions serve a stream: no watermark, no window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from inkprint.operators.attribution import feature_frame
from inkprint.operators.ngrams import NgramVocabulary


def stream_features(
    spark: SparkSession, path: str, schema: str = "doc_id bigint, text string", vocabulary: NgramVocabulary | None = None
) -> DataFrame:
    """A streaming feature table over a folder of parquet files with the columns of ``schema``."""
    return feature_frame(spark.readStream.schema(schema).parquet(path), vocabulary)


def write_features(features: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that has arrived to a parquet folder, then stop."""
    writer = features.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    return writer.option("path", path).option("checkpointLocation", checkpoint).start()
