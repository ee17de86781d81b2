"""Definitions that arrive over time: each micro-batch appends the words that are not there yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.lexicon import resume_todo


def append_new(stream: DataFrame, path: str, checkpoint: str, key: str = "head") -> StreamingQuery:
    """Starts a query that appends unseen keys of the stream to a Parquet table and ends when all that is available is read."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
        fresh = rows.dropDuplicates([key])
        (resume_todo(fresh, spark.read.parquet(path), key) if there else fresh).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
