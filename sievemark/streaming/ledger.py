"""A validated sink of records that a replayed batch can't write twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery


def _earlier(spark: SparkSession, path: str, key: str, key_type: str, batch_id: int) -> DataFrame:
    """The keys that other batches have written; batches are folders, so that only keys are read."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{key} {key_type}")
    held = spark.read.option("basePath", path).parquet(path)
    return held.filter(F.col("batch") < batch_id).select(key)


def write_batch(batch: DataFrame, batch_id: int, path: str, key: str, error: Callable[[DataFrame], DataFrame], order: list[str]) -> None:
    """Write the valid records of a batch under path/records, the others under path/refused, each in the batch's own folder.

    error gives a batch's rows with a column error (null: valid). Of records with one key the first write wins: what an
    earlier batch wrote stays, and in a batch the first in the given order. A batch's folder is written over as a
    whole: a replay gives the same rows in the same place.
    """
    spark, key_type = batch.sparkSession, batch.schema[key].dataType.simpleString()
    judged = error(batch)
    judged = judged.withColumn("error", F.when(F.col(key).isNull() & F.col("error").isNull(), f"{key} is missing").otherwise(F.col("error")))
    valid = judged.filter("error IS NULL").drop("error")
    first = valid.groupBy(key).agg(F.min_by(F.struct(*valid.columns), F.struct(*order)).alias("r")).select("r.*")
    new = first.join(_earlier(spark, f"{path}/records", key, key_type, batch_id), key, "left_anti").select(*valid.columns)
    new.write.mode("overwrite").parquet(f"{path}/records/batch={batch_id}")
    judged.filter("error IS NOT NULL").write.mode("overwrite").parquet(f"{path}/refused/batch={batch_id}")


def record_stream(stream: DataFrame, path: str, key: str, error: Callable[[DataFrame], DataFrame], order: list[str], **options: str) -> StreamingQuery:
    """Start a stream that writes its records by write_batch(); its progress is kept under path/progress, so that it goes on after a stop where it was."""
    write = lambda batch, batch_id: write_batch(batch, batch_id, path, key, error, order)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/progress").trigger(**(options or {"availableNow": True})).start()


def records(spark: SparkSession, path: str, kind: str = "records") -> DataFrame:
    """What a stream has written: records or refused."""
    return spark.read.option("basePath", f"{path}/{kind}").parquet(f"{path}/{kind}").drop("batch")
