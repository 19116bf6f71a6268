"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ragged

#: A side is broadcast only when its counted rows stay under this bound; beyond it the same join shuffles.
BROADCAST_ROWS = 500_000

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset, one temporary folder per process, under a local master only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="sievemark-"))
    return _own_dir[0]


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    The folder goes when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sievemark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffled(df: DataFrame) -> DataFrame:
    """df for a join that is never a broadcast: Spark takes rows made by explode, and few columns of a wide file, for far smaller than they are."""
    return df.hint("merge")


def semi_join(df: DataFrame, ids: DataFrame, key: str, n_ids: int) -> DataFrame:
    """Rows of df whose key is among ids (unique values, n_ids of them): broadcast while small, shuffled beyond."""
    return df.join(F.broadcast(ids) if n_ids <= BROADCAST_ROWS else ids, key, "left_semi")


def kept_rows(docs: DataFrame, judge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of docs, with all columns as they are, for whose texts judge(bytes, offsets) is true: one pass without a shuffle."""
    at, names = docs.columns.index("text"), docs.columns

    def run(batches):
        for b in batches:
            kept = [judge(data, offsets) for _, _, data, offsets in ragged.slices(ragged.texts_of(b.column(at)))]
            if kept:
                yield pa.RecordBatch.from_arrays(b.columns, names).filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
