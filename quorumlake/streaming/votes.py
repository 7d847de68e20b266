"""Streams of arrivals folded into current rows.

State is the append-only bronze table itself: a micro-batch appends its arrivals, keyed by batch
id so that a repeated batch replaces itself, and the silver rows of the keys it touched are folded
anew.  Late arrivals are never dropped; precedence decides.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fold_stream(stream: DataFrame, bronze: str, silver: str, keys: list[str], fold: Callable[[DataFrame], DataFrame], checkpoint: str, buckets: int = 16, once: bool = True):
    """Starts the query.  ``fold`` maps arrivals (with ``keys``) to one row for each key.

    Silver is partitioned by a hash of the key, and a batch rewrites only the buckets it touches.
    """

    def bucket(df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        arrived = bucket(batch).withColumn("batch", F.lit(batch_id).cast("long"))
        dynamic = {"partitionOverwriteMode": "dynamic"}
        arrived.write.mode("overwrite").options(**dynamic).partitionBy("batch", "bucket").parquet(bronze)
        touched = [r.bucket for r in arrived.select("bucket").distinct().collect()]  # at most ``buckets``
        if not touched:
            return
        every = spark.read.parquet(bronze).where(F.col("bucket").isin(touched)).drop("batch")
        bucket(fold(every.drop("bucket"))).write.mode("overwrite").options(**dynamic).partitionBy("bucket").parquet(silver)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="120 seconds")).start()


class StateFile:
    """Small key/value state of the driver, in any store Spark writes to; each value is one file, replaced whole."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def get(self, key: str):
        path = self._path(f"{self.folder}/{key}.json")
        if not self._fs.exists(path):
            return None
        rows = self.spark.read.text(f"{self.folder}/{key}.json").collect()
        return json.loads("\n".join(r.value for r in rows))

    def set(self, key: str, value) -> None:
        temp = self._path(f"{self.folder}/.{key}-{uuid.uuid4().hex}")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        jvm = self.spark.sparkContext._jvm
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        files.rename(files.makeQualified(temp), files.makeQualified(self._path(f"{self.folder}/{key}.json")), how)
