"""A corpus that grows, harvested incrementally: an extension, as the batch operators see a corpus whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from litlode.operators.sets import merge_key
from litlode.plans.query_lang import predicate


def harvest_stream(spark: SparkSession, source: str, schema: StructType, query: str, target: str, checkpoint: str) -> int:
    """Append the matching documents of new files under ``source`` to ``target``, first of each key; returns the rows added.

    Runs through what is there and ends (availableNow). Of rows of a batch that share a key the
    one with the least entry_number counts. A batch that is repeated after a failure replaces
    its own folder, so it adds nothing twice; keys that the target has are anti-joined away,
    for which only its key column is read.
    """
    stream = spark.readStream.schema(schema).parquet(source)
    matched = stream.filter(predicate(query, stream))
    folder = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    added: dict[int, int] = {}

    def add(batch: DataFrame, number: int) -> None:
        first = F.row_number().over(Window.partitionBy("__litlode_key").orderBy("entry_number"))
        keyed = merge_key(batch.withColumn("__litlode_set", F.lit(number))).drop("__litlode_set")
        rows = keyed.withColumn("__litlode_rank", first).filter("__litlode_rank = 1").drop("__litlode_rank")
        others = [str(f.getPath()) for f in files.listStatus(folder) if f.getPath().getName() not in (f"batch={number}", "_SUCCESS")] if files.exists(folder) else []
        if others:
            rows = rows.join(spark.read.parquet(*others).select("__litlode_key"), "__litlode_key", "left_anti")
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")
        added[number] = spark.read.parquet(f"{target}/batch={number}").count()

    run = matched.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    return sum(added.values())


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by window and type of a stream (or table) of events; late rows beyond the watermark are left out of a stream."""
    stamped = events.withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
