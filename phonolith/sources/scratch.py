"""Tables written to the folder that all executors share, and streams that end."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster names; a temporary one only where all tasks run in this process."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/table-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Written out and read again: cuts lineage, and a lost executor costs a task."""
    path = path or folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def streamed(df: DataFrame, work, mode: str) -> DataFrame:
    """What `work` gives for a stream of df's rows after all of them: written as files, read as a stream that ends, and kept by batch.

    work: from a streaming DataFrame to one. Results come with the number of their `batch`; a batch that is run again
    replaces its own.
    """
    spark, root = df.sparkSession, folder(df.sparkSession)
    written(df, f"{root}/in")
    out = work(spark.readStream.schema(df.schema).parquet(f"{root}/in"))

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{root}/out/batch={batch}")

    stream = out.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.option("basePath", f"{root}/out").schema(out.schema.add("batch", "long")).parquet(f"{root}/out")


def streamed_in_turn(frames: Sequence[DataFrame], work, mode: str, rocks: bool = False) -> tuple[DataFrame, list[dict]]:
    """What `work` gives for a stream whose batches are the frames, in this order, and each batch's figures.

    Every frame arrives as files and is taken in by a run of the stream that goes on from the last one's checkpoint. Results
    have the number of the run as `batch`. Figures: `dropped` late groups of rows and `state` rows held, from the operators
    of state, over the micro-batches of the run. rocks: state in RocksDB, for this stream only.
    """
    spark, root = frames[0].sparkSession, folder(frames[0].sparkSession)
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    figures = []
    try:
        if rocks:
            spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        for i, frame in enumerate(frames):
            frame.write.parquet(f"{root}/in/run-{i}")
            out = work(spark.readStream.schema(frame.schema).option("recursiveFileLookup", "true").parquet(f"{root}/in"))

            def keep(rows: DataFrame, micro: int, i: int = i) -> None:
                rows.write.mode("overwrite").parquet(f"{root}/out/batch={i}/micro={micro}")

            stream = out.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
            stream.awaitTermination()
            held = [op for p in stream.recentProgress for op in p["stateOperators"]]
            figures.append({"batch": i, "dropped": sum(op["numRowsDroppedByWatermark"] for op in held), "state": held[-1]["numRowsTotal"] if held else 0})
    finally:
        spark.conf.set(provider, before)
    return spark.read.option("basePath", f"{root}/out").schema(out.schema.add("batch", "long").add("micro", "long")).parquet(f"{root}/out"), figures
