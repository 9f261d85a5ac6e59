"""Running streams to the end of their input, with checkpoints and outputs in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one of our own only where driver and tasks are one process (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no shared folder, and executors can't see this machine's temporary files")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Bytes of input files in one batch where a state function gathers the rows of a key.
BATCH_BYTES = 1 << 30


def stream_of(spark: SparkSession, sf_dir: str, name: str, batch_bytes: int | None = None) -> DataFrame:
    """A table of the given folder as a stream of its files, at most about ``batch_bytes`` of them (one file at least) a batch."""
    static = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(static.schema)
    if batch_bytes:
        reader = reader.option("maxBytesPerTrigger", batch_bytes)
    return reader.parquet(f"{sf_dir}/{name}.parquet*")


def drain(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Everything that a stream gives for its present input, with the batch it came in; ``each`` (of a batch and its
    number) makes what is written of it.

    Each micro-batch writes a folder of its own, named by its number and overwritten if it is run again,
    so a restarted batch isn't counted twice.
    """
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        (each(batch, number) if each else batch).write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.option("basePath", f"{base}/out").parquet(f"{base}/out")
