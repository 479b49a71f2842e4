"""Running a stream over what is there now, into a table in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from cadenza.session import work_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def read_files(spark: SparkSession, path: str, schema, glob: str | None = None, files_per_trigger: int = 100) -> DataFrame:
    """A Parquet folder as a stream; the files per trigger bound a trigger's size."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Custom state needs the RocksDB store; the session's own choice is put back after."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def run_to_table(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process all available input into a new Parquet table and read it back.

    The checkpoint lies beside the table in the shared folder, so a restarted run goes on
    where the lost one stopped.
    """
    spark = stream.sparkSession
    path = work_path(spark, label)
    with rocksdb(spark):
        running = (
            stream.writeStream.format("parquet").outputMode(mode)
            .option("checkpointLocation", f"{path}-checkpoint").option("path", path)
            .trigger(availableNow=True).start()
        )
        running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, label: str, handle: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Process all available input with a per-batch function, which must be repeatable."""
    path = work_path(stream.sparkSession, f"{label}-checkpoint")
    with rocksdb(stream.sparkSession):
        running = (
            stream.writeStream.outputMode(mode).foreachBatch(handle).option("checkpointLocation", path)
            .trigger(availableNow=True).start()
        )
        running.awaitTermination()
