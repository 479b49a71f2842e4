"""Session defaults, the shared work folder, and spreading of small files."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A single file of at most this size is spread over the cores.
SPREAD_BYTES = 32 << 20

# Spark's option that shuffle files go with the execution they were written for, not when the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_LOCAL_ROOTS: dict[str, str] = {}


def local_session(cores: str | int = "*", app: str = "cadenza", **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_root(spark: SparkSession) -> str:
    """The shared folder for written intermediates, named by ``spark.checkpoint.dir``.

    A session in one local process may leave it unset and gets a folder of its own. On a
    cluster an unset option is an error: a machine-local folder would hide each executor's
    files from the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder (master {master})")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="cadenza-")
    return _LOCAL_ROOTS[app]


def work_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return os.path.join(work_root(spark), f"{label}-{uuid.uuid4().hex}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, on whatever file system its scheme names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def write_and_read(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage with a table in the shared folder; survives lost executors.

    What was shuffled for the table goes when it is written.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.parquet(path)


def forget(written: DataFrame) -> None:
    """Delete a table of :func:`write_and_read` that nothing reads again, such as the last round's."""
    spark = written.sparkSession
    for folder in {name.rpartition("/")[0] for name in written.inputFiles()}:
        if not re.search(r"/[a-z-]+-[0-9a-f]{32}\Z", folder):
            raise ValueError(f"no written intermediate: {folder}")
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def input_bytes(scan: DataFrame) -> int:
    """Size of the files that a table is read from."""
    spark = scan.sparkSession
    total = 0
    for name in scan.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    return total


def parts_for(df: DataFrame, part_bytes: int) -> int:
    """Partitions for heavy work on tables of files: one a core at least, and more where they would hold over ``part_bytes`` of the files."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-input_bytes(df) // part_bytes))


def spread(scan: DataFrame, most_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Spread a table of at most ``most_bytes`` over the session's cores.

    A small Parquet file is one split, however heavy the work per row. The bound is in bytes
    of the table, whatever the cluster: larger tables are read where they are.
    """
    if len(scan.inputFiles()) > 1 or input_bytes(scan) > most_bytes:
        return scan
    return scan.repartition(scan.sparkSession.sparkContext.defaultParallelism)
