"""Given tables, lineage cuts in the shared folder, and plain helpers of the operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import write_and_read


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write to the folder in spark.checkpoint.dir and read back: a cut that survives lost executors."""
    return write_and_read(df, f"llm-{label}")


def ascii_lower(value: Column) -> Column:
    """A-Z lower-cased, all other characters as they are."""
    return F.translate(value, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def gathered(df: DataFrame) -> dict[str, np.ndarray]:
    """The columns of a result of bounded size, by Arrow; numbers without nulls."""
    table = df.toArrow()
    return {name: table.column(name).to_numpy() for name in table.column_names}
