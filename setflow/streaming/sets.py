"""Sets that still grow: the bounded files present now are processed once, through the streaming engine.

Graphs themselves are bounded; a streamed scan lets a graph of scans and selections take only what was added since
its last run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from setflow.operators import computations as N
from setflow.plans.compiler import Compiler


def growing_set(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """A streaming frame over a folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_added(node: N.Computation, frames: dict[tuple[str, str], DataFrame], target: str, checkpoint: str) -> None:
    """Append the rows of a graph of scans and selections over what was added to its streamed sets; returns when done."""
    df = Compiler(lambda db, name: frames[db, name]).compile(node)
    query = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
