"""Tables as sources: how large they are, and small ones dealt to all cores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A core's share of an input up to which rows are dealt out before heavy expressions.
SMALL = 32 << 20


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, as the planner knows them; huge where it does not."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if its files are small, and so perhaps one row group; else as it is.

    The exchange is of ``SMALL`` bytes for each core at most; larger inputs have
    row groups enough and are never exchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if input_bytes(df) < cores * SMALL else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share; where it is unset, only a local master has one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="folioscope-")
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
