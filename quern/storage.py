"""Where operators keep intermediate tables: a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; a local session without the setting gets a temporary one, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    made = f"{base.rstrip('/')}/quern-{uuid.uuid4().hex}"
    _MADE.append(made)
    return made


#: Folders that this process has handed out.
_MADE: list[str] = []


def discard(spark: SparkSession) -> int:
    """Delete the folders handed out so far and return their number; for a session that is done with their tables' readers."""
    n = len(_MADE)
    while _MADE:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


#: Rows of a task that by_rows deals.
TASK_ROWS = 1 << 17


def by_rows(df: DataFrame, *keys: str, rows: int = TASK_ROWS) -> DataFrame:
    """df dealt by keys over as many tasks as hold about `rows` rows each, so that sorts in a task don't grow with the table.

    A table that the session's number of shuffle partitions holds by itself is left alone. Rows are counted for it; one key's
    rows still meet in one task.
    """
    n = -(-df.count() // rows)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df and read it back: cuts the lineage of a loop, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
