"""What the operators need of a session: the shared folder, and the data sources."""

from __future__ import annotations

import tempfile
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource

_REGISTERING = threading.Lock()


def register(spark: SparkSession, source: type[DataSource]) -> None:
    """Register a data source; threads that do so at once would fail, since Spark looks for the name and adds it in two steps."""
    with _REGISTERING:
        spark.dataSource.register(source)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; one is made only where none is set and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not (found := spark.conf.get("spark.checkpoint.dir", None)):
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            found = tempfile.mkdtemp(prefix="chunkmill-")
        sc.setCheckpointDir(found)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
