"""Tables that a query writes between its steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`, or what the session's
    context was given. Only a local master may do without; then it is a temporary folder."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="corpusloom-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, without the plan that made it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: The tables of each scope() that is open, innermost last.
_scopes: list[list[DataFrame]] = []


def written(df: DataFrame) -> DataFrame:
    """`df` as a Parquet table in the shared folder. See dropped() and scope()."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stage_path = path
    if _scopes:
        _scopes[-1].append(table)
    return table


def dropped(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more, not even a lost task's retry."""
    for df in tables:
        session = df.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(df.stage_path)
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def scope():
    """Removes the tables written inside at its end. What is still needed has been cut by then."""
    _scopes.append([])
    try:
        yield
    finally:
        dropped(*_scopes.pop())
