"""Results that are used more than once, in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors see.  Where it is unset, a session on one machine gets one folder of its own; on a
    cluster it is an error."""
    global _own_folder
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder and _own_folder is None:
        import tempfile

        _own_folder = tempfile.mkdtemp(prefix="checkpoint-")
    return folder or _own_folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in ``shared_folder``.  Its files go with the DataFrame where
    spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
