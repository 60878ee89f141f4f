"""Written intermediate results, under the folder `spark.checkpoint.dir` names."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. A cluster has to name one that all executors share, because executors may be lost; only
    a local session where none is set, as in a test, gets one for its process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(folder or os.path.join(tempfile.gettempdir(), f"marquee-checkpoints-{os.getpid()}"))
    return context.getCheckpointDir()


def checkpoint_root(spark: SparkSession) -> str:
    """A new folder under the checkpoint folder."""
    return f"{_folder(spark)}/{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet, so branches read files, and of these only the columns they need, instead of recomputing."""
    path = checkpoint_root(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
