"""Running a stream over what is there and keeping its rows in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one in local mode (tests); otherwise it raises."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    return (named or tempfile.mkdtemp(prefix="spark-")).rstrip("/")


def finished(stream: DataFrame) -> DataFrame:
    """All rows of a stream over what is there now, written as Parquet; the run resumes from its checkpoint."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def kept(rows: DataFrame) -> DataFrame:
    """A table written once to the shared folder and read again, for steps that read it often."""
    path = f"{shared_dir(rows.sparkSession)}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
