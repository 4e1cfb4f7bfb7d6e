"""Cut lineage: tables in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders made for sessions that name none, by the application's id.
_MADE: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a folder of this machine if all of Spark runs on it, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        named = _MADE.get(app) or _MADE.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tallyloom-"))
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows as a table in the shared folder and reads them again, which ends the lineage.

    The table survives lost executors. It is scratch: whoever owns the folder may clear it once the
    results that depend on it are written.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tallyloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
