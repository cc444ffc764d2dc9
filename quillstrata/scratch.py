"""Tables in the folder that the cluster shares: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); in local mode only, one of our own where it is unset."""
    sc = spark.sparkContext
    set_to = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if set_to:
        return set_to.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='quillstrata-')}"
    sc.setCheckpointDir(made)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def spool(df: DataFrame, name: str) -> DataFrame:
    """Write a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillstrata/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._spooled = path
    return back


def discard(*spooled: DataFrame) -> None:
    """Remove tables of spool that nothing reads any more: call it once all that was made of them is itself written."""
    for df in spooled:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._spooled.rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint, if a count proves that df has no more than max_rows rows; else the join shuffles."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df
