"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_tables: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where it is unset, a local session writes to the warehouse
    folder, which its one machine shares with itself; on a cluster that is an error, as no machine-local folder would do."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/lamplight-scratch"


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends here and survives
    the loss of executors. Tables are removed at exit, or by clear_scratch()."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lamplight-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    _tables.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def clear_scratch() -> None:
    while _tables:
        spark, path = _tables.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may be gone already  # noqa: BLE001
            return


atexit.register(clear_scratch)
