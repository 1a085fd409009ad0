"""Tables in the folder that all executors share, which end a lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Only a local session,
    where all of them are one machine, may go without: it keeps its tables in the warehouse."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._conf.get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shelfmark"
    return path.rstrip("/")


def kept(df: DataFrame, label: str) -> DataFrame:
    """The frame written to the shared folder and read again: its lineage ends there, and a lost executor
    costs a read rather than the work above."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, label: str) -> DataFrame:
    """kept, and joined by sorting if its rows are over the session's limit for a broadcast.

    Spark takes the size of files for that of their rows, but where values repeat the rows are hundreds of times as
    large, and a table of millions of them would be broadcast through the driver."""
    written = Observation()
    rows = kept(df.observe(written, F.count(F.lit(1)).alias("n")), label)
    most = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return rows.hint("merge") if written.get["n"] * rows._jdf.schema().defaultSize() > most else rows
