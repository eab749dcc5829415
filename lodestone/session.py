"""Session and table access."""

from __future__ import annotations

import atexit
import logging
import os
import tempfile
import uuid

from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestone")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LODESTONE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Only a local master has a default, on its own disk."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        where = "file://" + os.path.join(tempfile.gettempdir(), f"lodestone-{spark.sparkContext.applicationId}")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def saved(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage; the files go when the driver's Python ends."""
    path = saved_path(df, tag)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_path(df: DataFrame, tag: str) -> str:
    """The folder in which df has been written."""
    path = scratch(df.sparkSession, tag)
    atexit.register(drop, path)
    df.write.parquet(path)
    return path


def drop(path: str) -> None:
    from lodestone.sources.files import filesystem

    try:
        where, inner = filesystem(path)
        if where.get_file_info(inner).type != FileType.NotFound:
            where.delete_dir(inner)
    except Exception as e:  # noqa: BLE001  at exit, where nobody could take care of it
        logging.getLogger(__name__).warning("scratch data stays in %s: %s", path, e)
