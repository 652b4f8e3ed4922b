"""Session for tests and single machines; on a cluster the session is given."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "clauseworks") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: the context's, else the one the session names, else, on one machine only, a temporary one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="clauseworks-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder and read from there, so that lost executors lose nothing.

    A folder is set here only where the session names none, as in tests.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> Path:
    """A new folder for files beside the checkpoints, which all machines must see as a path."""
    place = urlparse(_checkpoint_folder(spark))
    if place.scheme not in ("", "file"):
        raise ValueError(f"files need a folder with a path, not {place.geturl()}")
    out = Path(place.path) / f"files-{uuid.uuid4().hex}"
    out.mkdir(parents=True)
    return out


def spread(table: DataFrame) -> DataFrame:
    """A stored table with at least a partition for each core: one of a few files that can't be split would keep the others idle.

    Large tables have more partitions than that and stay as they are, unshuffled.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)
