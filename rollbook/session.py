"""Session helpers shared by the tests, the bench and the streaming job."""

from __future__ import annotations

import atexit
import logging
import shutil
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: str = "8", app: str = "rollbook") -> SparkSession:
    """A small local session. On a cluster the session comes from spark-submit instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        # building a plan is twice as fast without a Python call site kept for every column
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as the cluster names it in ``spark.checkpoint.dir``.

    A local session without that setting gets a folder of its own, which is told in the log and removed
    when the program ends.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if not LOCAL:
        LOCAL.append(tempfile.mkdtemp(prefix="rollbook-"))
        atexit.register(shutil.rmtree, LOCAL[0], ignore_errors=True)
        logging.getLogger(__name__).warning("spark.checkpoint.dir is not set; this local session keeps its tables in %s", LOCAL[0])
    return LOCAL[0]


#: The folder of a local session, once it is made.
LOCAL: list[str] = []
