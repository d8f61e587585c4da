"""Sessions, and the package on the Python path of Spark's workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Arrow batches of long texts are bounded in bytes too, so that a worker holds little more than this at a time.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Python workers started from now on can import this package, wherever the driver was started.

    Unless the session sets it, the size of Arrow batches is bounded by BATCH_BYTES.

    On several machines the package has to be installed (or sent with --py-files) as usual.
    """
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, known)))
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark


def session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A session on this machine alone, with the settings that the tests and the bench use; its shared folder is a temporary one.

    A shared folder that the caller names is left alone when Python ends; the temporary one goes.
    """
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.checkpoint.dir": "file://" + os.path.join(tempfile.gettempdir(), f"glyphmeter-{os.getpid()}"),
    } | conf
    if "spark.checkpoint.dir" not in conf:
        atexit.register(shutil.rmtree, settings["spark.checkpoint.dir"].removeprefix("file://"), True)
    spark = SparkSession.builder.master(f"local[{cores}]").appName("glyphmeter").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
