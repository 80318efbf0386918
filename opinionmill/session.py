"""Session settings for laptops and tests; a cluster brings its own session."""

from __future__ import annotations

import posixpath
import re
import tempfile

from pyspark.sql import SparkSession


def local_session(app: str, cpus: str = "*", **settings: str) -> SparkSession:
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **settings,
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A sub-folder of the cluster's shared checkpoint folder.

    Where none is set, a session that runs in one process gets one of its own; a cluster has to name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set")
        root = tempfile.mkdtemp(prefix="opinionmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return posixpath.join(root.rstrip("/"), name)
