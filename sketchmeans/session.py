"""What a session needs before it runs code of this package on executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder's path in the folder that all executors share, spark.checkpoint.dir.

    Only a local master does without that setting: it gets a folder that goes with the process. A cluster raises RuntimeError.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="sketchmeans-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
        shared = "file://" + shared
    return f"{shared.rstrip('/')}/sketchmeans/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"
