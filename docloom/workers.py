"""Python workers that can import this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def ready(spark: SparkSession) -> None:
    """Add the folder of this package to the path of Python workers.

    It only helps where the package is not installed but visible to the workers.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
