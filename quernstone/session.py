"""Sessions, and what Python workers need."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import SparkSession


def session(app: str = "quernstone", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this engine's defaults; conf has more settings, with _ for the dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship()
    return spark


def ship(spark: SparkSession | None = None) -> None:
    """Let functions of this package travel to Python workers whole, so that it needn't be installed there."""
    package = sys.modules[__name__.rpartition(".")[0]]
    if package.__name__ not in cloudpickle.list_registry_pickle_by_value():
        cloudpickle.register_pickle_by_value(package)
