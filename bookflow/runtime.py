"""Getting this package to executors that don't have it installed."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
METHOD = "spark.sql.codegen.hugeMethodLimit"


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once an application. The driver serves the archive itself."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="bookflow-")
    staged = os.path.join(folder, "src")
    shutil.copytree(here, os.path.join(staged, os.path.basename(here)), ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "bookflow_sources"), "zip", staged))
    _SHIPPED.add(app)


def compiled(spark: SparkSession) -> None:
    """The JVM leaves methods of over 8,000 bytes interpreted, and a projection of dozens of columns becomes one such method. With this
    setting Spark makes several of it, unless the session has a limit of its own."""
    if int(spark.conf.get(METHOD)) > 8000:
        spark.conf.set(METHOD, "8000")


def home(spark: SparkSession) -> str:
    """The folder that holds all scratch folders of this application, under ``spark.checkpoint.dir``.

    Where that isn't set (tests, a laptop) a local folder is used, but only under a local master.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/bookflow-scratch"
    return f"{base.rstrip('/')}/bookflow-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, label: str) -> str:
    """The name of a fresh folder in :func:`home`, the one place that driver and executors share."""
    return f"{home(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system that owns it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete all scratch folders of this application. Results that haven't been written elsewhere are gone with them."""
    remove(spark, home(spark))


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        compiled(spark)
        return query(spark, sf_dir)

    return run
