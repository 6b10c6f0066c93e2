"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(prefix="lodegraph-code-"), "lodegraph.zip")
    with zipfile.ZipFile(to, "w") as z:
        for top, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(top, name)
                    z.write(path, os.path.join("lodegraph", os.path.relpath(path, here)))
    spark.sparkContext.addPyFile(to)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; on one machine, one of our own where it is unset."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("lodegraph.shared.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="lodegraph-")
        spark.conf.set("lodegraph.shared.dir", where)
    return where.rstrip("/")


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Cut lineage by a table written in the shared folder; a lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
