"""Sessions, and this package on the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

_shipped: set[str] = set()


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table as a local relation: Spark knows its size and runs no job for it. Arrow carries it."""
    types = _parse_datatype_string(schema)
    columns = list(zip(*rows)) or [()] * len(types)
    arrow = to_arrow_schema(types)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow), types)


def session(cores: int | str = "*", partitions: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, build the session as usual."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("readloom")
    settings = {"spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.sql.adaptive.enabled": "true", "spark.driver.memory": "12g", "spark.sql.shuffle.partitions": str(partitions or 8)}
    for k, v in {**settings, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application; Spark's own file server carries it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    path = os.path.join(tempfile.mkdtemp(prefix="readloom-"), "readloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "readloom")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
