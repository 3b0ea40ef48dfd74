"""Tables between the steps of a job, in the folder that driver and executors share, and the places of files."""

from __future__ import annotations

import re
import tempfile
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Only where it is unset, a folder below the warehouse stands in, or in local mode (tests) a temporary one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        found = tempfile.mkdtemp(prefix="spark-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def located(path: str):
    """(file system, place in it) of a path as Spark names it: blanks and signs in it stand for themselves, not for parts of a URI."""
    from pyarrow import fs

    scheme, authority, place = re.fullmatch(r"(?:([A-Za-z][A-Za-z0-9+.-]*)://([^/]*)|file:)?(.*)", path, re.DOTALL).groups()
    return fs.FileSystem.from_uri(f"{scheme or 'file'}://{authority or ''}{quote(place)}")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written to the shared folder and read back: what it holds stays the same at every later use."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
