"""A scratch folder that the driver and all executors share, and small files in it."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_given: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path under spark.checkpoint.dir; where that is unset (one local process), under a temporary folder that goes with the process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="chromalyne-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        shared = _own[0]
    _given.append(f"{shared.rstrip('/')}/chromalyne/{tag}-{uuid.uuid4().hex}")
    return _given[-1]


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, files = _file(spark, path)
    return files.exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    p, files = _file(spark, path)
    files.delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete every scratch table of this process. For callers that have stored the results of their queries, as those may still read them."""
    while _given:
        delete_path(spark, _given.pop())


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all."""
    p, files = _file(spark, path + ".new")
    out = files.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    target, _ = _file(spark, path)
    files.delete(target, False)
    if not files.rename(p, target):
        raise OSError(f"{path} could not be written")


def get_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path).collect())


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the scratch folder, so that it is computed once and survives lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
