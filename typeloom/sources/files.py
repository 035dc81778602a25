"""Folders of versioned tables, and small files that are replaced atomically, on any file system Spark reads."""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def working_folder(spark: SparkSession) -> str:
    """A new folder under the one that all executors share; only where all run in this process, under a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        shared = "file://" + os.path.join(tempfile.gettempdir(), "typeloom-work")
    return f"{shared.rstrip('/')}/work-{uuid.uuid4().hex}"


def kept(rows: DataFrame) -> DataFrame:
    """``rows``, written to a working folder and read from there: what they were made of is not made again."""
    place = working_folder(rows.sparkSession)
    rows.write.parquet(place)
    return rows.sparkSession.read.schema(rows.schema).parquet(place)


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` in twice as many parts as there are cores at least."""
    return rows.repartition(parts(rows.sparkSession))


def parts(spark: SparkSession) -> int:
    """Parts for rows of few bytes and much work, which Spark would put together by their bytes."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


class Folder:
    """A folder on a Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def has(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(""))) if self.has("") else []

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._at(name), True)

    def write_json(self, name: str, value) -> None:
        """Written beside, then renamed: readers see the old or the new content."""
        beside = self._at(f".{name}.{uuid.uuid4().hex}")
        out = self._fs.create(beside, True)
        try:
            out.write(bytearray(json.dumps(value).encode()))
        finally:
            out.close()
        if not self._fs.rename(beside, self._at(name)):
            self._fs.delete(self._at(name), False)
            self._fs.rename(beside, self._at(name))

    def read_json(self, name: str, default=None):
        if not self.has(name):
            return default
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def fetch(self, address: str, name: str) -> bool:
        """Copy a file from any address that the file systems know (https too) if it is missing; whether it was."""
        if self.has(name):
            return False
        source = self._jvm.org.apache.hadoop.fs.Path(address)
        conf = self.spark._jsc.hadoopConfiguration()
        beside = self._at(f".{name}.{uuid.uuid4().hex}")
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, self._fs, beside, False, conf)
        return self._fs.rename(beside, self._at(name))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def write(self, name: str, rows: DataFrame, mode: str = "overwrite", **partition) -> None:
        writer = rows.write.mode(mode)
        if partition.get("by"):
            writer = writer.partitionBy(*partition["by"])
        writer.parquet(f"{self.path}/{name}")


def append_csv(rows: DataFrame, path: str) -> None:
    """Benchmark rows as semicolon-separated text with a header."""
    rows.write.mode("append").option("sep", ";").option("header", True).csv(path)
