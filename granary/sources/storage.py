"""Small files beside the data, through Hadoop's file systems, so that they can lie wherever Spark reads and writes."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as a URI: spark.checkpoint.dir. Where that is unset, a local master gets a folder of its own (one machine runs everything), and a
    cluster an error, since its machines see no folder in common."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"file:///tmp/granary-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", path)
    if "://" not in path:  # as Hadoop's default file system has it
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        path = there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toString()
        path = "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    return path.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to a scratch path and reads it again: what was computed is not computed anew, and outlives executors."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._settled_at = path
    return back


def discard(*frames: DataFrame | None) -> None:
    """Deletes what settle() wrote for these frames; nothing may read them, or frames made of them, any more."""
    for df in frames:
        if path := getattr(df, "_settled_at", None):
            there = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(there, True)


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Under another name first, then renamed: a reader sees the old file or the new one."""
        new = self._path(name + ".new")
        stream = self.fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(name).toUri() if self._path(name).toUri().getScheme() else self.fs.getUri(), self.conf)
        option = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = option.OVERWRITE
        context.rename(new, self._path(name), options)

    def delete(self, name: str) -> bool:
        return self.fs.delete(self._path(name), True)

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path(name))) if self.exists(name) else []

    def load(self, name: str) -> Any:
        return json.loads(self.read(name))

    def store(self, name: str, value: Any) -> None:
        self.write(name, json.dumps(value, indent=2, ensure_ascii=False))
