"""Versions of a folder: MANIFEST-1, MANIFEST-2, ..., each a line of JSON that names the immutable folders it is made of.

A manifest is written under a temporary name and renamed without overwriting, so of two writers that start
from one version one succeeds, and readers resolve one version: they see a change whole or not at all. Paths go
through the cluster's file system."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has published the next version."""


class Manifests:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _drop(self, name: str) -> None:
        fs, path = self._path(name)
        fs.delete(path, True)

    def _seal(self, version: int, body: dict) -> int:
        """By a temporary name and a rename that does not overwrite."""
        fs, temp = self._path(f".{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps({"version": version} | body, sort_keys=True).encode()))
        out.close()
        _, final = self._path(f"MANIFEST-{version}")
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration())
        no_options = self.spark._sc._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        try:
            context.rename(temp, final, no_options)
        except Py4JJavaError as e:
            fs.delete(temp, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"version {version} is published already") from None
            raise
        return version

    def version(self) -> int:
        """The greatest sealed version, 0 if there is none."""
        fs, folder = self._path("")
        if not fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return max((int(n.removeprefix("MANIFEST-")) for n in names if n.startswith("MANIFEST-")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = version or self.version()
        fs, path = self._path(f"MANIFEST-{version}")
        if not version or not fs.exists(path):
            raise FileNotFoundError("no such version")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _written(self, rows: DataFrame, kind: str, *by: str) -> str:
        """``rows`` as a new folder below ours; its name."""
        name = f"{kind}-{uuid.uuid4().hex[:12]}"
        (rows.write.partitionBy(*by) if by else rows.write).parquet(f"{self.folder}/{name}")
        return name

    def _read(self, *names: str) -> DataFrame:
        """The rows of folders of one schema, with the folders that they are partitioned by as columns."""
        frames = [self.spark.read.parquet(f"{self.folder}/{n}") for n in names]
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out
