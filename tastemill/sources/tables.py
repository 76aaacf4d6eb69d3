"""Parquet tables kept as immutable versions with a pointer file.

A version is written completely before the pointer moves, so a reader sees the old or the new table, a failed job
leaves the old one, and a table can be rewritten from itself.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

_POINTER = "CURRENT"  # a leading underscore would hide it from readers


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hpath, fs = _fs(spark, path)
    return bool(fs.exists(hpath))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small file by a rename, which HDFS and local file systems do atomically."""
    jvm = spark.sparkContext._jvm
    target, fs = _fs(spark, path)
    temporary = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(temporary, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(temporary, target, options)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())


def remove(spark: SparkSession, path: str) -> None:
    hpath, fs = _fs(spark, path)
    fs.delete(hpath, True)


class VersionedTable:
    """A named table under ``root``; ``replace`` and ``append`` make a new version, ``read`` follows the pointer."""

    def __init__(self, spark: SparkSession, root: str, partition_by: list[str] | None = None):
        self.spark, self.root, self.partition_by = spark, root, partition_by or []

    def _pointer(self) -> dict | None:
        path = f"{self.root}/{_POINTER}"
        return json.loads(read_text(self.spark, path)) if path_exists(self.spark, path) else None

    def exists(self) -> bool:
        return self._pointer() is not None

    def read(self) -> DataFrame:
        pointer = self._pointer()
        if pointer is None:
            raise FileNotFoundError(f"no table at {self.root}")
        parts = pointer["parts"]
        if not self.partition_by:
            return self.spark.read.parquet(*parts)
        result = self.spark.read.parquet(parts[0])
        for part in parts[1:]:
            result = result.unionByName(self.spark.read.parquet(part))
        return result

    def compact(self) -> None:
        """Rewrite many small parts as one version; the keys that it holds stay known."""
        pointer = self._pointer() or {"parts": []}
        known = [*pointer.get("merged", []), *(part.rsplit("/", 1)[1] for part in pointer["parts"] if "/k-" in part)]
        self._point([self._write(self.read())], known)

    def _point(self, parts: list[str], merged: list[str] | None = None) -> None:
        write_text(self.spark, f"{self.root}/{_POINTER}", json.dumps({"parts": parts, **({"merged": merged} if merged else {})}))

    def _write(self, df: DataFrame, name: str | None = None) -> str:
        path = f"{self.root}/{name or 'v-' + uuid.uuid4().hex[:12]}"
        df.write.mode("overwrite").partitionBy(*self.partition_by).parquet(path)
        return path

    def replace(self, df: DataFrame) -> None:
        self._point([self._write(df)])

    def append(self, df: DataFrame, key: str | None = None) -> bool:
        """Add rows. A ``key`` has a part of its own: one that was appended before is skipped, and one that failed on the way is written over, so a
        retried micro-batch is there once. Keys may come in any order; feeds put the id of their stream into it."""
        pointer = self._pointer() or {"parts": []}
        name = f"k-{hashlib.sha256(key.encode()).hexdigest()[:24]}" if key is not None else None
        if name and (f"{self.root}/{name}" in pointer["parts"] or name in pointer.get("merged", [])):
            return False
        self._point([*pointer["parts"], self._write(df, name)], pointer.get("merged"))
        return True

    def create_if_absent(self, df: DataFrame) -> bool:
        if self.exists():
            return False
        self.replace(df)
        return True
