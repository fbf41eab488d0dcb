"""Versioned tables in a folder: new rows are appended as parts, rewrites become a new version, a pointer switches.

A reader sees the parts that the newest pointer names. Pointers are numbered and never overwritten, so a write that
fails half way changes nothing, and of two writers at once the second one fails instead of undoing the first. All access goes through the file system of the path.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMAT_VERSION = 1


class StoreError(RuntimeError):
    """The store is of another format or a table does not fit."""


class TableStore:
    """Tables of one folder, each with its pointer file."""

    def __init__(self, spark: SparkSession, root: str, schemas: dict[str, str]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), {k: StructType.fromDDL(v) for k, v in schemas.items()}
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        have = self._load("format.json")
        if have is None:
            self._save("format.json", {"version": FORMAT_VERSION})
        elif have.get("version") != FORMAT_VERSION:
            raise StoreError(f"format {have.get('version')} is not {FORMAT_VERSION}")

    def _versions(self, name: str) -> list[int]:
        found = self._fs.globStatus(self._path(f"{self.root}/{name}.v*"))
        return sorted(int(f.getPath().getName().rpartition(".v")[2]) for f in found or [])

    def _load(self, name: str) -> dict | None:
        versions = self._versions(name)
        if not versions:
            return None
        stream = self._fs.open(self._path(f"{self.root}/{name}.v{versions[-1]:012d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _save(self, name: str, value: dict) -> None:
        versions = self._versions(name)
        target = self._path(f"{self.root}/{name}.v{(versions[-1] if versions else 0) + 1:012d}")
        part = self._path(f"{self.root}/_new-{name}-{uuid.uuid4().hex}")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(part, target):
            self._fs.delete(part, False)
            raise StoreError(f"{name} was written by someone else meanwhile")
        for old in versions[:-1]:  # the one before stays for readers that have just looked it up
            self._fs.delete(self._path(f"{self.root}/{name}.v{old:012d}"), False)

    def parts(self, table: str) -> list[str]:
        return (self._load(f"{table}.json") or {"parts": []})["parts"]

    def read(self, table: str) -> DataFrame:
        """The current rows; an empty table before the first write."""
        paths = [f"{self.root}/{table}/{p}" for p in self.parts(table)]
        if not paths:
            return self.spark.createDataFrame([], self.schemas[table])
        return self.spark.read.schema(self.schemas[table]).parquet(*paths)

    def _write(self, table: str, df: DataFrame) -> str:
        name = uuid.uuid4().hex
        missing = [f.name for f in self.schemas[table].fields if f.name not in df.columns]
        if missing:
            raise StoreError(f"{table}: columns {missing} are missing")
        df.select(*(df[f.name].cast(f.dataType) for f in self.schemas[table].fields)).write.parquet(f"{self.root}/{table}/{name}")
        return name

    def append(self, table: str, df: DataFrame) -> None:
        """Adds rows as one more part."""
        old = self.parts(table)
        self._save(f"{table}.json", {"parts": [*old, self._write(table, df)]})

    def replace(self, table: str, df: DataFrame) -> None:
        """Makes the rows of `df` the whole table; parts of the old version are removed after the switch."""
        old = self.parts(table)
        self._save(f"{table}.json", {"parts": [self._write(table, df)]})
        for p in old:
            self._fs.delete(self._path(f"{self.root}/{table}/{p}"), True)

    def compact(self, table: str, most: int = 8) -> bool:
        """Writes a table of more than `most` parts as one; whether it did."""
        if len(self.parts(table)) <= most:
            return False
        self.replace(table, self.read(table))
        return True
