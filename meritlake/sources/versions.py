"""Tables that change in steps: each step is staged, and one small file makes all of it the current version."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Named tables under one folder that all tasks reach.

    commit() writes its tables to folders of their own, then a file with the next version's number that lists which folders
    make up each table; the file comes by a rename, so a reader sees all of a step or nothing. What a broken step has left is
    in no list. A step has a number, and one that is not above the last number does nothing, so that a repeated batch of a
    stream is taken once. One writer at a time; readers of an earlier version keep its folders.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _versions(self) -> list[str]:
        there = self._at(f"{self.path}/versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(there)] if self._fs.exists(there) else []
        return sorted(n for n in names if n.endswith(".json"))

    def current(self, version: int = -1) -> dict:
        """{"step": n, "tables": {name: {"schema": ..., "parts": [...]}}} of the last version, or of the one with an index; an empty one before the first."""
        names = self._versions()
        if not names:
            return {"step": -1, "tables": {}}
        stream = self._fs.open(self._at(f"{self.path}/versions/{names[version]}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, name: str, version: int = -1) -> DataFrame:
        """A table as it is in a version."""
        from pyspark.sql.types import StructType

        held = self.current(version)["tables"][name]
        schema = StructType.fromJson(held["schema"])
        return self.spark.read.schema(schema).parquet(*held["parts"])

    def commit(self, step: int, replace: dict[str, DataFrame] | None = None, append: dict[str, DataFrame] | None = None) -> bool:
        """Take a step: tables replaced, rows appended to others. False, and nothing done, if the step is not above the last one."""
        now = self.current()
        if step <= now["step"]:
            return False
        tables = dict(now["tables"])
        for whole, given in ((True, replace or {}), (False, append or {})):
            for name, df in given.items():
                part = f"{self.path}/{name}/{uuid.uuid4().hex}"
                df.write.parquet(part)
                before = [] if whole or name not in tables else tables[name]["parts"]
                tables[name] = {"schema": df.schema.jsonValue(), "parts": [*before, part]}
        staged, final = self._at(f"{self.path}/staged-{uuid.uuid4().hex}"), self._at(f"{self.path}/versions/{len(self._versions()):012d}.json")
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps({"step": step, "tables": tables}).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(staged, final):
            raise RuntimeError(f"another writer has made {final}")
        return True
