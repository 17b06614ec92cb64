"""A table of Parquet files whose versions are lists of files.

A change rewrites the files that hold rows it touches and keeps the names of all
others. The new list of files is written aside and gets its version's name by a
rename that fails if another change was first, so readers see a whole version or
the one before, and a change that breaks off leaves files that no list names. How
many rows a change has touched is observed in the pass that rewrites them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Changed(RuntimeError):
    """Another change has made the next version."""


class FileTable:
    """The table at a path that all executors reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        context = spark.sparkContext
        self._jvm, self._conf = context._jvm, context._jsc.hadoopConfiguration()
        self._fs = self._at().getFileSystem(self._conf)

    def _at(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def versions(self) -> list[int]:
        folder = self._at("versions")
        return sorted(int(f.getPath().getName()) for f in self._fs.listStatus(folder) if f.getPath().getName().isdigit()) if self._fs.exists(folder) else []

    def _listed(self, version: int | None = None) -> tuple[int, StructType, list[str]]:
        """The number, schema and files of a version, the newest one if none is named."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise ValueError(f"{self.path} has no version {'' if version is None else version}")
        number = known[-1] if version is None else version
        stream = self._fs.open(self._at("versions", f"{number:08d}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        held = json.loads(text)
        return number, StructType.fromJson(held["schema"]), held["files"]

    def files(self, version: int | None = None) -> list[str]:
        return self._listed(version)[2]

    def _frame(self, schema: StructType, files: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in files)) if files else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        _, schema, files = self._listed(version)
        return self._frame(schema, files)

    def _written(self, rows: DataFrame) -> list[str]:
        """The files that rows are written to; empty ones are not kept."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        found = [f"{folder}/{f.getPath().getName()}" for f in self._fs.listStatus(self._at(folder)) if f.getPath().getName().startswith("part-")]
        if len(found) > 1:
            return found
        return found if found and not self.spark.read.parquet(f"{self.path}/{found[0]}").isEmpty() else []

    def _commit(self, number: int, schema: StructType, files: list[str]) -> int:
        aside, name = self._at("versions", f"_{uuid.uuid4().hex}"), self._at("versions", f"{number:08d}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"schema": schema.jsonValue(), "files": sorted(files)}).encode()))
        out.close()
        if self._fs.exists(name) or not self._fs.rename(aside, name):
            self._fs.delete(aside, False)
            raise Changed(f"version {number} of {self.path} has been made by another change")
        return number

    def create(self, rows: DataFrame) -> int:
        """The first version."""
        return self._commit(1, rows.schema, self._written(rows))

    def append(self, rows: DataFrame) -> int:
        """The number of rows that are added."""
        number, schema, files = self._listed()
        seen = Observation()
        new = self._written(rows.select(*schema.names).observe(seen, F.count(F.lit(1)).alias("n")))
        self._commit(number + 1, schema, files + new)
        return seen.get["n"]

    def replace(self, rows: DataFrame) -> tuple[int, int]:
        """All rows give way to others: how many went and how many came. rows may be read from this table."""
        number, schema, files = self._listed()
        seen = Observation()
        new = self._written(rows.select(*schema.names).observe(seen, F.count(F.lit(1)).alias("n")))
        gone = self._frame(schema, files).count()
        self._commit(number + 1, schema, new)
        return gone, seen.get["n"]

    def clear(self) -> int:
        number, schema, files = self._listed()
        gone = self._frame(schema, files).count()
        self._commit(number + 1, schema, [])
        return gone

    def _rewritten(self, named: Callable[[DataFrame], DataFrame], kept: Callable[[DataFrame], DataFrame], more: list[str] | None = None) -> int:
        """The rows with _touched of the files that hold any; kept makes of such files' rows what stays."""
        number, schema, files = self._listed()
        rows = named(self._frame(schema, files).withColumn("_file", F.col("_metadata.file_path")) if files else self._frame(schema, []).withColumn("_file", F.lit("")))
        touched = {r[0] for r in rows.filter("_touched").select("_file").distinct().collect()}  # names of files
        old = [f for f in files if any(t.endswith(f) for t in touched)]
        if not old and not more:
            return 0
        count, new = 0, []
        if old:
            seen = Observation()
            new = self._written(kept(named(self._frame(schema, old)).observe(seen, F.count_if("_touched").alias("n"))).select(*schema.names))
            count = seen.get["n"]
        self._commit(number + 1, schema, [f for f in files if f not in old] + new + (more or []))
        return count

    def delete(self, condition: Column) -> int:
        """The number of rows that are deleted; a condition that is null keeps its row."""
        return self._rewritten(lambda d: d.withColumn("_touched", F.coalesce(condition, F.lit(False))), lambda d: d.filter(~F.col("_touched")))

    def update(self, condition: Column, values: dict[str, Column]) -> int:
        """The number of rows that are changed."""
        changed = lambda d: d.withColumns({c: F.when(F.col("_touched"), v).otherwise(F.col(c)) for c, v in values.items()})
        return self._rewritten(lambda d: d.withColumn("_touched", F.coalesce(condition, F.lit(False))), changed)

    def _by_keys(self, rows: DataFrame, keys: list[str]) -> Callable[[DataFrame], DataFrame]:
        wanted = rows.select(*keys).distinct().withColumn("_touched", F.lit(True))
        return lambda d: d.join(wanted, keys, "left").withColumn("_touched", F.coalesce("_touched", F.lit(False)))

    def delete_keys(self, ids: DataFrame, keys: list[str]) -> int:
        """The number of rows whose keys are among ids."""
        return self._rewritten(self._by_keys(ids, keys), lambda d: d.filter(~F.col("_touched")))

    def upsert(self, rows: DataFrame, keys: list[str]) -> tuple[int, int]:
        """How many rows of the table give way to rows of the same keys, and how many rows come."""
        _, schema, _ = self._listed()
        seen = Observation()
        new = self._written(rows.select(*schema.names).observe(seen, F.count(F.lit(1)).alias("n")))
        come = self._frame(schema, new)
        return self._rewritten(self._by_keys(come, keys), lambda d: d.filter(~F.col("_touched")), new), seen.get["n"]

    def vacuum(self, keep: int = 1) -> int:
        """Drop all but the newest versions, and folders of files that none of these names; the number of folders."""
        known = self.versions()
        for number in known[:-keep]:
            self._fs.delete(self._at("versions", f"{number:08d}"), False)
        named = {f.split("/")[1] for number in known[-keep:] for f in self.files(number)}
        gone = [f.getPath() for f in self._fs.listStatus(self._at("data")) if f.getPath().getName() not in named] if self._fs.exists(self._at("data")) else []
        for folder in gone:
            self._fs.delete(folder, True)
        return len(gone)
