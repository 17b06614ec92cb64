"""Batches of a stream that several tables take together or not at all.

A batch writes its rows of each table into a folder of its own, and then one entry
of the ledger that names these folders, written aside and renamed. Readers see the
folders that the ledger names. A batch that breaks off is tried again under the
same number: what it had written is named by nothing, and a number that the ledger
has is done already.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class BatchLedger:
    """Tables below a folder that all executors reach; schemas by their names."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str]) -> None:
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), schemas
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at().getFileSystem(self._conf)

    def _at(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *names)))

    def _names(self, *folder: str) -> list[str]:
        at = self._at(*folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def batches(self) -> list[int]:
        return [int(n) for n in self._names("ledger") if n.isdigit()]

    def _entry(self, number: int) -> dict[str, str]:
        stream = self._fs.open(self._at("ledger", f"{number:08d}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str) -> DataFrame:
        """The rows of all batches that are done."""
        folders = [f"{self.folder}/{self._entry(n)[table]}" for n in self.batches()]
        return self.spark.read.schema(self.schemas[table]).parquet(*folders) if folders else self.spark.createDataFrame([], self.schemas[table])

    def commit(self, number: int, rows: dict[str, DataFrame]) -> bool:
        """Write a batch's rows of every table; False if the batch was done before."""
        if number in self.batches():
            return False
        if set(rows) != set(self.schemas):
            raise ValueError(f"a batch has rows for {', '.join(self.schemas)}")
        entry = {name: f"{name}/{number:08d}-{uuid.uuid4().hex}" for name in rows}
        for name, df in rows.items():
            wanted = self.spark.createDataFrame([], self.schemas[name]).columns
            df.select(*wanted).write.parquet(f"{self.folder}/{entry[name]}")
        aside, done = self._at("ledger", f"_{uuid.uuid4().hex}"), self._at("ledger", f"{number:08d}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if not self._fs.rename(aside, done):
            raise RuntimeError(f"batch {number} could not be entered")
        return True

    def vacuum(self) -> int:
        """Drop the folders that no entry names; their number."""
        named = {f for n in self.batches() for f in self._entry(n).values()}
        gone = [f"{t}/{n}" for t in self.schemas for n in self._names(t) if f"{t}/{n}" not in named]
        for folder in gone:
            self._fs.delete(self._at(folder), True)
        return len(gone)

    def run(self, stream: DataFrame, stages: Callable[[DataFrame], dict[str, DataFrame]]) -> None:
        """Take all that a stream has, batch by batch."""

        def write(batch: DataFrame, number: int) -> None:
            kept = batch.persist()  # the stages read it several times
            try:
                self.commit(number, stages(kept))
            finally:
                kept.unpersist()

        stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start().awaitTermination()
