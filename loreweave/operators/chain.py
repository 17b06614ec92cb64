"""Named stages one behind the other, each written when it is done.

A run that is stopped goes on behind its last finished stage. What a stage has
written is found by the run's name and the names of all stages up to it, so a
chain whose later stages change keeps the earlier ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

Stage = tuple[str, Callable[[DataFrame], DataFrame]]


class Chain:
    """Stages below a folder that all executors reach; run tells apart runs over different inputs."""

    def __init__(self, spark: SparkSession, folder: str, run: str, stages: Sequence[Stage]) -> None:
        names = [n for n, _ in stages]
        if len(set(names)) < len(names) or not names:
            raise ValueError("stages have names of their own")
        self.spark, self.stages = spark, list(stages)
        told = [hashlib.sha256("\n".join([run, *names[: k + 1]]).encode()).hexdigest()[:16] for k in range(len(names))]
        self.paths = [f"{folder.rstrip('/')}/{k}-{told[k]}" for k in range(len(names))]

    def _done(self, k: int) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.paths[k]}/_SUCCESS")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def finished(self) -> list[str]:
        """The stages that needn't be run again, in order."""
        done = [self._done(k) for k in range(len(self.stages))]
        return [n for k, (n, _) in enumerate(self.stages) if all(done[: k + 1])]

    def run(self, rows: DataFrame) -> DataFrame:
        """The last stage's table; rows are read by the first one only."""
        for k in range(len(self.finished()), len(self.stages)):
            given = rows if k == 0 else self.spark.read.parquet(self.paths[k - 1])
            self.stages[k][1](given).write.mode("overwrite").parquet(self.paths[k])
        return self.spark.read.parquet(self.paths[-1])

    def output(self, name: str) -> DataFrame:
        """What a finished stage has written: the next one's input."""
        if name not in self.finished():
            raise ValueError(f"stage {name} isn't done")
        return self.spark.read.parquet(self.paths[[n for n, _ in self.stages].index(name)])
