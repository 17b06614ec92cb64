"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreweave.sources.checkpoints import shared_folder

__all__ = ["SPACES", "Scratch", "by_batches", "fixed", "gapless_rank", "parts_for", "parts_of", "shared_folder", "text_of", "words_of"]

#: White space as the operators' contracts define it.
SPACES = r"[\x20\x09-\x0D]+"


class Scratch:
    """Tables of one run below the shared folder.

    A table is dropped when what was made of it has been written, so a run holds
    what its next steps read and no more. Tables behind a result stay.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame) -> DataFrame:
        """df, written and read back; its size is then known to Spark, which broadcasts small tables by itself."""
        path = f"{self.folder}/{len(self._paths)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(back)] = back, path
        return back

    def drop(self, *tables: DataFrame) -> None:
        context = self.spark.sparkContext
        for table in tables:
            path = context._jvm.org.apache.hadoop.fs.Path(self._paths[id(table)][1])
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fixed(df: DataFrame) -> DataFrame:
    """Write df once to the shared folder and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def by_batches(docs: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], columns: str) -> DataFrame:
    """mapInPandas over docs; columns are those of run besides doc_id.

    doc_id travels as a string, since pandas would turn integers with nulls to floats.
    """
    kind = docs.schema["doc_id"].dataType
    text_keys = docs.withColumn("doc_id", F.col("doc_id").cast("string"))
    return text_keys.mapInPandas(run, f"doc_id string, {columns}").withColumn("doc_id", F.col("doc_id").cast(kind))


def parts_of(batch: pd.DataFrame, column: str, most: int = 1 << 20) -> Iterator[pd.DataFrame]:
    """The rows of a batch in parts whose values of a column have about most characters, or one row."""
    sizes = batch[column].str.len().to_numpy()
    part = (np.cumsum(sizes) - sizes) // most
    edges = [*np.flatnonzero(np.r_[True, part[1:] != part[:-1]]).tolist(), len(batch)] if len(batch) else []
    for first, after in pairwise(edges):
        yield batch.iloc[first:after]


def words_of(text: Column) -> Column:
    """Words between white space; an empty array for a text without any."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def gapless_rank(rows: DataFrame, keys: list[str], part: str, order: list[str], name: str) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in the order (part, order).

    A key's rows are sorted part by part, each part in a task of its own, and
    shifted by the sizes of the parts before; so a key that holds a third of all
    rows is spread over as many tasks as it has parts. ``rows`` is read twice.
    """
    by_part = [*keys, part]
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*by_part).agg(F.count(F.lit(1)).alias("_n")).select(*by_part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    placed = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*by_part).orderBy(*order)) - 1)
    return placed.join(starts, by_part).withColumn(name, F.col("_start") + F.col("_at")).drop("_start", "_at")


def parts_for(rows: int, keys: int, rows_per_part: int = 50_000, least: int = 64) -> int:
    """Parts per key that keep a part near rows_per_part rows."""
    return max(least, -(-rows // (keys * rows_per_part)))
