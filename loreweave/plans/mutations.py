"""Changes of a kept table of the driver's documents, with the rows that each has touched."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.operators import mutations as M
from loreweave.sources.checkpoints import shared_folder
from loreweave.sources.tables import documents, table
from loreweave.sources.versioned import FileTable

from .registry import query

#: Added to the ids of documents that come by an upsert.
SHIFT = 1_000_000_000


def _kept(spark: SparkSession, sf_dir: str) -> FileTable:
    """One row for each document, without its text, in files of adjacent ids."""
    kept = FileTable(spark, f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}")
    rows = documents(spark, sf_dir).select("doc_id", "category", "kb_id", F.length("content").cast("long").alias("n_chars"))
    kept.create(rows.repartitionByRange("doc_id"))
    return kept


def _changed(spark: SparkSession, sf_dir: str) -> tuple[FileTable, list[tuple[str, int, int]]]:
    """The table after its changes, and (operation, rows that went or changed, rows that came) of each."""
    kept = _kept(spark, sf_dir)
    steps = [("delete base", M.delete_base(kept, "fr"), 0), ("recategorise", M.recategorise(kept, F.col("category") == "src1", "moved"), 0)]
    tenth = documents(spark, sf_dir).filter("doc_id % 10 = 0").select("doc_id", F.lit("put").alias("category"), "kb_id", F.lit(0).cast("long").alias("n_chars"))
    steps.append(("upsert", *kept.upsert(tenth.unionByName(tenth.withColumn("doc_id", F.col("doc_id") + SHIFT)), ["doc_id"])))
    steps.append(("delete keys", kept.delete_keys(table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id"), ["doc_id"]), 0))
    return kept, steps


_AFTER = f"""
WITH a AS (SELECT doc_id, source AS category, lang AS kb_id, CAST(length(text) AS BIGINT) AS n_chars FROM documents),
b AS (SELECT * FROM a WHERE kb_id IS DISTINCT FROM 'fr'),
c AS (SELECT doc_id, CASE WHEN category = 'src1' THEN 'moved' ELSE category END AS category, kb_id, n_chars FROM b),
p AS (SELECT doc_id + s AS doc_id, 'put' AS category, lang AS kb_id, CAST(0 AS BIGINT) AS n_chars FROM documents, (VALUES (0), ({SHIFT})) t(s) WHERE doc_id % 10 = 0),
d AS (SELECT * FROM c WHERE doc_id NOT IN (SELECT doc_id FROM p) UNION ALL SELECT * FROM p),
e AS (SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))"""


@query(f"{_AFTER} SELECT * FROM e")
def mutated_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents after a base is deleted, a category renamed, a tenth put anew and twice, and some deleted by their ids."""
    return _changed(spark, sf_dir)[0].read()


@query(f"""{_AFTER}
SELECT 0 AS step, 'delete base' AS operation, (SELECT count(*) FROM a WHERE kb_id = 'fr') AS n_changed, CAST(0 AS BIGINT) AS n_new
UNION ALL SELECT 1, 'recategorise', (SELECT count(*) FROM b WHERE category = 'src1'), 0
UNION ALL SELECT 2, 'upsert', (SELECT count(*) FROM c WHERE doc_id IN (SELECT doc_id FROM p)), (SELECT count(*) FROM p)
UNION ALL SELECT 3, 'delete keys', (SELECT count(*) FROM d) - (SELECT count(*) FROM e), 0
UNION ALL SELECT 4, 'replace', (SELECT count(*) FROM e), (SELECT count(*) FROM e WHERE category = 'put')
UNION ALL SELECT 5, 'clear', (SELECT count(*) FROM e WHERE category = 'put'), 0""")
def mutation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each change of mutated_table says of itself, and after them a replacement of all rows and an emptied table."""
    kept, steps = _changed(spark, sf_dir)
    steps += [("replace", *kept.replace(kept.read().filter("category = 'put'"))), ("clear", kept.clear(), 0)]
    return spark.createDataFrame([(k, *s) for k, s in enumerate(steps)], "step int, operation string, n_changed long, n_new long")


@query("SELECT version, n FROM (SELECT 1 AS version, count(*) AS n FROM documents UNION ALL SELECT 2, count(*) FILTER (lang IS DISTINCT FROM 'fr') FROM documents)")
def table_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as it was before and after a base was deleted."""
    kept = _kept(spark, sf_dir)
    M.delete_base(kept, "fr")
    found = [kept.read(v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("n")) for v in kept.versions()]
    return found[0].unionByName(found[1])
