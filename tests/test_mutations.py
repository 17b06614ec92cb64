"""Changes of a table of files: counts, untouched files, versions, and what builds on them."""

import pytest
from pyspark.sql import functions as F

from loreweave.operators import mutations as M
from loreweave.sources.versioned import Changed, FileTable

SCHEMA = "chunk_id string, doc_id long, category string, kb_id string"


@pytest.fixture
def chunks(spark, tmp_path):
    rows = [(f"{d}_chunk_{k}", d, f"c{d % 3}", None if d == 9 else f"kb{d % 2}") for d in range(10) for k in range(d + 1)]
    table = FileTable(spark, str(tmp_path / "chunks"))
    table.create(spark.createDataFrame(rows, SCHEMA).repartitionByRange(5, "doc_id"))
    return table


def ids(table, version=None):
    return sorted((r["doc_id"], r["category"]) for r in table.read(version).select("doc_id", "category").collect())


def test_counts_and_untouched_files(chunks):
    before = chunks.files()
    assert M.remove_document(chunks, 4) == 5 and M.remove_document(chunks, 4) == 0 and M.remove_document(chunks, None) == 0
    assert chunks.versions() == [1, 2] and len(set(before) & set(chunks.files())) == len(before) - 1
    assert not [d for d, _ in ids(chunks) if d == 4] and len([d for d, _ in ids(chunks, 1) if d == 4]) == 5
    assert M.recategorise(chunks, F.col("doc_id") == 7, "new") == 8 and {c for d, c in ids(chunks) if d == 7} == {"new"}
    assert M.count_by_prefix(chunks, 1) == 2 and M.remove_by_prefix(chunks, 1) == 2
    assert M.delete_base(chunks, "kb0") == 1 + 3 + 7 + 9
    assert [d for d, _ in ids(chunks)] == sorted([3] * 4 + [5] * 6 + [7] * 8 + [9] * 10)  # null is no base
    assert M.delete_base(chunks, "none") == 0 and M.delete_base(chunks, "all") == 28
    assert chunks.read().columns == ["chunk_id", "doc_id", "category", "kb_id"] and chunks.read().count() == 0 and M.delete_base(chunks, "all") == 0


def test_upserts_and_replacements(spark, chunks):
    before, n = chunks.files(), chunks.read().count()
    new = spark.createDataFrame([("x", 2, "n", None), ("y", 2, "n", None), ("z", 77, "n", "kb0")], SCHEMA)
    assert chunks.upsert(new, ["doc_id"]) == (3, 3)
    assert len(set(before) & set(chunks.files())) == len(before) - 1 and chunks.read().count() == n
    assert chunks.upsert(new.limit(0), ["doc_id"]) == (0, 0)
    assert chunks.delete_keys(spark.createDataFrame([(77,), (77,), (None,), (500,)], "doc_id long"), ["doc_id"]) == 1
    assert chunks.append(new.limit(1)) == 1
    assert chunks.replace(chunks.read().filter("doc_id = 3")) == (n, 4) and ids(chunks) == [(3, "c0")] * 4
    assert len(ids(chunks, 1)) == n
    assert chunks.vacuum() > 0 and len(ids(chunks)) == 4
    with pytest.raises(ValueError):
        chunks.read(1)


def test_of_two_changes_one_is_first(spark, chunks):
    number, schema, files = chunks._listed()
    chunks.delete(F.col("doc_id") == 1)
    with pytest.raises(Changed):
        chunks._commit(number + 1, schema, files)
    with pytest.raises(Changed):
        chunks.create(chunks.read())
    assert chunks.versions() == [1, 2]


def test_a_change_that_breaks_off_is_not_seen(spark, chunks):
    before = ids(chunks)
    with pytest.raises(Exception, match="broken"):
        chunks.update(F.col("doc_id") > 4, {"category": F.raise_error(F.lit("broken")).cast("string")})
    assert ids(chunks) == before and chunks.versions() == [1]


def test_documents_references_categories_and_stats(spark, chunks, tmp_path):
    table = lambda name, rows, schema: (t := FileTable(spark, str(tmp_path / name)), t.create(spark.createDataFrame(rows, schema)))[0]
    docs = table("docs", [(1, "a"), (2, "a"), (3, None)], "doc_id long, category string")
    log = table("log", [], "ts timestamp, operator string, action string, doc_id long, target string, chunks_updated long")
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert M.recategorise_document(docs, chunks, log, 2, "b", "me", now) == (1, 3) and M.recategorise_document(docs, chunks, log, 50, "b", "me", now) == (0, 0)
    assert [(r["action"], r["doc_id"], r["target"], r["chunks_updated"]) for r in log.read().collect()] == [("update_category", 2, "b", 3)]
    refs = table("refs", [("r1", "book", 2000)], "ref_id string, kind string, year int")
    assert M.create_references(refs, spark.createDataFrame([("r1", "book", 1), ("r2", "tablet", 2), ("r2", "tablet", 2), ("r3", None, 3)], "ref_id string, kind string, year int")) == 2
    assert sorted((r["ref_id"], r["kind"]) for r in refs.read().collect()) == [("r1", "book"), ("r2", "other"), ("r3", "other")]
    kinds = table("categories", [("default", "recursive", 500, 100), ("a", "fixed", 5, 1)], "name string, strategy string, chunk_size int, overlap int")
    assert M.put_categories(kinds, spark.createDataFrame([("a", "qa", 9, 2), ("z", "qa", 9, 2)], "name string, strategy string, chunk_size int, overlap int")) == (1, 2)
    assert M.delete_category(kinds, docs, "default") == (0, 0) and M.delete_category(kinds, docs, "a") == (1, 1) and M.delete_category(kinds, docs, "a") == (0, 0)
    assert sorted((r["doc_id"], r["category"]) for r in docs.read().collect()) == [(1, "default"), (2, "b"), (3, None)]
    stats = table("stats", [], "id int, total_sessions long, total_messages long")
    assert M.put_chat_stats(stats, 3, 10) == (0, 1) and M.put_chat_stats(stats, 4, 12) == (1, 1)
    assert [tuple(r) for r in stats.read().collect()] == [(1, 4, 12)]
