"""Chunk strategies over pages, and files by their kind."""

import pytest
from pyspark.sql import functions as F

from loreweave.operators import chunking as C
from loreweave.sources import files


def cut(spark, strategy, *texts, **more):
    rows = spark.createDataFrame([("d", n, None, t) for n, t in enumerate(texts, 1)], "key string, page_number int, section_title string, text string")
    return [(r["chunk_index"], r["page_number"], r["section_title"], r["text"]) for r in C.chunk_pages(rows, "key", strategy, **more).orderBy("chunk_index").collect()]


def test_sections_by_keyword(spark):
    text = "first line that is long enough to be kept as a chunk of its own\nAbstract\n" + "a" * 60 + "\n相关工作\nshort\nResults and more\n" + "b" * 70
    assert [(t, x.count("\n")) for _, _, t, x in cut(spark, "paper", text)] == [(None, 0), ("Abstract", 1), ("Results and more", 1)]
    assert [t for _, _, t, _ in cut(spark, "resume", "Jo\nWork experience\nten years of this and that\n技能\nSpark, SQL and some more of it", "教育背景\nA university of some renown")] == ["Work experience", "技能", "教育背景"]


def test_long_chapters_are_cut(spark):
    lines = ["Chapter 1"] + ["x" * 400 + "."] * 9 + ["Chapter 2", "y" * 200 + "."]
    found = cut(spark, "book", "\n".join(lines), size=512)
    assert [(t, x.count("\n")) for _, _, t, x in found] == [("Chapter 1", 4), ("Chapter 1", 3), ("Chapter 1", 0), ("Chapter 2", 1)]


def test_tables_questions_and_pages(spark):
    table = "before\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |\nafter"
    assert [x for *_, x in cut(spark, "table", table, "no table")] == ["| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |", "no table"]
    found = cut(spark, "qa", "Q: what is this? A: a test", "Q: and that? A: another")
    assert [(i, p, t) for i, p, t, _ in found] == [(0, 1, "what is this?"), (1, 2, "and that?")]
    assert [i for i, *_ in cut(spark, "naive", "x" * 900, "y" * 10, size=500, overlap=50)] == [0, 1, 2]
    for strategy in C.STRATEGIES:
        assert cut(spark, strategy, "") in ([], [(0, 1, None, "")])
    assert set(C.strategies()) == set(C.STRATEGIES)
    with pytest.raises(ValueError):
        cut(spark, "none", "x")


def test_folders_are_read_by_extension(spark, tmp_path):
    (tmp_path / "a.txt").write_text("plain text")
    (tmp_path / "b.md").write_text("# One\nx\n## Two\ny")
    (tmp_path / "c.csv").write_bytes("﻿name,n\n".encode() + "".join(f"r{k},{k if k else ''}\n" for k in range(45)).encode())
    found = sorted((r["path"].rsplit("/", 1)[1], r["page_number"], r["section_title"], r["text"].count("\n")) for r in files.folder_pages(spark, str(tmp_path)).collect())
    assert found == [("a.txt", 1, None, 0), ("b.md", 1, "One", 1), ("b.md", 2, "Two", 1), ("c.csv", 1, None, 19), ("c.csv", 2, None, 19), ("c.csv", 3, None, 4)]
    chunks = files.chunk_folder(spark, str(tmp_path), "naive", 10, 2).filter(F.col("path").endswith("c.csv"))
    assert chunks.agg(F.max("chunk_index")).first()[0] == chunks.count() - 1
    (tmp_path / "d.xyz").write_text("?")
    with pytest.raises(ValueError):
        files.folder_pages(spark, str(tmp_path))
    assert files.folder_pages(spark, str(tmp_path), strict=False).count() == 7


def test_exports_registries_and_logs(spark, tmp_path):
    chunks = spark.createDataFrame([("1_chunk_0", 1, "t", "c", 0, 'a "quoted"\nline' + "x" * 300)], "chunk_id string, doc_id long, title string, category string, chunk_index int, text string")
    files.write_export(chunks, str(tmp_path / "e"))
    raw = next((tmp_path / "e").glob("*.csv")).read_text(encoding="utf-8")
    assert raw.startswith("﻿chunk_id,doc_id,title,category,chunk_index,n_chars,preview\n") and 'a ""quoted"" line' in raw
    (tmp_path / "kb.json").write_text('[{"id": "k", "name": "n", "doc_count": 3}]')
    assert [(r["id"], r["doc_count"]) for r in files.read_registry(spark, str(tmp_path / "kb.json")).collect()] == [("k", 3)]
    for _ in range(2):
        files.append_lines(spark.createDataFrame([("x",)], "value string"), str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).count() == 2
    log = spark.createDataFrame([(k, "o", "a", k) for k in range(12)], "event_id long, operator string, action string, ts long")
    assert sorted(r["ts"] for r in files.save_operations(log.filter("ts = 11"), log).collect()) == list(range(2, 12))
    files.replace_documents(log, str(tmp_path / "docs"))
    files.replace_documents(log.limit(1), str(tmp_path / "docs"))
    assert spark.read.parquet(str(tmp_path / "docs")).count() == 1
