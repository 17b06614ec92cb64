"""Markdown tables by lines, the export as one file, and vectors of mixed length."""

import csv
import random
import re

from pyspark.sql import functions as F

from loreweave.operators import chunking as C
from loreweave.operators import retrieval as R
from loreweave.sources import files

#: What a table is, as a pattern; the chunker must not use one, since a long table overflows a backtracking matcher.
TABLE = re.compile(r"\|[^\r\n]+\|[\r\n]+\|[-:\x20\t|]+\|[\r\n]+(?:\|[^\r\n]+\|[\r\n]+)+")


def found(spark, texts):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    return {r["k"]: r["t"] for r in rows.select("k", C.markdown_tables(F.col("text")).alias("t")).collect()}


def test_tables_are_those_of_the_pattern(spark):
    rng = random.Random(8)
    lines = ["| a | b |", "|---|:-:|", "| 1 | 2 |", "x | y |", "plain", "||", "|", "| open", "|-|", "see | a |", "| b | c | d", ""]
    texts = ["".join(rng.choice(lines) + rng.choice(["\n", "\n", "\n\n", "\r\n"]) for _ in range(rng.randrange(24))) + rng.choice(["", "| end |"]) for _ in range(900)]
    texts += ["", "|", "| a |\n|-|\n| 1 |", "| a |\n|-|\n| 1 |\n"]
    got = found(spark, texts)
    assert [] == [(t, got[k], w) for k, t in enumerate(texts) if got[k] != (w := [m.strip() for m in TABLE.findall(t)])]
    assert sum(map(len, got.values())) > 150


def test_a_table_of_a_hundred_thousand_rows(spark):
    long = "| a | b |\n|---|---|\n" + "".join(f"| {k} | x |\n" for k in range(100_000))
    got = found(spark, [long + "end", "before\n" + long])
    assert got[0] == [long.strip()] and got[1] == [long.strip()]


def test_pages_of_tables(spark):
    table = "| a |\n|---|\n| {} |\n"
    pages = [
        (1, 1, "one", "r1\n\n r2 ", ["x", "y"]),
        (1, 2, "two", table.format(1) + "words\n" + table.format(2), None),
        (1, 3, "three", "no table", []),
        (1, 4, None, "r3", ["z"]),
        (2, 1, "t", None, None),
        (3, 1, "t", None, ["h"]),
    ]
    rows = C.chunk_table_pages(spark.createDataFrame(pages, "doc_id long, page_number int, section_title string, text string, headers array<string>"), "doc_id").orderBy("doc_id", "chunk_index").collect()
    got = [(r["doc_id"], r["chunk_index"], r["page_number"], r["section_title"], r["kind"], r["text"]) for r in rows]
    assert got == [
        (1, 0, 1, "数据行 1", "table_row", "表格数据（列：x, y）\nr1"),
        (1, 1, 1, "数据行 2", "table_row", "表格数据（列：x, y）\n r2"),
        (1, 2, 2, "Table 1", "table", "| a |\n|---|\n| 1 |"),
        (1, 3, 2, "Table 2", "table", "| a |\n|---|\n| 2 |"),
        (1, 4, 3, "three", "page", "no table"),
        (1, 5, 4, "数据行 6", "table_row", "表格数据（列：z）\nr3"),
        (2, 0, 1, "t", "page", ""),
    ]
    assert rows[0]["token_count"] == int(5 / 1.5 + 10 / 4)


def test_one_export_file_whatever_the_partitions(spark, tmp_path):
    rows = [(f"{k}_chunk_0", k, 'say "t"', "c,d", 0, f'a "quoted"\nline {k}' + "x" * 300) for k in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id string, doc_id long, title string, category string, chunk_index int, text string")
    for n, part in ((0, chunks.limit(0)), (40, chunks.repartition(9)), (40, chunks.repartition(60)), (40, chunks.coalesce(1))):
        files.write_export(part, str(tmp_path / "e"))  # a later export replaces the one before
        assert [p.name for p in (tmp_path / "e").iterdir() if not p.name.endswith(".crc")] == ["export.csv"]
        with (tmp_path / "e" / "export.csv").open(encoding="utf-8-sig", newline="") as f:
            head, *read = csv.reader(f)
        assert head == ["chunk_id", "doc_id", "title", "category", "chunk_index", "n_chars", "preview"] and len(read) == n
        assert sorted(r[0] for r in read) == sorted(r[0] for r in rows)[: n or None][:n] and all(r[2:4] == ['say "t"', "c,d"] and r[6].startswith('a "quoted" line') for r in read)


def test_each_length_of_vectors_has_its_own_neighbours(spark):
    vectors = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("é", [0.0, 1.0]), ("long", [1.0, 0.0, 0.0]), ("none", None), ("zero", [0.0, 0.0]), ("void", [])], "vec_id string, embedding array<double>")
    queries = spark.createDataFrame([("q2", [2.0, 0.0]), ("q3", [1.0, 1.0, 0.0]), ("q4", [1.0] * 4), ("void", []), ("null", None)], "query_id string, query array<double>")
    got = [tuple(r) for r in R.vector_top_k(queries, vectors, 3).orderBy("query_id", "rank").collect()]
    assert got == [("q2", "a", 1.0, 1), ("q2", "b", 1.0, 2), ("q2", "zero", 0.0, 3), ("q3", "long", 0.707107, 1)]
    assert R.vector_top_k(queries.limit(0), vectors, 3).collect() == []


def test_graphs_by_base(spark, tmp_path):
    nodes = spark.createDataFrame([("k1", "doc_1", "document"), ("k2", "doc_2", "document"), (None, "ent_a", "entity"), (None, "ent_b", "entity")], "kb_id string, id string, category string")
    edges = spark.createDataFrame([("doc_1", "ent_a", "x"), ("doc_2", "ent_a", "x"), ("doc_2", "ent_b", "x")], "source string, target string, type string")
    files.write_graph(nodes, edges, str(tmp_path / "g"))
    read = lambda kb: [sorted(map(tuple, t.select(sorted(t.columns)).collect()), key=str) for t in files.read_graph_tables(spark, str(tmp_path / "g"), kb)]
    assert read(None) == [sorted(map(tuple, t.select(sorted(t.columns)).collect()), key=str) for t in (nodes, edges)]
    assert read("k1") == [[("document", "doc_1", "k1"), ("entity", "ent_a", None)], [("doc_1", "ent_a", "x")]]
    assert len(read("k2")[0]) == 3 and read("none") == [[], []]
