"""Migrations: types, defaults, rejects, and that a second run adds nothing."""

import json
from datetime import datetime

import pytest

from loreweave.operators import migrations as M

STORES = {
    "users": {"u1": {"id": "U", "username": "n", "password_hash": "h", "roles": ["a", "b"], "created_at": "2024-01-02T03:04:05", "last_login": "soon"}, "u2": {"username": "x"}, "u3": {"username": None, "password_hash": "h"}, "u4": 5},
    "categories": {"c1": {}, "c2": {"strategy": None, "chunk_size": "70"}, "c3": {"chunk_size": "many"}, "c4": {"overlap": 1.5, "chunk_size": []}},
    "references": {"r1": {"title": "t", "authors": ["a"], "year": 1999, "type": "book"}, "r2": {"authors": "one"}},
    "documents": {"d1": {"title": "t", "content": "c\n\"q\"", "knowledge_base_id": "k", "tags": ["x"], "size": 3, "created_at": "2024-01-02 03:04:05"}, "d2": {}},
    "op_log": [{"time": "2024-01-02T03:04:05.000006", "operator": "o", "doc_ids": ["1"], "why": {"a": 1}}, {"migrated_count": "x"}, {}],
    "chat_stats": {"total_sessions": 2, "total_messages": 9},
    "document_versions": {"d1": [{"version": 1, "content": "one", "metadata": {"k": 1}}, {"id": "own", "version": 2, "doc_id": "d7"}, {"version": "two"}], "d2": []},
}


@pytest.fixture
def stores(spark, tmp_path):
    for name, held in STORES.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(held))
    path = lambda n: str(tmp_path / f"{n}.json")
    found = {n: M.object_entries(spark, path(n)) for n in ("users", "categories", "references", "documents")}
    found |= {"op_log": M.list_entries(spark, path("op_log")), "chat_stats": M.single_entry(spark, path("chat_stats"))}
    return found | {"document_versions": M.version_entries(M.object_entries(spark, path("document_versions")))}


def test_seven_entities_twice(spark, tmp_path, stores):
    made = M.Migration(spark, str(tmp_path / "db"))
    assert set(M.ENTITIES) == set(stores)
    first = {n: made.run(M.ENTITIES[n], e) for n, e in stores.items()}
    assert first == {"users": (4, 1, 3), "categories": (4, 2, 2), "references": (2, 1, 1), "documents": (2, 2, 0), "op_log": (3, 2, 1), "chat_stats": (1, 1, 0), "document_versions": (3, 2, 1)}
    assert all(made.run(M.ENTITIES[n], e) == (0, 0, 0) for n, e in stores.items())
    table = lambda n: {r["id"]: r.asDict() for r in M.FileTable(spark, str(tmp_path / "db" / n)).read().collect()}
    assert table("users") == {"U": {"id": "U", "username": "n", "password_hash": "h", "email": "", "display_name": "", "roles": ["a", "b"], "status": "active", "created_at": datetime(2024, 1, 2, 3, 4, 5), "last_login": None}}
    assert table("categories") == {"c1": {"id": "c1", "strategy": "recursive", "chunk_size": 500, "overlap": 100}, "c2": {"id": "c2", "strategy": None, "chunk_size": 70, "overlap": 100}}
    assert table("references")["r1"]["kind"] == "book" and table("references")["r1"]["year"] == 1999
    docs = table("documents")
    assert docs["d1"]["content"] == 'c\n"q"' and docs["d1"]["extra"] == {"knowledge_base_id": "k", "tags": '["x"]', "size": "3", "created_at": "2024-01-02 03:04:05"} and docs["d2"]["kb_id"] == "default" and docs["d2"]["extra"] == {}
    versions = table("document_versions")
    assert {k: (v["doc_id"], v["version"], v["extra"]) for k, v in versions.items()} == {"d1-v1": ("d1", 1, {"k": "1"}), "own": ("d7", 2, {})}
    log = {r["operator"]: r for r in table("op_log").values()}
    assert log["o"]["time"] == datetime(2024, 1, 2, 3, 4, 5, 6) and log["o"]["extra"] == {"why": '{"a":1}'} and log[""]["doc_ids"] == []
    assert table("chat_stats") == {"1": {"id": "1", "total_sessions": 2, "total_messages": 9}}
    rejects = sorted((r["entity"], r["key"].split(":")[0], r["problem"]) for r in M.FileTable(spark, str(tmp_path / "db" / "rejects")).read().collect())
    assert rejects == [
        ("categories", "c3", "chunk_size is no int"),
        ("categories", "c4", "chunk_size is no int"),
        ("document_versions", "d1-vtwo", "version is no int"),
        ("op_log", "1", "migrated_count is no int"),
        ("references", "r2", "authors is no array<string>"),
        ("users", "u2", "no password_hash"),
        ("users", "u3", "no username"),
        ("users", "u4", "no object"),
    ]


def test_a_longer_store_adds_what_is_new(spark, tmp_path, stores):
    made, kind = M.Migration(spark, str(tmp_path / "db")), M.ENTITIES["op_log"]
    assert made.run(kind, stores["op_log"])[1] == 2
    (tmp_path / "more.json").write_text(json.dumps([*STORES["op_log"], {"operator": "later"}]))
    assert made.run(kind, M.list_entries(spark, str(tmp_path / "more.json"))) == (4, 1, 0)
    # A run that broke off before the ledger was written adds nothing twice.
    made.table("ledger", M.LEDGER).clear()
    assert made.run(kind, stores["op_log"]) == (3, 0, 0)


def test_stores_of_lists(spark, tmp_path):
    made = M.Migration(spark, str(tmp_path / "db"))
    schema = "ids array<string>, chunks array<string>, embeddings array<array<double>>"
    good = spark.createDataFrame([(["a", "b"], ["x", "y"], [[1.0], [2.0]]), (["c"], ["z"], [[3.0]])], schema)
    bad = spark.createDataFrame([(["d"], ["x", "y"], [[1.0]])], schema)
    assert made.store(bad) == 0 and made.store(good) == 3 and made.store(good) == 0 and made.store(good, force=True) == 0
    assert made.store(spark.createDataFrame([(["a", "e"], ["x", "y"], [[1.0], [2.0]])], schema), force=True) == 1
