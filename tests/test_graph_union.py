"""Entities whose ids, digests of 32 bits, are the same, in graphs that become one."""

import duckdb
import pytest

from loreweave.operators import graph as G
from loreweave.plans import graphs, registry

SAME = ("Word83331", "Word96453")  # 2ba021dd


@pytest.mark.parametrize("langs", [("en", "en"), ("en", "fr"), ("de", "fr")])
def test_names_of_one_id_both_stay(spark, tmp_path, langs):
    rows = [(k, f"Alpha {name}", lang, "src1", 9) for k, (name, lang) in enumerate(zip(SAME, langs, strict=True))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    told = sorted(map(tuple, graphs.graph_union(spark, str(tmp_path)).collect()))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        assert told == sorted(db.execute(registry.oracle_sql()["graph_union"]).fetchall())
    assert [n for i, n in told if i == "ent_2ba021dd"] == list(SAME)


def test_a_node_of_two_graphs_is_there_once(spark):
    words = spark.createDataFrame([("en", 1, "a", ["x", "y"])], "kb_id string, doc_id long, title string, names array<string>")
    nodes, edges = G.union([G.build(words), G.build(words)])
    assert nodes.count() == nodes.select("id").distinct().count() == 4 and edges.count() == 6
