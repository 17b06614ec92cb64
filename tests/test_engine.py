"""Text, intents, retrieval, graphs, lifecycles, files and streams on small literal tables."""

import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loreweave.functions import intent as I
from loreweave.functions import text as T
from loreweave.functions import vectors as V
from loreweave.operators import cache
from loreweave.operators import graph as G
from loreweave.operators import lifecycle as L
from loreweave.operators import retrieval as R
from loreweave.operators import sessions as S
from loreweave.sources import files
from loreweave.streaming import jobs as J


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: T.align_citations(F.lit("x①y①z"), F.lit(2)), "x①y②z"),
        (lambda: T.align_citations(F.lit("x"), F.lit(2)), "x①②"),
        (lambda: T.align_citations(F.lit("x①②③"), F.lit(1)), "x①"),
        (lambda: T.anonymous_ip(F.lit("10.1.2.3")), "10.1.2.0"),
        (lambda: T.anonymous_ip(F.lit("abc")), "abc"),
        (lambda: T.strip_think(F.lit(" <think>only open")), "<think>only open"),
        (lambda: T.strip_think(F.lit("<think>a\nb</think> answer ")), "answer"),
        (lambda: T.sanitise(F.lit("[object Object] <null>")), "（内容异常） （内容异常）"),
        (lambda: T.sanitise(F.lit("{{a.b}}")), T.USELESS),
        (lambda: T.strip_tails(F.lit("text\n\n引用来源：\n① x")), "text"),
        (lambda: T.token_estimate(F.lit("中文字abcd")), 3),
        (lambda: T.normalise(F.lit("  A\t\tB ")), "a b"),
        (lambda: T.json_object(F.lit('so {"a": {"b": 1}} there')), '{"a": {"b": 1}}'),
        (lambda: T.cut_at_first(F.lit("One. Two, but not found here."), ["not found"]), "One."),
        (lambda: T.emoji_runs(F.lit("a😀😀b😀")), 2),
        (lambda: V.cosine_safe(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))), 0.0),
        (lambda: T.cache_key(F.lit("k"), F.lit(" q ")) == T.cache_key(F.lit("k"), F.lit("q")), True),
    ],
)
def test_expressions(spark, column, want):
    assert value(spark, column()) == want


@pytest.mark.parametrize(
    ("query", "want", "confidence"),
    [
        ("", "chitchat", 0.99),
        ("!!!", "chitchat", 0.95),
        ("hello", "greeting", 0.8),
        ("我要的不是系统介绍", "negation", None),
        ("知识库统计", "meta_query", None),
        ("现在知识库有哪些内容？", "meta_query", None),
        ("RAG 原理", "kb_content", 0.5),
        ("什么是 RAG", "kb_content", 0.65),
        ("怎么用", "system_faq", None),
        ("今天天气怎样", "out_of_scope", None),
        (None, "chitchat", 0.99),
    ],
)
def test_intents(spark, query, want, confidence):
    got = value(spark, I.intent(F.lit(query).cast("string")))
    assert got["intent"] == want and confidence in (None, got["confidence"])


def test_follow_ups(spark):
    ask = lambda q, h: value(spark, I.follow_up(F.lit(q), F.lit(h)))
    assert ask("然后呢", True) and ask("那个怎么办", True) and not ask("然后呢", False) and not ask("什么是它", True)
    rows = [(1, 0, "user", "how are graphs built?"), (1, 1, "assistant", "so"), (1, 2, "user", "然后呢"), (2, 0, "user", "hi"), (2, 1, "user", "举个例子")]
    got = {(r["conv_id"], r["turn"]): r["query"] for r in S.expanded_queries(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert got == {(1, 0): "how are graphs built?", (1, 2): "how are graphs built? 然后呢", (2, 0): "hi", (2, 1): "举个例子"}


def test_keyword_scores(spark):
    docs = spark.createDataFrame([(1, "alpha beta"), (2, "ALPHA " * 40 + "beta gamma delta"), (3, "none"), (4, None)], "doc_id long, content string")
    assert [(r["doc_id"], r["score"]) for r in R.keyword_search(docs, "alpha", 5).collect()] == [(2, 0.85), (1, 0.58)]
    assert R.keyword_search(docs, "alpha, beta、gamma delta", 5).first()["score"] == 0.95
    assert R.keyword_search(docs, "  ", 5).collect() == []
    assert R.rewritten("什么是大模型") == ["什么是大模型"] and R.rewritten("大模型") == ["大模型", "LLM"]
    assert R.terms_of("图谱的 RAG a") == ["rag", "图", "图谱", "谱"]


def test_threshold_fusion_and_coverage(spark):
    hits = spark.createDataFrame([(0, 1, 0.90), (0, 2, 0.85), (0, 3, 0.83), (1, 1, 0.21), (1, 2, 0.19)], "query_id int, doc_id long, score double")
    assert {(r["query_id"], r["doc_id"]) for r in R.above_threshold(hits).collect()} == {(0, 1), (0, 2), (1, 1)}
    side = lambda rows: spark.createDataFrame(rows, "query_id int, doc_id long, rank int, score double")
    fused = {r["doc_id"]: r for r in R.fuse(side([(0, 7, 1, 0.9)]), side([(0, 7, 1, 0.6), (0, 8, 2, 0.5)])).collect()}
    assert fused[7]["rrf_score"] == round(2 / 61, 9) and fused[8]["vector_score"] is None
    assert value(spark, R.display_score(F.lit(None).cast("double"))) == 0.5
    factors = [value(spark, F.round(R.length_factor(F.lit(n)), 4)) for n in (49, 50, 2050, 5000, 5001)]
    assert factors == [1.0, 1.0, 1.1, 1.1, 1.0]
    docs = spark.createDataFrame([(0, k, "nothing") for k in range(1, 6)], "query_id int, rank int, content string")
    assert R.covered(docs, "topic").count() == 3


def test_vector_top_k_in_blocks(spark, monkeypatch):
    vectors = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0]) for k in range(40)], "vec_id long, embedding array<double>")
    queries = vectors.filter("vec_id < 9").selectExpr("vec_id AS query_id", "embedding AS query")
    whole = {tuple(r) for r in R.vector_top_k(queries, vectors, 3).collect()}
    monkeypatch.setattr(R, "BLOCK_BYTES", 64)
    monkeypatch.setattr(R, "SCORES", 7)
    assert {tuple(r) for r in R.vector_top_k(queries, vectors, 3).collect()} == whole and len(whole) == 27


def test_hash_embedding(spark):
    docs = spark.createDataFrame([(1, "ab a"), (2, " "), (3, "ab a")], "d long, t string")
    cells = V.hash_embedding(docs, "d", "t").collect()
    assert {r["d"] for r in cells} == {1, 3}
    assert abs(sum(r["weight"] ** 2 for r in cells if r["d"] == 1) - 1) < 1e-6
    assert set(value(spark, V.hash_tokens(F.lit("Ab a")))) == {"c:A", "c:b", "c:a", "b:Ab", "b:b ", "b: a", "w:ab", "w:a"}


def _graph(spark):
    nodes = [("doc_1", "One", "文档", "document", 1), ("doc_2", "Two", "文档", "document", 2), *((n, n.upper(), "概念", "entity", None) for n in "abcde")]
    edges = [("doc_1", "a", "提及"), ("doc_2", "a", "提及"), ("a", "b", "x"), ("b", "c", "x"), ("c", "d", "x"), ("doc_1", "doc_2", "x"), ("a", "b", "x")]
    return spark.createDataFrame(nodes, "id string, name string, type string, category string, doc_id long"), G.distinct_edges(spark.createDataFrame(edges, "source string, target string, type string"))


def test_graph(spark):
    nodes, edges = _graph(spark)
    assert edges.count() == 6
    reached, met = G.expand(nodes, edges.filter("type = 'x' AND source <> 'doc_1'"), spark.createDataFrame([("a",)], "id string"), 2)
    assert {(r["id"], r["distance"]) for r in reached.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r["source"], r["target"]) for r in met.collect()} == {("a", "b"), ("b", "c")}
    with pytest.raises(ValueError):
        G.expand(nodes, edges, nodes, 4)
    assert [r["id"] for r in G.orphan_entities(nodes, edges).collect()] == ["e"]
    left = G.without(nodes, edges, G.ghosts(nodes, spark.createDataFrame([(1,)], "doc_id long")))
    assert left[0].count() == 6 and left[1].filter("source = 'doc_2' OR target = 'doc_2'").count() == 0
    assert G.no_document_pairs(nodes, edges).filter("source = 'doc_1'").count() == 1
    merged = G.merge_synonyms(nodes, edges, (("B", "A"), ("E", "Else")))
    assert {r["name"] for r in merged[0].collect()} == {"One", "Two", "A", "C", "D", "Else"}
    assert ("a", "c") in {(r["source"], r["target"]) for r in merged[1].collect()}
    assert [tuple(r) for r in G.shared_entities(edges).collect()] == [("a", 2)]
    assert {r["id"] for r in G.remove_document(nodes, edges, 1)[0].collect()} == {"doc_2", "a", "b", "c", "d"}
    told = nodes.withColumn("description", F.lit("a long description"))
    from_docs = lambda k: spark.createDataFrame([("e", k)], "id string, doc_id long")
    assert [r["id"] for r in G.unfounded(told, edges, from_docs(2)).collect()] == []
    assert [r["id"] for r in G.unfounded(told, edges, from_docs(9)).collect()] == ["e"]
    words = spark.createDataFrame([("Alpha", "alpha beta the beta")], "t string, c string")
    assert words.select(G.keywords(F.col("t"), F.col("c"))).first()[0] == ["Alpha", "beta"]
    assert words.select(G.keywords(F.lit("a b 12345678"), F.lit("of"))).first()[0] == ["a b 1234"]
    pairs = G.candidate_pairs(spark.createDataFrame([("s", 1), ("s", 2), ("a", 1), ("b", 2), ("s", 3), ("a", 3)], "id string, doc_id long"), 20)
    assert {(r["shared"], r["a"], r["b"]) for r in pairs.collect()} == {("s", "a", "b"), ("a", "s", "s"), ("s", "a", "a")}


def test_versions_bin_and_tags(spark):
    start = datetime(2024, 1, 1)
    versions = spark.createDataFrame([(1, start + timedelta(days=k), f"v{k}") for k in range(51)], "doc_id long, at timestamp, content string")
    kept = L.number_versions(versions)
    assert sorted(r["version"] for r in kept.collect()) == list(range(2, 52))
    back = L.roll_back(kept.select("doc_id", "version", "content"), 1, 5)
    assert back.filter("version = 52").first()["content"] == "v4"
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    items = spark.createDataFrame([(1, datetime(2024, 6, 1)), (2, datetime(2024, 6, 2)), (3, datetime(2024, 5, 1))], "doc_id long, expires_at timestamp").withColumn("deleted_at", F.col("expires_at"))
    assert [r["doc_id"] for r in L.listed_bin(items, now).collect()] == [2]
    assert {r["doc_id"] for r in L.purged_bin(items, now).collect()} == {1, 2}
    assert value(spark, L.map_changes(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(3), F.lit("c"), F.lit(4)))) == ["b", "c"]
    tagged = spark.createDataFrame([(1, [" Red", "blue"]), (2, ["red"])], "doc_id long, tags array<string>")
    tags = spark.createDataFrame([("red",), ("blue",), ("none",)], "tag string")
    assert [tuple(r) for r in L.tag_counts(tags, tagged).collect()] == [("red", 2), ("blue", 1), ("none", 0)]
    assert L.with_tag(tagged, " RED ").count() == 2


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"plain\n\ntext")
    (tmp_path / "b.txt").write_bytes("中文".encode("gbk"))
    (tmp_path / "c.md").write_text("intro\n# A\nx\n## B\ny")
    texts = {r["path"].rsplit("/", 1)[1]: r["text"] for r in files.read_texts(spark, str(tmp_path / "*.txt")).collect()}
    assert texts == {"a.txt": "plain\n\ntext", "b.txt": "中文"}
    assert [(r["section_title"], r["text"]) for r in files.document_pages(spark, str(tmp_path / "c.md"), "md").collect()] == [(None, "intro"), ("A", "# A\nx"), ("B", "## B\ny")]
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f"<w:p><w:pPr>{s}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{p('before')}{p('Title', '<w:pStyle w:val=\"Heading1\"/>')}{p('body')}</w:body></w:document>")
    (tmp_path / "e.docx").write_bytes(b"broken")
    pages = {(r["path"][-6:], r["section_title"], r["text"]) for r in files.document_pages(spark, str(tmp_path / "*.docx"), "docx").collect()}
    assert pages == {("d.docx", None, "before"), ("d.docx", "Title", "body"), ("e.docx", None, "[unreadable: BadZipFile]")}
    with pytest.raises(ValueError):
        files.document_pages(spark, str(tmp_path), "exe")
    rows = spark.range(45).select("id", F.lit("v").alias("x"), F.lit("").alias("y"))
    assert [(r["page_number"], len(r["text"].split("\n")), r["total_rows"]) for r in files.csv_pages(rows, "id").orderBy("page_number").collect()] == [(1, 20, 45), (2, 20, 45), (3, 5, 45)]
    (tmp_path / "log.json").write_text('{"ts": 1.5, "action": "a"}\nnot json\n{"ts": 2, "action": "b"}\n')
    assert {r["action"] for r in files.read_audit(spark, str(tmp_path / "log.json")).collect() if r["action"]} == {"a", "b"}
    (tmp_path / "graph.json").write_text(json.dumps({"nodes": [{"id": "a"}], "edges": [{"source": "a", "target": "b"}]}))
    assert [x.count() for x in files.read_graph(spark, str(tmp_path / "graph.json"))] == [1, 1]
    store = spark.createDataFrame([(["i"], ["c"], [[1.0]])], "ids array<string>, chunks array<string>, embeddings array<array<double>>")
    assert files.read_columnar_store(store).first()["content"] == "c"


def test_streams_over_several_batches(spark, tmp_path):
    rows = [(1, 0, "a", False), (2, 0, "x", False), (1, 1, "b", False), (1, 2, "c", True)]
    schema = "task_id long, seq long, piece string, done boolean"
    for k, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    J.ingest(stream, lambda b: b, f"{tmp_path}/tokens", f"{tmp_path}/work")
    out = J.assembled(spark.read.parquet(f"{tmp_path}/tokens"))
    assert {(r["task_id"], r["text"], r["done"]) for r in out.collect()} == {(1, "abc", True), (2, "x", False)}
    late = spark.createDataFrame([*reversed(rows), rows[0], (3, 0, None, None)], schema)
    assert {(r["task_id"], r["text"], r["done"]) for r in J.assembled(late).collect()} == {(1, "abc", True), (2, "x", False), (3, "", False)}
    events = J.answer_events(spark.createDataFrame(rows, schema), spark.createDataFrame([(1, 2), (2, 0)], "task_id long, n_sources int"))
    assert [(r["kind"], r["payload"]) for r in events.filter("task_id = 2").orderBy("n").collect()] == [("metadata", "0"), ("text", "x"), ("error", "")]
    times = spark.createDataFrame([(k, datetime(2024, 1, 1) + timedelta(seconds=s)) for k, s in enumerate((0, 300, 301, 600, 602))], "id long, ts timestamp")
    hits = {r["id"]: r["hit"] for r in cache.cache_replay(times, F.lit("q")).collect()}
    assert hits == {0: False, 1: True, 2: False, 3: True, 4: False}
    mixed = {r["id"]: r["hit"] for r in cache.cache_replay(times, F.when(F.col("id") == 1, "other")).collect()}
    assert mixed == {0: False, 1: False, 2: False, 3: True, 4: False}


def test_queries_have_sql_of_their_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 80


def test_bin_bases_and_categories(spark):
    docs = spark.createDataFrame([(1, "a", "x", "one"), (2, None, "y", "two")], "doc_id long, category string, kb_id string, content string")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    old = L.to_bin(docs.filter("doc_id = 1").withColumn("doc_id", F.lit(7).cast("long")), now - F.expr("INTERVAL 7 DAYS"))
    items = L.to_bin(docs.filter("doc_id = 2").withColumn("doc_id", F.lit(8).cast("long")), now).unionByName(old)
    wanted = spark.createDataFrame([(7, 70), (8, 80), (8, 80), (9, 90)], "doc_id long, new_id long")
    live, left = L.restored(docs, items, wanted, now)
    assert sorted(r["doc_id"] for r in live.collect()) == [1, 2, 80] and [r["doc_id"] for r in left.collect()] == [7]
    assert live.filter("doc_id = 80").first().asDict() == {"doc_id": 80, "category": None, "kb_id": "y", "content": "two"}
    moved, chunks = L.moved_to_base(docs, docs, wanted.withColumn("doc_id", F.lit(1).cast("long")), "z")
    assert sorted((r["doc_id"], r["kb_id"]) for r in moved.collect()) == sorted((r["doc_id"], r["kb_id"]) for r in chunks.collect()) == [(1, "z"), (2, "y")]
    assert [r["doc_id"] for r in L.without_base(docs, docs, "x")[0].collect()] == [2]
    names = spark.createDataFrame([("a",), ("d",)], "name string")
    assert [[r["name"] for r in L.without_category(names, docs, n, "d")[0].collect()] for n in ("a", "d")] == [["d"], ["a", "d"]]
    assert [r["category"] for r in L.without_category(names, docs, "a", "d")[1].orderBy("doc_id").collect()] == ["d", None]
