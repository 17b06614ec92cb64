"""Look-ups, projections, and texts that are cleaned piece by piece."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loreweave.functions import intent as I
from loreweave.functions.text import STREAMED, without_placeholders
from loreweave.operators import catalogue as K
from loreweave.streaming.cleaning import clean_stream, cleaned


def test_any_split_gives_the_cleaned_whole(spark):
    rng = random.Random(4)
    parts = ["[object Object]", "[object  x_1]", "[object ]", "<null>", "<nul", "<empty>", "<undefined>", "[", "<", "text ", "[obj", "object x]", "é", "<b>", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(9)))
        want = re.sub(STREAMED, "", text, flags=re.ASCII)
        cuts = sorted(rng.randrange(len(text) + 1) for _ in range(rng.randrange(7)))
        held, out = "", []
        for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
            given, held = cleaned(held, text[a:b])
            out.append(given)
        assert "".join(out) + held == want
    assert spark.range(1).select(without_placeholders(F.lit("a<null>b[object X]"))).first()[0] == "ab"


def test_pieces_of_several_batches(spark, tmp_path):
    schema = "task_id string, seq long, piece string, done boolean"
    batches = [[("a", 1, "ject ", False), ("a", 0, "x[ob", False), ("b", 0, "<nu", False)], [("a", 2, "Object]y<", False), ("b", 1, "ll>z", True)], [("a", 3, None, True), ("c", 0, "[object", True)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = clean_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    found = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect():
        found[r["task_id"]] = found.get(r["task_id"], "") + r["piece"]
    assert found == {"a": "xy<", "b": "z", "c": "[object"}


def test_permissions_roles_and_tags(spark, tmp_path):
    users = spark.createDataFrame([(1, ["viewer"]), (2, ["editor", "viewer"]), (3, ["admin"]), (4, []), (5, ["nobody"])], "user_id long, roles array<string>")
    allowed = lambda *p: {r["user_id"]: r["allowed"] for r in K.with_any_permission(users, list(p)).collect()}
    assert allowed("doc:write", "user:read") == {1: False, 2: True, 3: True, 4: False, 5: False}
    assert allowed("doc:read") == {1: True, 2: True, 3: True, 4: False, 5: False} and allowed() == {1: False, 2: False, 3: True, 4: False, 5: False}
    assert {r["role"]: len(r["permissions"]) for r in K.roles(spark).collect()} == {"admin": 16, "editor": 11, "viewer": 7} and K.tag_dimensions(spark).count() == 5
    tags = spark.createDataFrame([("ai", "AI", "blue", 3), ("db", None, "red", 0)], "tag string, label string, color string, doc_count long")
    K.write_tags(tags, str(tmp_path / "t"))
    back = K.read_tags(spark, str(tmp_path / "t"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, tags.collect())) and K.tag_of(back, "  AI ").first()["doc_count"] == 3
    (tmp_path / "bad").write_text("no json")
    assert K.read_tags(spark, str(tmp_path / "bad")).collect() == []
    assert K.base_of(spark.createDataFrame([("k", "n")], "id string, name string"), "k").count() == 1


def test_rows_metadata_and_messages(spark):
    hits = spark.createDataFrame([(1, None, "x" * 600, None, None), (2, "t", None, "c", 0.5)], "doc_id long, title string, content string, category string, score double")
    first, second = K.result_rows(hits).orderBy("document.id").collect()
    assert (len(first["snippet"]), first["document"]["title"], first["document"]["category"], first["score"]) == (500, "未知文档", "默认", 0.0) and second["score"] == 0.5
    row = spark.range(1).select(K.plain_metadata(F.create_map(F.lit("a"), F.lit("1"), F.lit("n"), F.lit(None).cast("string"), F.lit("l"), F.lit("old")), F.create_map(F.lit("l"), F.array(F.lit("x"), F.lit(None), F.lit("y")))).alias("m")).first()
    assert row["m"] == {"a": "1", "l": "x,None,y"}
    messages = spark.createDataFrame([(1, k, "user" if k % 2 == 0 else "assistant", f"m{k}") for k in range(5)], "conv_id long, turn long, role string, text string")
    asked = spark.createDataFrame([(1, "q", "c" * 5000), (2, "new", " ")], "conv_id long, question string, context string")
    rows = [(r["conv_id"], r["n"], r["role"], r["text"][:9]) for r in K.built_messages(messages, asked, "sys", 1).orderBy("conv_id", "n").collect()]
    assert rows == [(1, 0, "system", "sys"), (1, 1, "assistant", "m3"), (1, 2, "user", "m4"), (1, 3, "system", "【知识库参考内容】"), (1, 4, "user", "q"), (2, 0, "system", "sys"), (2, 1, "user", "new")]
    assert K.chunk_of(spark.createDataFrame([(1, "1_chunk_0"), (2, "2_chunk_0")], "doc_id long, chunk_id string"), 1, "2_chunk_0").collect() == []


@pytest.mark.parametrize(("text", "want"), [("hi hello", ["kw:hi", "kw:hello"]), ("在吗？", ["kw:在吗", "pat:^在[吗么呢]*[?？!！.。\\s]*$"]), ("tree", [])])
def test_matched_rules(spark, text, want):
    assert spark.range(1).select(I.GREETING.matched(F.lit(text))).first()[0] == want
