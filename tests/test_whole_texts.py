"""Queries over whole texts, against plain versions."""

import hashlib
import math
import re

import pytest

from loreweave.plans import hybrid


def _embed(text, dim=512):
    text, vec = text.strip(), [0.0] * dim
    tokens = {f"c:{c}" for c in text if c.strip()} | {f"b:{text[i : i + 2]}" for i in range(len(text) - 1) if text[i : i + 2].strip()}
    tokens |= {f"w:{w.lower()}" for w in re.findall(r"[A-Za-z0-9]+|[一-鿿]+", text)}
    for t in tokens:
        h = int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
        vec[h % dim] += -1 if h & 0x80000000 else 1
    norm = math.sqrt(sum(v * v for v in vec)) + 1e-8
    return {i: v / norm for i, v in enumerate(vec) if v}


TEXTS = ["x" * 500 + " worthless and the thinking", "Worthless AND the Thinking", "　 漢字かな Ab  cD\xa0\n", "filler " * 400 + "worthless and the thinking " * 30, "", "Q", "worthless and the thinking"]


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_embeddings_cover_whole_texts_and_keep_case(spark, folder):
    got = {(r["doc_id"], r["idx"]): r["weight"] for r in hybrid.hash_embed_whole(spark, folder).collect()}
    assert got == pytest.approx({(k, i): w for k, t in enumerate(TEXTS) for i, w in _embed(t).items()}, abs=2e-6)


def test_vector_channel_meets_what_lies_behind_400_characters(spark, folder):
    asked = _embed(hybrid.QUESTION)
    want = {k: sum(w * asked.get(i, 0) for i, w in _embed(t).items()) for k, t in enumerate(TEXTS)}
    floor = max(0.2, max(want.values()) - 0.06)
    got = {r["doc_id"]: r["vector_score"] for r in hybrid.rrf_fuse_whole(spark, folder).collect() if r["vector_score"] is not None}
    assert got == pytest.approx({k: w for k, w in want.items() if w >= floor and w > 0}, abs=2e-6)
    assert "6" in {r["id"] for r in hybrid.hybrid_search_whole(spark, folder).collect()}


def test_hits_of_chunks_add_up_and_join_their_texts(spark):
    from loreweave.operators import retrieval as R

    near = spark.createDataFrame([(0, 7, 1, 0.9, "one two"), (0, 7, 2, 0.8, "two"), (0, 8, 3, 0.7, "three"), (0, 7, 4, 0.6, "four")], "query_id int, doc_id long, rank int, score double, text string")
    words = spark.createDataFrame([(0, 8, 1, 0.95, "three and five"), (0, 9, 2, 0.5, "six")], "query_id int, doc_id long, rank int, score double, snippet string")
    found = {r["doc_id"]: r for r in R.fuse_chunks(near, words).collect()}
    assert found[7]["content"] == "one two\n...\nfour" and found[7]["rrf_score"] == round(1 / 61 + 1 / 62 + 1 / 64, 9) and found[7]["source"] == "vector"
    assert found[8]["content"] == "three\n...\n[关键词命中]: three and five" and found[8]["source"] == "hybrid" and found[8]["vector_score"] == 0.7
    assert found[9]["content"] == "six" and found[9]["vector_score"] is None and found[9]["source"] == "keyword"
