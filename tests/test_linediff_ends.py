"""Lines that both texts begin or end with are not dealt out to be aligned."""

from pyspark.sql import functions as F

from loreweave.operators import linediff as D


def test_only_lines_between_are_aligned(spark, monkeypatch):
    counts = []
    kept = D.written_once
    monkeypatch.setattr(D, "written_once", lambda df: counts.append(df.count()) or kept(df))
    same = [f"l{k}" for k in range(50)]
    pairs = [(1, same, [*same, "more"]), (2, same, [*same[:20], "x", "l30", "y", *same[21:]]), (3, ["a"], ["a"]), (4, ["a", "a"], ["a"]), (5, [*same, "b", "m", "c"], [*same, "c", "m", "b"])]
    df = spark.createDataFrame([(k, "\n".join(o), "\n".join(w)) for k, o, w in pairs], "k int, old string, new string")
    rows = D.line_changes(df, "k")
    assert max(counts) <= 10  # of 211 lines
    for k, old, new in pairs:
        own = rows.filter(F.col("k") == k).orderBy("place").collect()
        assert [r["place"] for r in own] == list(range(1, len(own) + 1))
        assert [r["line"] for r in own if r["op"] != "+"] == old and [r["line"] for r in own if r["op"] != "-"] == new
        assert all(r["old_no"] is None or old[r["old_no"] - 1] == r["line"] for r in own) and all(r["new_no"] is None or new[r["new_no"] - 1] == r["line"] for r in own)
    assert dict(rows.groupBy("k").agg(F.count_if(F.col("op") == " ")).collect()) == {1: 50, 2: 49, 3: 1, 4: 1, 5: 51}
