"""A store's entries are read for their digest and once more, however many are good or bad."""

from pyspark.sql import functions as F

from loreweave.operators import migrations as M


def test_entries_are_mapped_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def told(k: int) -> str:
        seen.add(1)
        return '{"migrated_count": "%s", "time": "2024-01-02T03:04:05"}' % (k if k % 10 else "x")

    entries = spark.range(40).select(F.col("id").cast("string").alias("key"), F.udf(told)(F.col("id")).alias("entry"))
    made = M.Migration(spark, str(tmp_path / "db"))
    assert made.run(M.ENTITIES["op_log"], entries) == (40, 36, 4)
    assert seen.value == 80
    rejects = made.table("rejects", M.REJECTS).read()
    assert sorted(map(tuple, rejects.select("key", "problem").collect())) == [(k, "migrated_count is no int") for k in ("0", "10", "20", "30")]
    assert rejects.filter("entry LIKE '%\"x\"%'").count() == 4
