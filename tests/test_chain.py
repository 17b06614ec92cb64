"""A chain of stages that goes on where it was stopped."""

import pytest
from pyspark.sql import functions as F

from loreweave.operators.chain import Chain


def test_a_stopped_run_goes_on(spark, tmp_path):
    calls = []

    def stage(name, change, broken=False):
        def run(df):
            calls.append(name)
            return df.withColumn("n", F.raise_error(F.lit("stopped")).cast("long") if broken else change(F.col("n")))

        return name, run

    rows = spark.range(5).withColumnRenamed("id", "n")
    make = lambda broken, run="r", last=("last", lambda d: d.agg(F.sum("n").alias("n"))): Chain(spark, str(tmp_path), run, [stage("add", lambda n: n + 1), stage("double", lambda n: 2 * n, broken), last])
    with pytest.raises(Exception, match="stopped"):
        make(True).run(rows)
    assert calls == ["add", "double"] and make(False).finished() == ["add"]
    with pytest.raises(ValueError):
        make(False).output("double")
    assert make(False).run(rows.limit(0)).first()["n"] == 30  # the first stage isn't run again
    assert calls == ["add", "double", "double"] and make(False).finished() == ["add", "double", "last"]
    assert make(False).run(rows).first()["n"] == 30 and len(calls) == 3
    assert sorted(r["n"] for r in make(False).output("double").collect()) == [2, 4, 6, 8, 10]
    # Another last stage keeps those before it; another run keeps none.
    assert make(False, last=("count", lambda d: d.agg(F.count("n").alias("n")))).run(rows).first()["n"] == 5 and len(calls) == 3
    assert make(False, run="s").run(rows.limit(1)).first()["n"] == 2 and len(calls) == 5
    with pytest.raises(ValueError):
        Chain(spark, str(tmp_path), "r", [("a", lambda d: d), ("a", lambda d: d)])
