"""A batch of uploads: its texts are shuffled once, whatever number of tables comes of them."""

import random

from loreweave.streaming import uploads as U

from .test_store_build import _shuffled


def test_texts_are_shuffled_once(spark, tmp_path):
    rng = random.Random(1)
    rows = [(str(k), f"f{k}", "", "src1", "fixed", "en", "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(4000))) for k in range(60)]
    batch = spark.createDataFrame(rows, "task_id string, file_name string, title string, category string, strategy string, kb_id string, content string").repartition(3).persist()
    assert batch.count() == 60
    texts, before = 60 * 4000 * 2, _shuffled(spark)  # at least two bytes a character, compressed as well as can be
    ledger = U.upload_ledger(spark, str(tmp_path / "u"))
    assert ledger.commit(0, U.upload_stages()(batch))
    assert texts * 0.8 < _shuffled(spark) - before < texts * 2.5
    assert ledger.read("documents").count() == 60 and ledger.read("progress").count() == 60 * len(U.STAGES)
