"""The replay of the cache against one that is kept request by request."""

import random
from collections import OrderedDict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreweave.operators import cache


def kept(requests, seconds, most):
    """An ordered dictionary, as the cache itself is one."""
    held, hits = OrderedDict(), {}
    for n, s, k in sorted(requests, key=lambda r: (r[1], r[0])):
        fresh = k in held and s - held[k] <= seconds
        hits[n] = fresh
        if not fresh:
            held[k] = s
        held.move_to_end(k)
        while most and len(held) > most:
            held.popitem(last=False)
    return hits


def replayed(spark, requests, **options):
    frame = spark.createDataFrame(requests, "id long, ts double, k string")
    return {r["id"]: r["hit"] for r in cache.cache_replay(frame, F.col("k"), **options).collect()}


@pytest.mark.parametrize("most", [1, 3, 8, None])
def test_hits_are_those_of_a_kept_cache(spark, most):
    rng = random.Random(most)
    keys = ["hot"] * 25 + [f"k{i}" for i in range(12)]
    requests = [(n, rng.randrange(900) + rng.choice([0.0, 0.5]), rng.choice(keys)) for n in range(700)]
    want = kept(requests, 40, most)
    assert replayed(spark, requests, seconds=40, most=most, rows_per_slice=60) == want
    assert 0.05 < np.mean(list(want.values())) < 0.95


def test_an_entry_lives_to_its_last_second(spark):
    requests = [(0, 0.0, "a"), (1, 300.0, "a"), (2, 300.000001, "a"), (3, 900.0, "b"), (4, 901.0, None), (5, 902.0, ""), (6, None, "a")]
    assert replayed(spark, requests) == {0: False, 1: True, 2: False, 3: False, 4: False, 5: True, 6: False}
    assert replayed(spark, requests[:0]) == {} and replayed(spark, requests[-1:]) == {6: False}
    with pytest.raises(ValueError):
        replayed(spark, requests, most=0)


def test_counts_before():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 100, 257):
        v = rng.integers(-1, 30, n)
        assert cache.smaller_before(v).tolist() == [int((v[:i] < v[i]).sum()) for i in range(n)]
