"""The prefix tree of conversations against one built in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from loreweave.llm import trie

SCHEMA = "conv_id long, turn int, role string, text string, depth int, key string, _at int, _n int, place int, size int, parent int"


def brute(turns):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(rows)] for c, rows in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(own.get(c - int(c - 5 * int(c / 5)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, path in whole.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, own_members in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own_members) - 1) * len(node[-1][1].encode()) if node else 0
    ends = {n: ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(n)) for n, m in members.items()}
    return {(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(ends[n].encode()).hexdigest()) for n, m in members.items()}


def rows(spark, turns):
    return spark.createDataFrame([(*t, 1, "x", 1, 1, 1, 1, 1) for t in turns], SCHEMA)


def built(spark, turns):
    found = [tuple(r) for r in trie.prefix_trie(rows(spark, turns)).collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("slice_", [1024, 4])
def test_against_plain_tree(spark, monkeypatch, slice_):
    monkeypatch.setattr(trie, "SLICE", slice_)
    monkeypatch.setattr(trie, "IDS", 3)
    monkeypatch.setattr(trie, "SHARE", 1000 if slice_ > 4 else 3)
    rng = random.Random(5)
    turns = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "é漢"])) for c in range(60) for t in range(rng.randrange(1, 12))]
    turns += [(c, 0, "user", "alone") for c in range(1000, 1060, 3)]  # far from their five: often without turns
    turns += [(71, t, "user", str(t % 3)) for t in range(90)] + [(75, t, "user", "long" * 9000) for t in range(3)]
    turns += [(-7, 1, "a", "x"), (-3, 1, "a", "x"), (-3, None, "first", "y"), (-3, 1, "a", "x"), (-3, 1, None, "w"), (None, 0, "user", "lost")]
    assert built(spark, turns) == brute(turns)


def test_hot_first_turn_and_ends(spark):
    """Many conversations end at one node, and many differ in the second turn."""
    turns = [(5 * c, 0, "user", "hello") for c in range(300)] + [(5 * c, 1, "user", str(c)) for c in range(150)]
    assert built(spark, turns) == brute(turns)


def test_no_turns(spark):
    assert built(spark, []) == built(spark, [(None, 1, "user", "x")]) == set()
