"""Line differences: an alignment that gives both texts back, as good as can be where lines are unique."""

import difflib
import random

import pytest

from loreweave.operators import linediff as D


def common(a, b):
    """The length of a longest common subsequence, by a table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def edited(rng, lines, word):
    out = list(lines)
    for _ in range(rng.randrange(6)):
        k = rng.randrange(len(out) + 1)
        what = rng.randrange(4)
        if what == 0:
            out.insert(k, word())
        elif what == 1:
            del out[k : k + rng.randrange(4)]
        elif what == 2 and out:
            out[k % len(out)] = word()
        else:  # a block moves
            block = out[k : k + 5]
            del out[k : k + 5]
            at = rng.randrange(len(out) + 1)
            out[at:at] = block
    return out


@pytest.mark.parametrize("repeated", [False, True])
def test_alignments(spark, repeated):
    rng = random.Random(repeated)
    numbers = iter(range(10**6))
    word = lambda: rng.choice(["", "a", "b", "c"]) if repeated else f"line {next(numbers)}"
    pairs = []
    for k in range(60):
        old = [word() for _ in range(rng.randrange(1, 30))]
        pairs.append((k, "\n".join(old), "\n".join(edited(rng, old, word))))
    pairs += [(100, None, ""), (101, "x", None), (102, "same\ntext\n", "same\ntext\n")]
    changes = D.line_changes(spark.createDataFrame(pairs, "k long, old string, new string"), "k")
    rows = {}
    for r in changes.orderBy("k", "place").collect():
        rows.setdefault(r["k"], []).append(r)
    counts = {r["k"]: (r["added"], r["removed"]) for r in D.change_counts(changes, "k").collect()}
    diffs = {r["k"]: r["diff"] for r in D.unified(changes, "k").collect()}
    for k, old, new in pairs:
        a, b = (old or "").split("\n"), (new or "").split("\n")
        mine = rows[k]
        assert [r["line"] for r in mine if r["op"] != "+"] == a and [r["line"] for r in mine if r["op"] != "-"] == b
        assert [r["old_no"] for r in mine if r["op"] != "+"] == list(range(1, len(a) + 1)) and [r["new_no"] for r in mine if r["op"] != "-"] == list(range(1, len(b) + 1))
        kept = sum(r["op"] == " " for r in mine)
        assert counts[k] == (len(b) - kept, len(a) - kept)
        assert kept == common(a, b) if not repeated else kept <= common(a, b)
        # The text of a diff is what an alignment of this kind is written as.
        if kept == len(a) == len(b):
            assert diffs[k] == ""
        else:
            assert diffs[k] == written(mine)


def written(rows, context=3):
    """The rows' diff in the usual form, hunk by hunk."""
    near = sorted({j for i, r in enumerate(rows) if r["op"] != " " for j in range(max(0, i - context), min(len(rows), i + context + 1))})
    out = ["--- old", "+++ new"]
    for n, i in enumerate(near):
        if n == 0 or near[n - 1] != i - 1:
            j = i
            while j + 1 in near:
                j += 1
            a0, b0 = sum(r["op"] != "+" for r in rows[:i]), sum(r["op"] != "-" for r in rows[:i])
            an, bn = sum(r["op"] != "+" for r in rows[i : j + 1]), sum(r["op"] != "-" for r in rows[i : j + 1])
            out.append(f"@@ -{difflib._format_range_unified(a0, a0 + an)} +{difflib._format_range_unified(b0, b0 + bn)} @@")
        out.append(rows[i]["op"] + rows[i]["line"])
    return "\n".join(out)


def test_one_change_reads_as_usual(spark):
    old = [f"l{k}" for k in range(40)]
    new = [*old[:10], "x", *old[11:30], "y", *old[30:]]
    got = D.unified(D.line_changes(spark.createDataFrame([("p", "\n".join(old), "\n".join(new))], "k string, old string, new string"), "k"), "k").first()["diff"]
    assert got == "\n".join(difflib.unified_diff(old, new, "old", "new", lineterm=""))
    none = D.line_changes(spark.createDataFrame([], "k string, old string, new string"), "k")
    assert none.collect() == [] and D.unified(none, "k").collect() == []


def test_rising():
    rng = random.Random(3)
    for _ in range(200):
        v = rng.sample(range(50), rng.randrange(20))
        run = [v[k] for k in D.rising(v)]
        assert run == sorted(run) and len(run) == common(v, sorted(v))
