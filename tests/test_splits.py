"""Splits against a plain loop over sorted groups, and fenced comments."""

import hashlib

import pytest

from patchlake.operators import diff, splits

SHARES = {"train": 0.60, "development": 0.15, "calibration": 0.10, "test": 0.15}


def by_time(groups):
    names = [s for s in SHARES if len(groups) > 3 or s != "calibration"]
    rows, out, at, taken, goal = sum(n for _, n, _ in groups), {}, 0, 0, 0.0
    groups = sorted(groups, key=lambda g: (g[2], g[0]))
    for i, s in enumerate(names):
        goal += SHARES[s] / sum(SHARES[x] for x in names)
        mine = 0
        while at < len(groups) - (len(names) - i - 1) and (i == len(names) - 1 or not mine or taken < round(rows * goal)):
            out[groups[at][0]] = s
            taken, mine, at = taken + groups[at][1], mine + 1, at + 1
    return out


def by_seed(groups, seed):
    names = [s for s in SHARES if len(groups) > 3 or s != "calibration"]
    whole, rows = sum(SHARES[s] for s in names), sum(n for _, n, _ in groups)
    left, out = {s: SHARES[s] / whole * rows for s in names}, {}
    for k, (name, n, _) in enumerate(sorted(groups, key=lambda g: (-g[1], hashlib.sha256(f"{seed}:{g[0]}".encode()).hexdigest()))):
        s = names[k] if k < len(names) else max(names, key=lambda x: left[x])
        left[s] -= n
        out[name] = s
    return out


@pytest.mark.parametrize("sizes", [[5, 1, 1], [1, 1, 1, 97], [90, 1, 1, 1, 1], [3, 9, 2, 7, 7, 7, 1, 4, 4, 30, 2, 2, 5, 6]])
def test_splits(spark, sizes):
    groups = [(f"g{i}", n, i * 7 % 5) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(groups, "component string, n long, latest int")
    assert dict(splits.temporal_splits(df).collect()) == by_time(groups)
    assert dict(splits.seeded_splits(df, 7).collect()) == by_seed(groups, 7)


def test_too_few_groups_and_unknown_times(spark):
    with pytest.raises(ValueError):
        splits.seeded_splits(spark.createDataFrame([("a", 1), ("b", 1)], "component string, n long"))
    with pytest.raises(ValueError):
        splits.temporal_splits(spark.createDataFrame([("a", 1, None), ("b", 1, 2), ("c", 1, 3)], "component string, n long, latest int"))


def test_fences(spark):
    text = "a\n```suggestion\n x\ny \n```\n```PATCH\n--- a/q\n+++ b/q\n```\n```diff\n@@\n+z\n```\n```python\nno\n```\n"
    made = diff.comment_suggestions(spark.createDataFrame([(1, text, "p"), (2, text, None), (3, "```diff\n\n```", None), (4, None, "p")], "id int, body string, path string"), ["id"], "body", "path")
    head = "--- a/p\n+++ b/p\n"
    assert {(r.id, r.n): r["diff"] for r in made.collect()} == {
        (1, 1): head + "@@\n+x\n+y", (1, 2): "--- a/q\n+++ b/q", (1, 3): head + "@@\n+z",
        (2, 1): "x\ny", (2, 2): "--- a/q\n+++ b/q", (2, 3): "@@\n+z",
    }
