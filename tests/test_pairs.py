"""What is made from the texts of both diffs of a row, against the same from parsed lines."""

import random

from pyspark.sql import functions as F
from test_diff import PIECES

from patchlake.functions import parse
from patchlake.operators import diff, match, overlap

MORE = ['diff --git "a/t\\303\\244b" "b/t\\303\\244b"', "rename from ", 'rename to "b/x\\tq"', "diff --git a/x /dev/null", "@@ -1,99999999999999999999 +1 @@", "+a b_1 ²x", "+new", "-new  words", "+++ b/"]


def _pairs(spark, n, seed):
    rng = random.Random(seed)
    text = lambda: rng.choice([None, ""]) if rng.random() < 0.03 else "\n".join(rng.choices(PIECES + MORE, k=rng.randint(0, 18)))
    return spark.createDataFrame([(i, text(), text()) for i in range(n)], "id long, suggested string, landed string")


def _rows(df):
    return sorted(map(str, df.collect()))


def test_the_walk_gives_the_rows_of_the_windows(spark):
    pairs = _pairs(spark, 500, 3)
    got = {}
    for r in diff.read_rows(pairs, ["id"], "suggested").collect():
        got.setdefault(r.id, []).append(tuple(r)[1:])
    for r in pairs.collect():
        assert [tuple(x) for x in parse.rows(r.suggested)] == sorted(got.get(r.id, [])), r.suggested


def test_units_and_levels_of_texts(spark):
    pairs = _pairs(spark, 400, 4).cache()
    s, m = diff.read_rows(pairs, ["id"], "suggested"), diff.read_rows(pairs, ["id"], "landed")
    us, um = (diff.change_units(x, ["id"], "u").cache() for x in (s, m))
    found = match.match_units(us, um, ["id"]).cache()
    assert _rows(match.matches_of_texts(pairs, ["id"])) == _rows(found)
    made = match.units_of_texts(pairs, ["id"])
    assert _rows(made.select("id", "unit", "kind", "path", "text")) == _rows(us.select("id", "unit", "kind", "path", "text"))
    assert _rows(match.coverage_of_texts(pairs, ["id"])) == _rows(match.coverage(pairs, us, found, ["id"]))
    old = overlap.compare_diffs(*(diff.diff_lines(x, ["id"]) for x in (s, m)), *(diff.diff_files(x, ["id"]) for x in (s, m)), ["id"]).cache()
    for level in overlap.LEVELS:
        assert _rows(overlap.compare_texts(pairs, ["id"], level)) == _rows(old.filter(F.col("level") == level).drop("level")), level


def test_nothing_is_shuffled(spark):
    few = spark.createDataFrame([(1, "", "")], "id long, suggested string, landed string")
    for made in (match.matches_of_texts(few, ["id"]), match.coverage_of_texts(few, ["id"]), overlap.compare_texts(few, ["id"], "token"), overlap.line_recall_of_texts(few, ["id"])):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_near_forms_of_texts(spark):
    from patchlake.functions import text as T
    from patchlake.operators import groups

    pairs = _pairs(spark, 300, 5)
    lines = diff.diff_lines(diff.read_rows(pairs, ["id"], "suggested"), ["id"]).filter("operation <> 'context'").filter(T.strip(F.col("text")) != "")
    old = lines.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("line_ord", F.concat_ws(" ", "operation", T.near_form(F.col("text"))).alias("f")))).alias("l"))
    assert _rows(groups.near_of_texts(pairs, ["id"], "suggested")) == _rows(old.select("id", F.sha2(F.array_join("l.f", "\n"), 256).alias("near")))


def test_components_read_their_rows_once(spark):
    from patchlake.operators import groups

    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    rows = spark.range(0, 50, 1, 2).select("id", (F.col("id") % 5).cast("string").alias("a"), F.when(F.col("id") < 2, "x").alias("b"))
    made = {r.id: r.component for r in groups.components(rows.mapInArrow(seen, rows.schema), "id", ["a", "b"]).collect()}
    assert made == {i: 0 if i % 5 < 2 else i % 5 for i in range(50)} and reads.value == 50


def test_shapes_need_no_shuffle(spark):
    from patchlake.operators import assess

    few = spark.createDataFrame([(1, None), (2, "--- a/x\n+++ b/x\n@@\n+a\n-b\n@@\n+c"), (3, "diff --git a/o b/n\nrename from o\nrename to n\n@@\n+y\n--- a/p\n+++ b/p\n@@\n+ "), (4, "--- a/x\n+++ b/x\n@@\n c\n+a")], "id long, diff string")
    made = assess.shape_issues(few, ["id"])
    assert {r.id: r.issues for r in made.collect()} == {1: [assess.EMPTY, assess.NOTHING_ADDED], 2: [assess.REMOVES, assess.MANY_HUNKS], 3: [assess.MANY_HUNKS, assess.RENAMES], 4: []}
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_faults_of_texts(spark):
    from patchlake.operators import assess

    more = ["diff --gitx", "---", "@@ -1 +1 @@f", "diff --git a/x y b/x y", *PIECES]
    rng = random.Random(6)
    texts = ["\n".join(rng.choices(more, k=rng.randint(0, 14))) for _ in range(500)] + [None, " "]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, diff string")
    for fragment in (False, True):
        assert _rows(assess.diagnostics_of_texts(df, ["id"], "diff", fragment)) == _rows(assess.diagnostics(df, ["id"], "diff", fragment))
    assert "Exchange" not in assess.diagnostics_of_texts(spark.createDataFrame([(1, "")], df.schema), ["id"])._jdf.queryExecution().executedPlan().toString()
