import random

from pyspark.sql import functions as F
from walk import walk

from patchlake.functions import text as T
from patchlake.operators import diff, match

PIECES = ["diff --git a/x.py b/x.py", "diff --git a/y b/z", "diff --git odd", "--- a/x.py", "+++ b/x.py", "--- a/q.c\t2020", "+++ /dev/null", "--- /dev/null", "--- plain", "@@ -1,2 +1,2 @@", "@@ -1 +1 @@ f", "@@ -0,0 +1,2 @@", "@@ -3,0 +3,0 @@", "@@", "@@ bad", "+new", "-old", " same", "+", "-- a/x", "\\ No newline at end of file", "rename from r1", "rename to r2", "words", ""]


def test_parser_agrees_with_a_walk_over_the_lines(spark):
    rng = random.Random(5)
    texts = ["\n".join(rng.choices(PIECES, k=rng.randint(0, 14))) + rng.choice(["", "\n"]) for _ in range(600)]
    texts += ["", "a\r\nb", "--- a/x\x0b+++ b/x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, diff string")
    rows = diff.diff_lines(diff.read_rows(df, ["id"]), ["id"]).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.id, r.line_ord)):
        got.setdefault(r.id, []).append((r.file_ord, r.hunk_index, r.line_ord, r.operation, r.text, r.old_path, r.new_path, r.old_line_number, r.new_line_number))
    for i, t in enumerate(texts):
        assert got.get(i, []) == walk(t), (i, t)


def test_units_of_a_rename_come_first_and_blank_lines_have_no_number(spark):
    text = "diff --git a/o.py b/n.py\nrename from o.py\nrename to n.py\n--- a/o.py\n+++ b/n.py\n@@ -1,2 +1,4 @@\n-x  =\t1\n+\n+y\n z\n+w\n"
    df = spark.createDataFrame([(1, text)], "id long, diff string")
    units = diff.change_units(diff.read_rows(df, ["id"]), ["id"], "suggested").orderBy("unit").collect()
    assert [(u.unit_id, u.kind, u.path, u.text) for u in units] == [("suggested-1", "rename", "n.py", "o.py -> n.py"), ("suggested-2", "deletion", "o.py", "x = 1"), ("suggested-3", "addition", "n.py", "y"), ("suggested-4", "addition", "n.py", "w")]


def test_strict_then_relaxed_matches(spark):
    side = lambda *paths: "".join(f"--- a/{p}\n+++ b/{p}\n@@ -0,0 +1 @@\n+same()\n" for p in paths)
    pairs = spark.createDataFrame([(1, side("a.py", "b.py"), side("b.py", "c.py"))], "id long, s string, m string")
    s = diff.change_units(diff.read_rows(pairs, ["id"], "s"), ["id"], "suggested")
    m = diff.change_units(diff.read_rows(pairs, ["id"], "m"), ["id"], "landed")
    found = match.match_units(s, m, ["id"])
    assert sorted((r.suggested_path, r.landed_path, r.scope) for r in found.collect()) == [("a.py", "c.py", "relaxed_cross_file"), ("b.py", "b.py", "strict_same_file")]
    row = match.coverage(pairs, s, found, ["id"]).first()
    assert (row.strict_percentage, row.relaxed_percentage, row.coverage_percentage, row.moved_units) == (50, 50, 100, 1)


def test_paths(spark):
    cases = {'"a/t\\303\\244b.py"': "täb.py", "a/x.py\t2020": "x.py", "/dev/null": None, "": None, '"b/q\\"t\\\\.c"': 'q"t\\.c', "plain": "plain"}
    df = spark.createDataFrame(list(cases.items()), "raw string, want string").withColumn("got", T.normal_path(F.col("raw")))
    assert [(r.raw, r.got) for r in df.collect()] == list(cases.items())


def test_languages_and_fingerprints(spark):
    cases = {"a/B.PY": "python", "Dockerfile": "dockerfile", "Jenkinsfile": "groovy", "jenkinsfile": "text", "x/.py": "text", "k.yml": "yaml", "m.": "text"}
    df = spark.createDataFrame(list(cases.items()), "path string, want string").withColumn("got", T.language(F.col("path")))
    assert {r.path: r.got for r in df.collect()} == cases
    two = spark.createDataFrame([("a  \nb\n",), ("a\nb ",)], "t string")
    assert two.select(T.exact_fingerprint(F.col("t")).alias("f")).distinct().count() == 1
