"""Diagnostics of diffs by hand-made cases, each read in both dialects."""

from patchlake.operators import assess, diff

GOOD = "--- a/x.py\n+++ b/x.py\n@@ -1,1 +1,2 @@\n same\n+new\n"
#: diff, then what is wrong with it as (code, line, path, hunk)
CASES = [
    (GOOD, []),
    ("diff --git a/x.py b/x.py\nindex 1..2\n" + GOOD + "diff --git a/y b/y\nrename from y\nrename to z\n", []),
    (GOOD + GOOD.replace("x.py", "y.py"), []),
    ("", [("empty_input", None, None, None)]),
    (" \n\t\n", [("empty_input", None, None, None)]),
    ("some words\nand more", [("non_diff_input", 1, None, None)]),
    ("diff --git x y\n" + GOOD, [("malformed_git_header", 1, None, None)]),
    ("diff --gitx\n" + GOOD, [("malformed_git_header", 1, None, None)]),
    ("diff --git a/a b.py b/a b.py\n" + GOOD, []),
    ("--- x.py\n+++ b/x.py\n@@ -1 +1 @@\n same\n", [("invalid_file_marker", 1, None, None), ("reordered_file_markers", 2, "x.py", None), ("missing_file_marker_pair", 3, "x.py", 1)]),
    ("--- a/\n" + GOOD, [("invalid_file_marker", 1, None, None)]),
    ("diff --git a/x.py b/x.py\n" + GOOD.replace("b/x", "b/q"), [("conflicting_file_path", 3, "q.py", None)]),
    ("diff --git a/x.py b/x.py\n" + GOOD.replace("a/x.py", "/dev/null"), []),
    ("--- a/x.py\n", [("missing_file_marker_pair", 1, "x.py", None)]),
    ("--- a/x.py\n--- a/y.py\n+++ b/y.py\n@@ -1 +1 @@\n same\n", [("missing_file_marker_pair", 1, "x.py", None)]),
    ("@@ -1 +1 @@\n same\n@@ -5 +5 @@\n same\n", [("missing_file_marker_pair", 1, None, 1)]),
    ("--- a/x.py\n+++ b/x.py\n", [("missing_hunk", 2, "x.py", None)]),
    ("+++ b/x.py\n--- a/x.py\n@@ -1 +1 @@\n same\n", [("reordered_file_markers", 1, "x.py", None)]),
    ("diff --git a/x b/y\nrename from x\n", [("partial_rename_metadata", 2, "y", None)]),
    ("--- a/x\n+++ b/x\n@@ bad @@\n+new\n", [("malformed_hunk_header", 3, "x", 1)]),
    ("--- a/x\n+++ b/x\n@@ -1 +1 @@f\n same\n", [("malformed_hunk_header", 3, "x", 1)]),
    ("--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@ f\n same\n", [("incomplete_hunk", 3, "x", 1)]),
    ("--- a/x\n+++ b/x\n@@ -0,0 +1 @@\n+one\n+two\n+three\n", [("overflowing_hunk", 5, "x", 1)]),
    ("--- a/x\n+++ b/x\n@@ -1 +1 @@\n same\nwords\n\\ No newline at end of file\n\n", [("invalid_hunk_body_line", 5, "x", 1), ("invalid_hunk_body_line", 7, "x", 1)]),
    ("--- a/x\n+++ b/x\n@@ -9,99999999999999999999 +1 @@\n same\n", [("incomplete_hunk", 3, "x", 1)]),
]


def told(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, diff string")
    got = {}
    for r in sorted(assess.diagnostics(df, ["id"], **how).collect(), key=lambda r: (r.id, r.nth)):
        assert r.message == assess.MESSAGES[r.code]
        got.setdefault(r.id, []).append((r.code, r.line_number, r.file_path, r.hunk_index))
    return [got.get(i, []) for i in range(len(texts))]


def test_each_fault_is_told_where_it_is(spark):
    texts, want = [t for t, _ in CASES], [w for _, w in CASES]
    for t, a, b, w in zip(texts, told(spark, texts), told(spark, texts, fragment=True), want, strict=True):
        assert a == w, (t, a)
        assert b == w, (t, b)


def test_a_marker_within_open_counts_is_a_line_of_the_hunk(spark):
    # the old marker takes the second old line, the new marker the first new one, and the header ends the hunk short of a new line
    text = "--- a/x\n+++ b/x\n@@ -1,2 +1,3 @@\n same\n--- a/y\n+++ b/y\n@@ -1 +1 @@\n same\n"
    assert told(spark, [text]) == [[("incomplete_hunk", 3, "x", 1)]]


def test_bare_hunks_are_for_fragments_alone(spark):
    text = "--- a/x\n+++ b/x\n@@\n+new\n"
    assert told(spark, [text]) == [[("malformed_hunk_header", 3, "x", 1)]]
    assert told(spark, [text], fragment=True) == [[]]


def test_states(spark):
    cases = [
        (GOOD, "valid", []),
        (None, "invalid", ["suggested_diff is invalid [empty_input]: Diff input is empty.", assess.EMPTY, assess.NOTHING_ADDED]),
        (GOOD.replace("+1,2", "+1,1").replace("+new", "-old").replace("-1,1", "-1,2"), "valid_but_unsupported", [assess.NOTHING_ADDED, assess.REMOVES]),
        (GOOD + GOOD.replace("x.py", "y.py"), "valid_but_unsupported", [assess.MANY_FILES, assess.MANY_HUNKS]),
        ("diff --git a/x.py b/y.py\nrename from x.py\nrename to y.py\n" + GOOD.replace("b/x", "b/y"), "valid_but_unsupported", [assess.RENAMES]),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id long, diff string")
    got = {r.id: (r.status, r.reasons) for r in assess.support_state(df, ["id"]).collect()}
    assert [got[i] for i in range(len(cases))] == [c[1:] for c in cases]
    landed = {r.id: r.status for r in assess.support_state(df, ["id"], source="merged_pr_diff").collect()}
    assert landed == {0: "valid", 1: "invalid", 2: "valid", 3: "valid", 4: "valid"}


def test_where_files_went(spark):
    text = "diff --git a/o b/n\nrename from o\nrename to n\ndiff --git a/gone b/gone\n--- a/gone\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n"
    files = diff.diff_files(diff.read_rows(spark.createDataFrame([(1, text)], "id long, diff string"), ["id"]), ["id"])
    paths = spark.createDataFrame([(1, p) for p in ("o", "n", "gone", "else")] + [(2, "o")], "id long, path string")
    got = {(r.id, r.path): (r.landed_path, r.change) for r in assess.landing_paths(paths, files, ["id"]).collect()}
    assert got == {(1, "o"): ("n", "renamed"), (1, "n"): ("n", "renamed"), (1, "gone"): (None, "deleted"), (1, "else"): ("else", "same"), (2, "o"): ("o", "same")}
