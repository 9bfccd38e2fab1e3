"""Readers and writers: places of lines, refused rows, staged output, hashes."""

import hashlib
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from patchlake.operators import records
from patchlake.sources import files


def test_json_lines_keep_their_places(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "t": "é\\u2028x"}\n\n  \n{"id": 2}\r\n[1]\nnot json\n{"id": "x"}\n', encoding="utf-8")
    got = {r.line_number: (r.row.id if r.row else None, r.issue) for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int, t string").collect()}
    assert got == {1: (1, None), 4: (2, None), 5: (None, "invalid_json"), 6: (None, "invalid_json"), 7: (None, None)}
    with pytest.raises(PySparkException, match=r"Invalid JSON at .*a\.jsonl:5"):
        files.refuse_issues(files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int, t string").filter("line_number < 6")).collect()
    assert sorted(r.issue or "" for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int", numbered=False).collect()) == ["", "", "", "invalid_json", "invalid_json"]


def test_staged_output(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 'a "b", c\nd'), (2, "", "\\N x"), (3, "é", None)], "n int, b string, a string")
    for write, read in ((files.write_csv, lambda p: files.read_csv(spark, p, "a string, b string, n int")), (files.write_jsonl, lambda p: files.refuse_issues(files.read_jsonl(spark, p, df.schema)).select("row.*"))):
        at = str(tmp_path / write.__name__)
        write(df, at)
        assert sorted((r.n, r.b, r.a) for r in read(at).collect()) == sorted((r.n, r.b, r.a) for r in df.collect())
        with pytest.raises(FileExistsError):
            write(df, at)
    bad = df.select(F.raise_error(F.lit("no")).alias("x"))
    with pytest.raises(PySparkException):
        files.write_jsonl(bad, str(tmp_path / "bad"))
    assert sorted(os.listdir(tmp_path)) == ["write_csv", "write_jsonl"]
    assert files.jsonl_lines(df).first().value == '{"a":"a \\"b\\", c\\nd","b":null,"n":1}'


def test_csv_keeps_texts_as_they_are(spark, tmp_path):
    odd = [" lead", "trail ", "\ttab\t", " ", "\r\n", "a\n", "\na", "a\rb", "\\N", "\\\\N", "\\", "\x00", "\\\n", '"', "", None, "#x"]
    df = spark.createDataFrame(list(enumerate(odd)), "n int, t string")
    files.write_csv(df, str(tmp_path / "odd"))
    assert {r.n: r.t for r in files.read_csv(spark, str(tmp_path / "odd"), df.schema).collect()} == dict(enumerate(odd))


def test_hashes_against_a_manifest(spark, tmp_path):
    for name, text in (("a", "one"), ("b", "two"), ("c", "x")):
        (tmp_path / name).write_text(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    manifest = spark.createDataFrame([("a", sha("one")), ("b", sha("other")), ("d", sha(""))], "file string, sha256 string")
    found = files.file_hashes(spark, str(tmp_path))
    assert {r.file: r.n_bytes for r in found.collect()} == {"a": 3, "b": 3, "c": 1}
    assert {(r.file, r.issue) for r in files.hash_issues(found, manifest).collect()} == {("b", "changed"), ("c", "not_listed"), ("d", "missing")}


def test_diff_flags_and_plain_lines(spark):
    texts = ["rename from a\nrename to b\n", "--- a/x.yml\n+++ b/x.yml\n@@ -1 +1 @@\n a\n+b", "hello\n  there \n+ no\n\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: (r.has_renames, r.touches_config, r.has_context, r.plain) for r in df.select("i", *[c.alias(k) for k, c in records.diff_flags(F.col("t")).items()], records.plain_lines(F.col("t")).alias("plain")).collect()}
    assert got[0] == (True, False, False, []) and got[1] == (False, True, True, ["a"]) and got[2][3] == ["hello", "there"] and got[3][3] == []
