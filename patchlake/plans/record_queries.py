"""Registered queries of checks, rankings, summaries, readers and writers of rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as R
from ..sources import files
from .derived import SCORED, diff_pairs, scored_rows, table
from .queries import KEY, WORLD, query, rounded

_VALUES = ("0", "100", "55.5", " 7 ", "abc", "-1", "101", "NaN", "1e2", "", "99.5", "true", "False", "1")


def _listed(values) -> str:
    return "[" + ", ".join(f"'{x}'" for x in values) + "]"


def _picked(values):
    return F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))


@query(f"""WITH v AS (SELECT doc_id, list_extract({_listed(_VALUES)}, CAST(doc_id % {len(_VALUES)} + 1 AS INT)) AS value FROM documents), n AS (SELECT *, TRY_CAST(CASE WHEN regexp_matches(trim(value), '^[-0-9]') THEN trim(value) END AS DOUBLE) AS x FROM v)
SELECT doc_id, value, CASE WHEN x BETWEEN 0 AND 100 THEN x END AS percentage, CASE WHEN x BETWEEN 0 AND 100 AND x = floor(x) THEN CAST(x AS INT) END AS whole,
  CASE WHEN lower(trim(value)) IN ('true', '1') THEN true WHEN lower(trim(value)) IN ('false', '0') THEN false END AS truth FROM n""")
def parsed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").select("doc_id", _picked(_VALUES).alias("value"))
    return v.select("doc_id", "value", R.continuous_percentage(F.col("value")).alias("percentage"), R.integer_percentage(F.col("value")).alias("whole"), R.truth(F.col("value")).alias("truth"))


@query("SELECT doc_id, CAST(round_even(greatest(0.0, least(100.0, (doc_id % 300 - 50) * 0.5::DOUBLE)), 0) AS INT) AS percentage, (doc_id % 7 - 1) / 4.0::DOUBLE BETWEEN 0 AND 1 AS ratio_ok, doc_id % 7 - 1 >= 0 AS count_ok FROM documents")
def checked_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.col("doc_id") % 7 - 1).cast("double")
    return table(spark, sf_dir, "documents").select("doc_id", R.clipped_percentage((F.col("doc_id") % 300 - 50) * 0.5).alias("percentage"), R.in_domain("x_ratio", v / 4).alias("ratio_ok"), R.in_domain("x_count", v).alias("count_ok"))


@query(WORLD + """SELECT doc_id, string_agg(DISTINCT op, '+' ORDER BY op) AS edit_type, CASE WHEN count(*) <= 3 THEN 'small' WHEN count(*) <= 10 THEN 'medium' ELSE 'large' END AS size FROM sug GROUP BY doc_id""")
def edit_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import diff

    rows = diff.read_rows(diff_pairs(spark, sf_dir), KEY, "suggested")
    return R.edit_types(diff.diff_lines(rows, KEY), diff.diff_files(rows, KEY), KEY)


@query("""SELECT doc_id, 'git.example.org/org' || (doc_id % 7) || '/' || lower(source) || '#' || doc_id AS identity FROM documents""")
def pull_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scheme = F.when(F.col("doc_id") % 2 == 0, "https://").otherwise("HTTP://")
    url = F.concat(scheme, F.lit("Git.Example.org/Org"), (F.col("doc_id") % 7).cast("string"), F.lit("/"), F.upper("source"), F.when(F.col("doc_id") % 3 == 0, ".git").otherwise(""), F.lit("/pull/"), F.col("doc_id").cast("string"), F.lit("?x=1#y"))
    return table(spark, sf_dir, "documents").select("doc_id", R.identity(url).alias("identity"))


@query("""SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 97) || chr(10) || '...' || chr(10) || right(text, 98) ELSE text END AS text, CAST(round_even((doc_id % 1000) / 1000.0::DOUBLE * 100, 0) AS INT) || '%' AS share FROM documents""")
def shortened_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.middle_truncated(F.col("text"), 200).alias("text"), R.percent_text((F.col("doc_id") % 1000) / 1000.0).alias("share"))


@query("""WITH t AS (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents) SELECT doc_id, CAST(greatest(n - 9, 0) // 40 + 1 AS BIGINT) AS n_chunks, CAST(least(n - 40 * (greatest(n - 9, 0) // 40), 48) AS BIGINT) AS last_size FROM t""")
def token_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select("doc_id", R.chunks(F.split("text", " ", -1), 48, 8).alias("c"))
    return c.select("doc_id", F.size("c").cast("long").alias("n_chunks"), F.size(F.element_at("c", -1)).cast("long").alias("last_size"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 - 2 > 0 WHEN o_orderkey % 3 = 1 THEN o_orderkey % 5 > 0 ELSE false END AS in_order FROM orders""")
def chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instants with Z, with an offset, and without one, which are refused."""
    k, text = F.col("o_orderkey"), lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    created = F.concat(text(F.col("o_orderdate")), F.when(k % 3 == 0, "Z").when(k % 3 == 1, "+02:00").otherwise(""))
    merged = F.concat(text(F.col("o_orderdate") + F.make_dt_interval(hours=(k % 5 - 2).cast("int"))), F.lit("Z"))
    return table(spark, sf_dir, "orders").select("o_orderkey", R.truly_before(created, merged).alias("in_order"))


@query("""SELECT doc_id, source, highest_before, rank FROM (SELECT doc_id, source, doc_id % 3 AS rank, max(doc_id % 3) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest_before FROM documents) WHERE highest_before > rank""")
def splits_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", (F.col("doc_id") % 3).alias("rank"))
    return R.out_of_order(d, "source", ["n_chars", "doc_id"], "rank").select("doc_id", "source", "highest_before", "rank")


@query("""SELECT doc_id, unnest([n % 3, (n + 1) % 3]) AS reader FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS n FROM documents)""")
def two_readers_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dealt(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), ["n_chars", "doc_id"], 3).select("doc_id", "reader")


@query("""SELECT source, doc_id, n_chars, place FROM (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 8""")
def longest_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_of(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), "doc_id"], 8)


@query("SELECT doc_id, abs(predicted - actual) AS error FROM (" + SCORED.strip().removeprefix("WITH scored AS (").rstrip().removesuffix(")") + ") ORDER BY error DESC, doc_id LIMIT 25")
def worst_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_rows(spark, sf_dir).select("doc_id", F.abs(F.col("predicted") - F.col("actual")).alias("error")).orderBy(F.desc("error"), "doc_id").limit(25)


_BASE = SCORED + """, l AS (SELECT avg(actual) AS mean, median(actual) AS median FROM scored WHERE doc_id % 3 = 0),
b AS (SELECT 'mean' AS name, count(*) AS n, avg(abs(mean - actual)) AS mae FROM scored, l WHERE doc_id % 3 <> 0 UNION ALL SELECT 'median', count(*), avg(abs(median - actual)) FROM scored, l WHERE doc_id % 3 <> 0
  UNION ALL SELECT 'predicted', count(*), avg(abs(predicted - actual)) FROM scored WHERE doc_id % 3 <> 0)"""


def _baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.baselines(scored_rows(spark, sf_dir), "actual", F.col("doc_id") % 3 == 0, ["predicted"])


@query(_BASE + " SELECT name, n, round(mae, 6) AS mae FROM b")
def constant_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _baselines(spark, sf_dir).select("name", "n", rounded("mae").alias("mae"))


@query(_BASE + " SELECT name, n, round(mae, 6) AS mae FROM b ORDER BY b.mae, name LIMIT 1")
def best_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_by(_baselines(spark, sf_dir), "mae", "name").select("name", "n", rounded("mae").alias("mae"))


@query(SCORED + "SELECT count(*) AS n_groups, round(avg(m), 6) AS macro, round(sum(s) / sum(n), 6) AS micro FROM (SELECT source, count(*) AS n, avg(abs(predicted - actual)) AS m, sum(abs(predicted - actual)) AS s FROM scored GROUP BY source HAVING count(*) >= 10)")
def macro_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = R.macro_means(scored_rows(spark, sf_dir), "source", F.abs(F.col("predicted") - F.col("actual")), 10)
    return m.select("n_groups", rounded("macro").alias("macro"), rounded("micro").alias("micro"))


@query(SCORED + "SELECT lang, size, count(*) AS n, round(avg(abs(predicted - actual)), 6) AS mae FROM scored GROUP BY lang, size HAVING count(*) >= 5")
def regime_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = scored_rows(spark, sf_dir).groupBy("lang", "size").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("predicted") - F.col("actual"))).alias("mae"))
    return g.filter("n >= 5").select("lang", "size", "n", rounded("mae").alias("mae"))


@query(SCORED + "SELECT count(*) AS n, round(avg(actual), 6) AS mean, median(actual) AS median, count(*) FILTER (actual = 0) AS n_zero, count(*) FILTER (actual > 0 AND actual < 100) AS n_between, count(*) FILTER (actual = 100) AS n_hundred, count(DISTINCT source) AS n_sources, count(DISTINCT (source, lang)) AS n_pairs FROM scored")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("actual")
    return scored_rows(spark, sf_dir).agg(F.count("*").alias("n"), rounded(F.avg(a)).alias("mean"), F.median(a).alias("median"), F.count_if(a == 0).alias("n_zero"), F.count_if((a > 0) & (a < 100)).alias("n_between"), F.count_if(a == 100).alias("n_hundred"), F.count_distinct("source").alias("n_sources"), F.count_distinct("source", "lang").alias("n_pairs"))


@query("SELECT role, count(*) AS n FROM conversations GROUP BY role")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source, CAST('0x' || substr(sha256('7:' || source), 1, 8) AS BIGINT) % 5 AS fold FROM documents")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.folds(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5, seed=7)


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing_right' WHEN d.doc_id IS NULL THEN 'missing_left' WHEN d.quality IS DISTINCT FROM l.quality THEN 'other_quality' END AS issue
FROM (SELECT doc_id, doc_id % 2 AS quality FROM documents WHERE doc_id % 11 <> 0) d FULL JOIN labels l USING (doc_id)""")
def joined_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two tables by id; those that one lacks, or where they differ, carry what is wrong."""
    d = table(spark, sf_dir, "documents").filter("doc_id % 11 <> 0").select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    return R.joined_checked(d, table(spark, sf_dir, "labels"), "doc_id", ["quality"])


@query(SCORED + """SELECT doc_id, CASE WHEN lang = 'en' THEN 1 ELSE 0.5 END * greatest((doc_id % 10) / 10.0::DOUBLE, 0.25) AS weight,
  round(greatest(0, least(100, CASE WHEN abs(actual - predicted) > 20 THEN actual ELSE 0.7 * actual + 0.3 * predicted END)), 6) AS blended,
  CAST(round_even((0.35::DOUBLE * round_even(actual / 101.0::DOUBLE, 4) + 0.65::DOUBLE * round_even(predicted / 101.0::DOUBLE, 4)) * 100, 0) AS INT) AS estimate FROM scored""")
def weights_and_blends(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, p = F.col("actual").cast("double"), F.col("predicted").cast("double")
    own = F.when(F.col("lang") == "en", "internal").otherwise("external")
    return scored_rows(spark, sf_dir).select("doc_id", R.sample_weight(own, (F.col("doc_id") % 10) / 10.0).alias("weight"), rounded(R.blended(a, p, 0.7, 20)).alias("blended"), R.overlap_estimate(a / 101, p / 101).alias("estimate"))


@query("SELECT conv_id, turn, contains(lower(text), 'license') OR contains(lower(text), 'the ') AS kept FROM conversations")
def comment_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", R.holds_any(F.col("text"), ["LICENSE", "The "]).alias("kept"))


@query("""SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM (SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents) GROUP BY doc_id, w) GROUP BY doc_id""")
def ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.array_join(F.array_distinct(F.split("text", " ", -1)), " ").alias("words"))


@query("SELECT doc_id AS id, 'documents' AS kind FROM documents UNION ALL SELECT page_id, 'pages' FROM pages UNION ALL SELECT item_id, 'benchmark' FROM benchmark")
def all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, n).select(F.col(k).alias("id"), F.lit(n).alias("kind")) for n, k in (("documents", "doc_id"), ("pages", "page_id"), ("benchmark", "item_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines and read again, each line an object."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    at = f"{files.shared_dir(spark)}/jsonl-{uuid.uuid4().hex}"
    files.write_jsonl(d, at)
    return files.refuse_issues(files.read_jsonl(spark, at, d.schema, numbered=False)).select("row.*")


@query("SELECT doc_id, lang, source, n_chars, text FROM documents")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source", "text")
    at = f"{files.shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    files.write_csv(d, at)
    return files.read_csv(spark, at, d.schema)


@query("""WITH s AS (SELECT CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE CAST(doc_id // 1 - CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS VARCHAR) END AS example_id, CASE WHEN doc_id % 7 = 0 THEN 'other' ELSE 'train' END AS split FROM documents)
SELECT example_id, CASE WHEN trim(example_id) = '' THEN 'missing_id' ELSE 'unknown_split' END AS issue FROM s WHERE trim(example_id) = '' OR split = 'other' UNION ALL SELECT example_id, 'repeated_id' FROM s WHERE trim(example_id) <> '' GROUP BY example_id HAVING count(*) > 1""")
def split_assignment_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    s = table(spark, sf_dir, "documents").select(F.when(k % 17 == 0, " ").otherwise((k - F.when(k % 13 == 0, 1).otherwise(0)).cast("string")).alias("example_id"), F.when(k % 7 == 0, "other").otherwise("train").alias("split"))
    return files.split_issues(s, "example_id", "split", ["train", "development", "calibration", "test"])
