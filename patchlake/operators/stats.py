"""Error metrics, intervals, agreement and review scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rounded_prediction(p: Column) -> Column:
    """Clipped to 0..100 and rounded, halves to even."""
    return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(100.0), p.cast("double"))))


def error_aggs(actual: str, predicted: str) -> list[Column]:
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    e = F.abs(a - p)
    dangerous = ((p >= 80) & (a <= 20)) | ((p <= 20) & (a >= 80))
    sst = F.var_pop(a) * F.count(a)
    return [
        F.count("*").alias("n"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when((F.count("*") > 1) & (F.var_pop(a) > 0), 1 - F.sum(e * e) / F.nullif(sst, F.lit(0.0))).alias("r2"),
        F.avg((e <= 5).cast("double")).alias("within_5"), F.avg((e <= 10).cast("double")).alias("within_10"), F.avg(dangerous.cast("double")).alias("dangerous_rate"),
    ]


def error_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*error_aggs(actual, predicted))


def subgroup_metrics(df: DataFrame, actual: str, predicted: str, dimensions: Sequence[str]) -> DataFrame:
    """(dimension, value, metrics) of each dimension's groups, by grouping sets in one shuffle."""
    grouped = df.groupingSets([[F.col(d)] for d in dimensions], *[F.col(d) for d in dimensions]).agg(F.grouping_id().alias("_g"), *error_aggs(actual, predicted))
    bit = {d: 2**i for i, d in enumerate(reversed(dimensions))}
    of = lambda d: F.col("_g").bitwiseAND(F.lit(bit[d])) == 0
    name = F.coalesce(*[F.when(of(d), F.lit(d)) for d in dimensions])
    value = F.coalesce(*[F.when(of(d), F.col(d).cast("string")) for d in dimensions])
    return grouped.select(name.alias("dimension"), value.alias("value"), "n", "mae", "rmse", "r2", "within_5", "within_10", "dangerous_rate")


def seeded_draws(names: DataFrame, group: str, iterations: int, seed: int) -> DataFrame:
    """(iteration, group, times): as many draws with replacement as there are groups, in each iteration.

    Draw j of iteration i takes the group at the place that a hash of seed, i and j names among the
    sorted groups, so draws are made and counted in parallel and are the same however rows are dealt.
    """
    placed = names.select(group, (F.row_number().over(Window.orderBy(group)) - 1).alias("_at"))  # one row for each group
    n = names.count()
    number = names.sparkSession.range(iterations * n)
    i, j = F.expr(f"id div {max(n, 1)}"), F.col("id") % max(n, 1)
    at = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), i, j), 256), 1, 15), 16, 10).cast("long") % max(n, 1)
    times = number.select(i.cast("int").alias("iteration"), at.alias("_at")).groupBy("iteration", "_at").agg(F.count("*").cast("int").alias("times"))
    return times.join(placed, "_at").select("iteration", group, "times")


def bootstrap_intervals(df: DataFrame, actual: str, predicted: str, group: str, iterations: int = 2000, seed: int = 42, draws: DataFrame | None = None) -> DataFrame:
    """(metric, low, high): 2.5 % and 97.5 % points over resamples of whole groups.

    Rows are summed by group once; a resample then weighs groups' sums by how often each is
    drawn. ``draws`` (iteration, group, times) replaces the seeded draws where given.
    """
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    e = F.abs(a - p)
    sums = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(e).alias("ae"), F.sum(e * e).alias("se"), F.sum((e <= 5).cast("double")).alias("w5"), F.sum((e <= 10).cast("double")).alias("w10"))
    if draws is None:
        draws = seeded_draws(sums.select(group), group, iterations, seed)
    t = F.col("times")
    each = draws.join(sums, group).groupBy("iteration").agg(F.sum(t * F.col("n")).alias("n"), *[F.sum(t * F.col(c)).alias(c) for c in ("ae", "se", "w5", "w10")])
    made = each.select(F.explode(F.create_map(F.lit("mae"), F.col("ae") / F.col("n"), F.lit("rmse"), F.sqrt(F.col("se") / F.col("n")), F.lit("within_5"), F.col("w5") / F.col("n"), F.lit("within_10"), F.col("w10") / F.col("n"))).alias("metric", "value"))
    return made.groupBy("metric").agg(F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"))


def conformal_quantile(residuals: DataFrame, residual: str, alpha: float, by: Sequence[str] = ()) -> DataFrame:
    """The residual of rank min(n, ceil((n + 1)(1 - alpha))), an order statistic.

    Residuals are counted by value first, so the ranked rows are distinct values.
    """
    counted = residuals.groupBy(*by, F.col(residual).alias("_r")).agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*by)
    upto = whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("n", F.sum("_n").over(whole)).withColumn("_c", F.sum("_n").over(upto))
    rank = F.least(F.col("n"), F.ceil((F.col("n") + 1).cast("double") * F.lit(1.0 - alpha)))
    return ranked.filter(F.col("_c") >= rank).groupBy(*by, "n").agg(F.min("_r").alias("quantile"))


def clustered_conformal_quantile(residuals: DataFrame, residual: str, group: str, alpha: float) -> DataFrame:
    return conformal_quantile(residuals.groupBy(group).agg(F.max(residual).alias("_w")), "_w", alpha)


def interval(p: Column, quantile: Column) -> tuple[Column, Column]:
    """Whole lower and upper ends within 0..100."""
    inside = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    return F.floor(inside(p - quantile)).cast("int"), F.ceil(inside(p + quantile)).cast("int")


def icc(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """One-way intraclass correlation of two scores a row, from sums alone; 1 where nothing varies."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    s = pairs.agg(F.count("*").alias("n"), F.avg((a + b) / 2).alias("mean"), F.sum(F.pow((a + b) / 2, 2)).alias("ss"), F.sum(F.pow(a - b, 2) / 2).alias("within"))
    between = 2 * (F.col("ss") - F.col("n") * F.col("mean") * F.col("mean")) / F.nullif(F.col("n") - 1, F.lit(0))
    within = F.col("within") / F.nullif(F.col("n"), F.lit(0))
    return s.select("n", F.when(between + within == 0, 1.0).otherwise((between - within) / F.nullif(between + within, F.lit(0.0))).alias("icc"))


def weighted_kappa(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Quadratically weighted kappa; weights go by the labels' places in their sorted union."""
    labels = pairs.select(F.col(x).alias("label")).union(pairs.select(F.col(y).alias("label"))).distinct()
    place = labels.withColumn("at", F.row_number().over(Window.orderBy("label")))
    cells = pairs.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))
    placed = cells.join(place.toDF("x", "i"), "x").join(place.toDF("y", "j"), "y")
    rows, cols = placed.groupBy("i").agg(F.sum("n").alias("r")), placed.groupBy("j").agg(F.sum("n").alias("c"))
    d = lambda: F.pow(F.col("i") - F.col("j"), 2)
    seen = placed.agg(F.sum(d() * F.col("n")).alias("seen"), F.sum("n").alias("n"))
    # the sum over all pairs of places of (i - j)^2 r_i c_j, from moments: no pairs are made
    m_r = rows.agg(F.sum("r").alias("r0"), F.sum(F.col("r") * F.col("i")).alias("r1"), F.sum(F.col("r") * F.col("i") * F.col("i")).alias("r2"))
    m_c = cols.agg(F.sum("c").alias("c0"), F.sum(F.col("c") * F.col("j")).alias("c1"), F.sum(F.col("c") * F.col("j") * F.col("j")).alias("c2"))
    every = seen.crossJoin(m_r).crossJoin(m_c)  # one row each
    expected = (F.col("r2") * F.col("c0") - 2 * F.col("r1") * F.col("c1") + F.col("r0") * F.col("c2")) / F.col("n")
    return every.select("n", (1 - F.col("seen") / F.nullif(expected, F.lit(0.0))).alias("kappa"))


def review_scores(units: DataFrame, review: str) -> DataFrame:
    """Score, deductions and verdict counts of each review; credit is 1, one half or 0."""
    credit = F.when(F.col("verdict") == "correct", 1.0).when(F.col("verdict") == "partially_correct", 0.5).otherwise(0.0)
    w = F.col("weight")
    return units.groupBy(review).agg(
        (100 * F.sum(w * credit) / F.sum(w)).alias("score"), (100 * F.sum(w * (1 - credit)) / F.sum(w)).alias("deducted"), F.count("*").alias("n_units"),
        *[F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("correct", "partially_correct", "incorrect", "missed")],
    )


def review_summary(scores: DataFrame) -> DataFrame:
    n = F.sum("n_units")
    return scores.agg(F.count("*").alias("n_reviews"), F.avg("score").alias("mean_score"), F.avg((F.col("n_correct") == F.col("n_units")).cast("double")).alias("perfect_rate"), (F.sum("n_incorrect") / n).alias("incorrect_rate"), (F.sum("n_missed") / n).alias("missed_rate"))


def weighted_percentage(units: DataFrame, by: Sequence[str], weight: str, credit: str) -> DataFrame:
    return units.groupBy(*by).agg((100 * F.sum(F.col(weight) * F.col(credit)) / F.sum(weight)).alias("percentage"))


def agreement(pairs: DataFrame, x: str, y: str) -> DataFrame:
    e = F.abs(F.col(x) - F.col(y)).cast("double")
    return pairs.agg(F.count("*").alias("n"), F.avg(e).alias("mean_absolute_difference"), F.avg((e <= 5).cast("double")).alias("within_5"), F.avg((e <= 10).cast("double")).alias("within_10"))


def jaccard(a: Column, b: Column) -> Column:
    return F.when(F.size(F.array_union(a, b)) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def cosine(a: Column, b: Column) -> Column:
    """Of two float arrays, within -1..1."""
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))))


def embedding_features(candidates: DataFrame, by: Sequence[str], suggestion: str, vector: str, same_file: str, n_dims: int, thresholds: Sequence[float] = (0.6, 0.7, 0.8)) -> DataFrame:
    """A row of cosine features for each example, of a row for each of its candidates.

    All are aggregates: the three best are ranked with a limit on each group, and the centroid is
    averaged by dimension, so an example's candidates are never gathered. Features of what is not there are 0.
    """
    scored = candidates.withColumn("_s", cosine(F.col(suggestion), F.col(vector)))
    mean = F.array(*[F.avg(F.get(vector, F.lit(i))) for i in range(n_dims)])
    or_zero = lambda c: F.coalesce(c, F.lit(0.0))
    whole = scored.groupBy(*by).agg(
        F.avg("_s").alias("candidate_mean"), cosine(F.first(suggestion), mean).alias("centroid"),
        or_zero(F.max(F.when(F.col(same_file), F.col("_s")))).alias("same_file_best"), or_zero(F.max(F.when(~F.col(same_file), F.col("_s")))).alias("cross_file_best"),
        F.count("*").alias("n_candidates"), *[F.avg((F.col("_s") >= t).cast("double")).alias(f"above_{round(100 * t)}") for t in thresholds],
    )
    ranked = scored.select(*by, "_s").withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_s")))).filter("_r <= 3")
    best = ranked.groupBy(*by).agg(F.max("_s").alias("best"), F.avg("_s").alias("mean_top3"), (F.max("_s") - or_zero(F.max(F.when(F.col("_r") == 2, F.col("_s"))))).alias("margin"))
    return best.join(whole, list(by))
