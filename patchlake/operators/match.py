"""One-to-one matching of change units and coverage evidence.

Occurrences are numbered within their key on both sides, so the k-th suggested occurrence
meets the k-th landed one by an equi-join: no loops, no many-to-many blow-up.
"""

from __future__ import annotations

from collections import Counter, defaultdict, deque
from collections.abc import Iterator, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse
from .pairs import over_texts


def _numbered(units: DataFrame, on: list[str], side: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*on).orderBy("unit"))
    return units.select(*on, n.alias("_n"), F.col("unit").alias(f"{side}_unit"), F.col("path").alias(f"{side}_path") if "path" not in on else F.lit(None).alias("_none")).drop("_none")


def match_units(suggested: DataFrame, landed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, kind, text, suggested_unit, landed_unit, suggested_path, landed_path, scope).

    Strict matches agree in kind, text and path; relaxed ones, of what strict matches leave
    over, in kind and text.
    """
    keys = list(keys)
    strict_on, relaxed_on = [*keys, "kind", "text", "path"], [*keys, "kind", "text"]
    strict = _numbered(suggested, strict_on, "suggested").join(_numbered(landed, strict_on, "landed"), [*strict_on, "_n"])
    strict = strict.select(*relaxed_on, "suggested_unit", "landed_unit", F.col("path").alias("suggested_path"), F.col("path").alias("landed_path"), F.lit("strict_same_file").alias("scope"))
    left = suggested.join(strict.select(*keys, F.col("suggested_unit").alias("unit")), [*keys, "unit"], "left_anti")
    right = landed.join(strict.select(*keys, F.col("landed_unit").alias("unit")), [*keys, "unit"], "left_anti")
    relaxed = _numbered(left, relaxed_on, "suggested").join(_numbered(right, relaxed_on, "landed"), [*relaxed_on, "_n"])
    return strict.unionByName(relaxed.select(*relaxed_on, "suggested_unit", "landed_unit", "suggested_path", "landed_path", F.lit("relaxed_cross_file").alias("scope")))


def unmatched_units(suggested: DataFrame, matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    return suggested.join(matches.select(*keys, F.col("suggested_unit").alias("unit")), [*keys, "unit"], "left_anti")


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole to the nearest whole number, halves to even; null where there is nothing."""
    return F.when(whole > 0, F.rint(100.0 * part / whole)).cast("int")


class Unit(NamedTuple):
    unit: int
    kind: str
    path: str
    text: str


def units_of(text: str | None) -> list[Unit]:
    """The change units of a diff's text, as ``diff.change_units`` makes them: of each file its rename, then its lines."""
    files: dict[int, list[tuple[str, str, str]]] = {}
    moved: dict[int, tuple[str | None, str | None]] = {}
    for r in parse.rows(text):
        if r.file:
            moved[r.file] = r.rename_from, r.rename_to
            some = files.setdefault(r.file, [])
            if r.kind in ("addition", "deletion") and (said := parse.collapsed(r.line[1:])):
                some.append((r.kind, r.path or "unknown", said))
    out: list[Unit] = []
    for file, some in files.items():
        old, new = moved[file]
        if old is not None and new is not None:
            some = [("rename", new, parse.collapsed(f"{old} -> {new}")), *some]
        out += [Unit(len(out) + n, *x) for n, x in enumerate(some, 1)]
    return out


def matched(suggested: Sequence[Unit], landed: Sequence[Unit]) -> dict[int, tuple[Unit, str]]:
    """Landed unit and scope by suggested unit; k-th occurrences meet, first within kind, text and path, then within kind and text."""
    out: dict[int, tuple[Unit, str]] = {}
    free = list(landed)
    for scope, key in (("strict_same_file", lambda u: u[1:]), ("relaxed_cross_file", lambda u: (u.kind, u.text))):
        waiting: dict[object, deque[Unit]] = defaultdict(deque)
        for u in free:
            waiting[key(u)].append(u)
        for u in suggested:
            if u.unit not in out and (some := waiting.get(key(u))):
                out[u.unit] = some.popleft(), scope
        taken = {u.unit for u, _ in out.values()}
        free = [u for u in free if u.unit not in taken]
    return out


_UNIT = [("unit", "long"), ("kind", "string"), ("path", "string"), ("text", "string"), ("landed_unit", "long"), ("landed_path", "string"), ("scope", "string")]


def units_of_texts(pairs: DataFrame, keys: Sequence[str], suggested: str = "suggested", landed: str = "landed") -> DataFrame:
    """(keys, unit, kind, path, text, landed_unit, landed_path, scope): each suggested unit with the landed one it meets, or nulls.

    From the diffs' texts in one row, so each is parsed once and nothing is shuffled.
    """

    def make(s: str | None, l: str | None) -> Iterator[tuple[object, ...]]:
        own = units_of(s)
        found = matched(own, units_of(l))
        for u in own:
            met, scope = found.get(u.unit, (None, None))
            yield (*u, met and met.unit, met and met.path, scope)

    return over_texts(pairs, keys, [suggested, landed], _UNIT, make)


def matches_of_texts(pairs: DataFrame, keys: Sequence[str], suggested: str = "suggested", landed: str = "landed") -> DataFrame:
    """``match_units`` from the texts of both diffs of a row."""
    some = units_of_texts(pairs, keys, suggested, landed).filter("scope IS NOT NULL")
    return some.select(*keys, "kind", "text", F.col("unit").cast("int").alias("suggested_unit"), F.col("landed_unit").cast("int").alias("landed_unit"), F.col("path").alias("suggested_path"), "landed_path", "scope")


_COUNTS = ("total_units", "suggested_additions", "suggested_deletions", "suggested_renames", "strict_units", "relaxed_units", "moved_units")


def coverage_of_texts(pairs: DataFrame, keys: Sequence[str], suggested: str = "suggested", landed: str = "landed") -> DataFrame:
    """``coverage`` from the texts of both diffs of a row."""

    def make(s: str | None, l: str | None) -> Iterator[tuple[int, ...]]:
        own = units_of(s)
        found = matched(own, units_of(l))
        kinds, scopes = Counter(u.kind for u in own), Counter(scope for _, scope in found.values())
        yield len(own), kinds["addition"], kinds["deletion"], kinds["rename"], scopes["strict_same_file"], scopes["relaxed_cross_file"], sum(u.path != found[u.unit][0].path for u in own if u.unit in found)

    n = over_texts(pairs, keys, [suggested, landed], [(c, "long") for c in _COUNTS], make)
    share = lambda part: percent(part, F.col("total_units"))
    strict, relaxed = F.col("strict_units"), F.col("relaxed_units")
    return n.select(*keys, *_COUNTS, share(strict).alias("strict_percentage"), share(relaxed).alias("relaxed_percentage"), share(strict + relaxed).alias("coverage_percentage"))


def coverage(pairs: DataFrame, suggested: DataFrame, matches: DataFrame, keys: Sequence[str], valid: str | None = None) -> DataFrame:
    """Counts and percentages of matched units of each pair; none are matched where ``valid`` is false."""
    keys = list(keys)
    total = suggested.groupBy(*keys).agg(F.count("*").alias("total_units"), *[F.count_if(F.col("kind") == k).alias(f"suggested_{k}s") for k in ("addition", "deletion", "rename")])
    got = matches.groupBy(*keys).agg(F.count_if(F.col("scope") == "strict_same_file").alias("strict_units"), F.count_if(F.col("scope") == "relaxed_cross_file").alias("relaxed_units"), F.count_if(F.col("suggested_path") != F.col("landed_path")).alias("moved_units"))
    fine = F.col(valid) if valid else F.lit(True)
    both = pairs.select(*keys, *([valid] if valid else [])).join(total, keys, "left").join(got, keys, "left")
    n = lambda c: F.when(fine, F.coalesce(F.col(c), F.lit(0))).otherwise(0)
    every = F.coalesce("total_units", F.lit(0))
    share = lambda part: F.when(fine, percent(part, every))
    return both.select(
        *keys, every.alias("total_units"), *[F.coalesce(f"suggested_{k}s", F.lit(0)).alias(f"suggested_{k}s") for k in ("addition", "deletion", "rename")],
        n("strict_units").alias("strict_units"), n("relaxed_units").alias("relaxed_units"), n("moved_units").alias("moved_units"),
        share(n("strict_units")).alias("strict_percentage"), share(n("relaxed_units")).alias("relaxed_percentage"), share(n("strict_units") + n("relaxed_units")).alias("coverage_percentage"),
    )
