"""Whether a diff is well formed, and whether a suggestion has a shape that can be scored.

As in the parser, what a line means follows from windows over the numbered lines of each diff:

* a hunk's body goes from its header to the next header of a file or hunk, or to the first marker
  line at which the header's counts have been reached (any marker line where it has none);
* markers, headers of files and hunks outside of bodies are events. Old and new markers pair up in
  stretches in which they take turns; a stretch begins after a header and where a marker repeats.
  A file's section begins at its header and at the first marker of each pair, unless that pair
  belongs to the header just before it;
* what is wrong with a whole hunk or section is told at its last line.

All windows are partitioned by the diff's key and more, so one shuffle serves them all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..functions import text as T
from . import diff
from .pairs import over_texts

# The codes of diagnostics and what they say.
MESSAGES = {
    "empty_input": "Diff input is empty.",
    "non_diff_input": "Input does not contain unified-diff structure.",
    "malformed_git_header": "Git header must contain exactly one valid a/ path and one valid b/ path.",
    "invalid_file_marker": "File marker must contain the expected Git-prefixed path or /dev/null.",
    "conflicting_file_path": "File marker path conflicts with the corresponding Git header path.",
    "missing_file_marker_pair": "File section must contain paired --- and +++ markers before a hunk.",
    "missing_hunk": "A file section with --- and +++ markers must contain at least one hunk.",
    "reordered_file_markers": "The --- file marker must precede the +++ file marker.",
    "partial_rename_metadata": "Rename metadata must contain both rename from and rename to lines.",
    "malformed_hunk_header": "Hunk header is malformed for the selected diff dialect.",
    "incomplete_hunk": "Hunk body ended before its declared line counts were satisfied.",
    "overflowing_hunk": "Hunk body exceeds its declared line counts.",
    "invalid_hunk_body_line": "Hunk body line must start with a space, +, or -.",
}
# Why a well-formed suggestion can't be scored.
EMPTY = "suggestion diff is empty"
NOTHING_ADDED = "suggestion diff contains no supported added code lines"
REMOVES = "suggestion deletions and replacements are not yet supported"
MANY_FILES = "multi-file suggestions are not yet supported by raw inference"
MANY_HUNKS = "multi-hunk suggestions are not yet supported by raw inference"
RENAMES = "renamed suggestion files are not yet supported"

_COUNTED = diff.HUNK + "(?: .*)?$"
_BEGINNINGS = ("diff --git", "---", "+++", "rename from ", "rename to ", "@@")


def _whole_text(diffs: DataFrame, text: str) -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def _blank(c: Column) -> Column:
    return T.strip(c) == ""


def _either_not_both(a: str, b: str) -> Column:
    return F.col(a).isNull() != F.col(b).isNull()


def _header_paths(line: Column) -> Column:
    """(ok, old, new) of a ``diff --git`` line; sides that the line leaves open are null."""
    old, new = T.header_sides(line)
    sides = F.transform(F.array(old, new), T.clean_path)

    def judged(clean: Column) -> Column:
        both = F.forall(clean, lambda x: F.coalesce(T.is_diff_path(x), F.lit(False)))
        named = F.transform(clean, T.stripped_path)
        good = both & named[0].isNotNull() & named[1].isNotNull()
        open_ = clean[0].isNull() & line.startswith("diff --git a/") & ((F.contains(line, F.lit(" b/")) & ~line.endswith(" b/")) | line.rlike(r' "(?:\\.|[^"\\])*"$'))
        return F.struct((good | open_).alias("ok"), F.when(good, named[0]).alias("old"), F.when(good, named[1]).alias("new"))

    return T.let(sides, judged)


def _read(diffs: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Every line of the diffs that aren't blank, with its hunk's counts so far, its section and the paths as they stand."""
    l, first, last = F.col("line"), Window.unboundedPreceding, Window.unboundedFollowing
    rows = diffs.filter(~_blank(_whole_text(diffs, text))).select(*keys, F.posexplode(T.split_lines(F.col(text))).alias("at", "line")).withColumn("at", (F.col("at") + 1).cast("long"))
    all_ = Window.partitionBy(*keys).orderBy("at")
    git, header, marker = l.startswith("diff --git"), l.startswith("@@"), l.startswith("---") | l.startswith("+++")
    rows = rows.withColumns({"git": git, "header": header, "region": F.count_if(git | header).over(all_.rowsBetween(first, 0))})

    region = Window.partitionBy(*keys, "region").orderBy("at")
    upto, whole = region.rowsBetween(first, 0), region.rowsBetween(first, last)
    plain = ~F.col("git") & ~F.col("header")
    counted = F.col("header") & l.rlike(_COUNTED)
    head = F.struct(F.col("header").alias("hunk"), F.col("at"), F.when(counted, diff.hunk_number(l, 2, 1)).alias("old"), F.when(counted, diff.hunk_number(l, 4, 1)).alias("new"))
    rows = rows.withColumns({"counted": counted, "on_old": (plain & l.rlike("^[- ]")).cast("long"), "on_new": (plain & l.rlike("^[+ ]")).cast("long")})
    rows = rows.withColumns({"head": F.first(head).over(upto), "olds": F.sum("on_old").over(upto), "news": F.sum("on_new").over(upto)})
    reached = (F.col("olds") - F.col("on_old") >= F.col("head.old")) & (F.col("news") - F.col("on_new") >= F.col("head.new"))
    ends = F.col("head.hunk") & plain & marker & (F.col("head.old").isNull() | reached)
    rows = rows.withColumn("end", F.min(F.when(ends, F.col("at"))).over(whole))
    rows = rows.withColumn("body", F.col("head.hunk") & (F.col("at") > F.col("head.at")) & (F.col("end").isNull() | (F.col("at") < F.col("end"))))
    over = F.col("body") & (F.col("on_old") + F.col("on_new") > 0) & ((F.col("olds") > F.col("head.old")) | (F.col("news") > F.col("head.new")))
    rows = rows.withColumns({"over_at": F.min(F.when(over, F.col("at"))).over(whole), "goes_on": F.coalesce(F.lead("body").over(region), F.lit(False))})

    free = ~F.col("body")
    old_line, new_line = free & l.startswith("---"), free & l.startswith("+++")
    moved_from, moved_to = free & l.startswith("rename from "), free & l.startswith("rename to ")
    raw = F.when(old_line | new_line, F.substring(l, 5, 2**31 - 1)).when(moved_from, F.substring(l, 13, 2**31 - 1)).when(moved_to, F.substring(l, 11, 2**31 - 1))
    rows = rows.withColumns({"clean": F.when(old_line | new_line | moved_from | moved_to, T.clean_path(raw)), "heads": F.when(F.col("git"), _header_paths(l))})
    fits = lambda sign, prefix: F.coalesce(l.startswith(sign) & ((F.col("clean") == "/dev/null") | (F.col("clean").startswith(prefix) & (F.length("clean") > 2))), F.lit(False))
    rows = rows.withColumns({
        "named": T.stripped_path(F.col("clean")), "moved_from": moved_from, "moved_to": moved_to, "marker": old_line | new_line,
        "event": F.when(F.col("git"), "git").when(F.col("header"), "hunk").when(old_line & fits("--- ", "a/"), "old").when(new_line & fits("+++ ", "b/"), "new"),
    })

    side = F.coalesce(F.col("event").isin("old", "new"), F.lit(False))
    rows = rows.withColumn("prior", F.last("event", ignorenulls=True).over(all_.rowsBetween(first, -1)))
    breaks = side & (F.col("prior").isNull() | F.col("prior").isin("git", "hunk") | (F.col("prior") == F.col("event")))
    rows = rows.withColumn("stretch", F.count_if(breaks).over(all_.rowsBetween(first, 0)))
    nth = F.count_if(side).over(Window.partitionBy(*keys, "stretch").orderBy("at").rowsBetween(first, 0)) - 1
    rows = rows.withColumn("nth", nth)
    own_header = (F.col("nth") == 0) & (F.col("prior").isNull() | (F.col("prior") == "git"))
    rows = rows.withColumn("section", F.count_if(F.col("git") | (side & (F.col("nth") % 2 == 0) & ~own_header)).over(all_.rowsBetween(first, 0)))

    section = Window.partitionBy(*keys, "section").orderBy("at")
    so_far, before, of_all = section.rowsBetween(first, 0), section.rowsBetween(first, -1), section.rowsBetween(first, last)
    is_ = lambda name: F.coalesce(F.col("event") == name, F.lit(False))
    put = lambda c: F.struct(c.alias("path"))
    sets_old = F.when(F.col("git"), put(F.col("heads.old"))).when(is_("old") | F.col("moved_from"), put(F.col("named")))
    sets_new = F.when(F.col("git"), put(F.col("heads.new"))).when(is_("new") | F.col("moved_to"), put(F.col("named")))
    path = lambda w: F.coalesce(F.last(sets_new, ignorenulls=True).over(w)["path"], F.last(sets_old, ignorenulls=True).over(w)["path"])
    at = lambda test: F.max(F.when(test, F.col("at"))).over(of_all)
    return rows.withColumns({
        "path": path(so_far), "path_before": path(before), "own": F.first(F.struct(F.col("heads.old").alias("old"), F.col("heads.new").alias("new"))).over(so_far),
        "hunk_no": F.count_if("header").over(so_far), "n_hunks": F.count_if("header").over(of_all),
        "paired": F.bool_or(is_("old")).over(so_far) & F.bool_or(is_("new")).over(so_far), "has_old": F.bool_or(is_("old")).over(so_far),
        "old_at": at(is_("old")), "new_at": at(is_("new")), "from_at": at(F.col("moved_from")), "to_at": at(F.col("moved_to")), "is_last": F.col("at") == F.max("at").over(of_all),
    })


def diagnostics(diffs: DataFrame, keys: Sequence[str], text: str = "diff", fragment: bool = False) -> DataFrame:
    """(keys, nth, code, message, line_number, file_path, hunk_index): all that is wrong with each diff, in order of reading.

    Hunks must have counts; a ``fragment`` may have bare ``@@`` lines too. A null text is an empty one.
    """
    keys = list(keys)
    c, l = F.col, F.col("line")
    rows = _read(diffs, keys, text)
    path, number, none = c("path"), c("hunk_no"), F.lit(None)
    after, here = c("at") + 1, c("at")
    event = lambda name: F.coalesce(c("event") == name, F.lit(False))
    bad_header = ~c("counted") & (l != "@@") if fragment else ~c("counted")
    short = (c("olds") < c("head.old")) | (c("news") < c("head.new"))
    differs = (event("old") & (c("named") != c("own.old"))) | (event("new") & (c("named") != c("own.new")))
    # (test, when and at which step it is told, code, line, path, hunk)
    told = [
        (c("head.hunk") & (c("header") | c("body")) & ~c("goes_on") & short, after, 0, "incomplete_hunk", c("head.at"), path, number),
        (c("is_last") & (c("n_hunks") == 0) & _either_not_both("old_at", "new_at"), after, 1, "missing_file_marker_pair", F.coalesce("old_at", "new_at"), path, none),
        (c("is_last") & (c("n_hunks") == 0) & c("old_at").isNotNull() & c("new_at").isNotNull(), after, 2, "missing_hunk", c("new_at"), path, none),
        (c("is_last") & _either_not_both("from_at", "to_at"), after, 3, "partial_rename_metadata", F.coalesce("from_at", "to_at"), path, none),
        (c("git") & ~c("heads.ok"), here, 4, "malformed_git_header", here, none, none),
        (c("marker") & c("event").isNull(), here, 4, "invalid_file_marker", here, path, none),
        (event("new") & ~c("has_old"), here, 5, "reordered_file_markers", here, F.coalesce("named", "path_before"), none),
        (c("header") & (number == 1) & ~c("paired"), here, 5, "missing_file_marker_pair", here, path, number),
        (differs, here, 6, "conflicting_file_path", here, c("named"), none),
        (c("header") & bad_header, here, 6, "malformed_hunk_header", here, path, number),
        (c("body") & ~l.rlike("^[-+ ]") & (l != r"\ No newline at end of file"), here, 7, "invalid_hunk_body_line", here, path, number),
        (c("over_at") == here, here, 7, "overflowing_hunk", here, path, number),
    ]
    one = lambda when, step, code, line, file, hunk: F.struct(when.alias("told"), F.lit(step).alias("step"), F.lit(code).alias("code"), line.cast("long").alias("line_number"), file.cast("string").alias("file_path"), hunk.cast("long").alias("hunk_index"))
    found = rows.select(*keys, F.explode(F.array_compact(F.array(*[F.when(test, one(*x)) for test, *x in told]))).alias("d")).select(*keys, "d.*")
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("told", "step"))).drop("told", "step")
    begun = F.exists(T.split_lines(_whole_text(diffs, text)), lambda x: x.rlike("^(?:diff --git|---|[+]{3}|rename from |rename to |@@)"))
    as_whole = F.when(_blank(_whole_text(diffs, text)), "empty_input").when(~begun, "non_diff_input")
    others = diffs.select(*keys, as_whole.alias("code")).filter("code IS NOT NULL").select(*keys, "code", F.when(c("code") == "non_diff_input", 1).cast("long").alias("line_number"), none.cast("string").alias("file_path"), none.cast("long").alias("hunk_index"), F.lit(1).alias("nth"))
    says = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    return found.unionByName(others).select(*keys, "nth", "code", says[c("code")].alias("message"), "line_number", "file_path", "hunk_index")


_COUNTED_LINE = re.compile(parse.HUNK.pattern + r"(?: .*)?\Z")
_OPEN_END = re.compile(r' "(?:\\.|[^"\\])*"\Z')


def _git_paths(line: str) -> tuple[bool, str | None, str | None]:
    """Whether a header's paths are in order, and both of them; sides that the line leaves open are none."""
    sides = [None if x is None else parse.clean_path(x) for x in parse.header_sides(line)]
    named = [None if x is None or not parse.is_diff_path(x) else parse.stripped_path(x) for x in sides]
    good = None not in named
    left_open = sides[0] is None and line.startswith("diff --git a/") and ((" b/" in line and not line.endswith(" b/")) or _OPEN_END.search(line) is not None)
    return good or left_open, named[0] if good else None, named[1] if good else None


class _Section:
    """A file's section: its paths so far, and where its markers, renames and hunks stand."""

    def __init__(self, own: tuple[str | None, str | None]):
        self.own = own
        self.old = self.new = self.old_at = self.new_at = self.from_at = self.to_at = None
        self.hunks = 0

    @property
    def path(self) -> str | None:
        return self.old if self.new is None else self.new


def faults(text: str, fragment: bool) -> list[tuple[str, int, str | None, int | None]]:
    """(code, line, path, hunk) of all that is wrong with a diff that isn't blank, in order of reading; by the rules of ``_read``."""
    told: list[tuple[int, int, str, int, str | None, int | None]] = []
    section, counts, prior, nth = _Section((None, None)), None, None, -1
    in_hunk = ended = over = False
    head_at = olds = news = 0

    def end_hunk(at: int) -> None:
        if in_hunk and not ended and counts is not None and (olds < counts[1] or news < counts[3]):
            told.append((at + 1, 0, "incomplete_hunk", head_at, section.path, section.hunks))

    def end_section(at: int) -> None:
        if section.hunks == 0:
            if (section.old_at is None) != (section.new_at is None):
                told.append((at + 1, 1, "missing_file_marker_pair", section.new_at if section.old_at is None else section.old_at, section.path, None))
            elif section.old_at is not None:
                told.append((at + 1, 2, "missing_hunk", section.new_at, section.path, None))
        if (section.from_at is None) != (section.to_at is None):
            told.append((at + 1, 3, "partial_rename_metadata", section.to_at if section.from_at is None else section.from_at, section.path, None))

    at = 0
    for at, line in enumerate(text.splitlines(), 1):
        git, header = line.startswith("diff --git"), line.startswith("@@")
        marker = line.startswith(("---", "+++"))
        first = line[:1]
        if git:
            end_hunk(at - 1)
            if at > 1:
                end_section(at - 1)
            in_hunk, counts = False, None
            ok, old, new = _git_paths(line)
            section = _Section((old, new))
            section.old, section.new = old, new
            if not ok:
                told.append((at, 4, "malformed_git_header", at, None, None))
            prior = "git"
            continue
        if header:
            end_hunk(at - 1)
            counted = _COUNTED_LINE.match(line) is not None
            in_hunk, ended, over, head_at, olds, news = True, False, False, at, 0, 0
            counts = parse.hunk_counts(line) if counted else None
            section.hunks += 1
            if section.hunks == 1 and (section.old_at is None or section.new_at is None):
                told.append((at, 5, "missing_file_marker_pair", at, section.path, section.hunks))
            if not counted and not (fragment and line == "@@"):
                told.append((at, 6, "malformed_hunk_header", at, section.path, section.hunks))
            prior = "hunk"
            continue
        if in_hunk and not ended and marker and (counts is None or (olds >= counts[1] and news >= counts[3])):
            end_hunk(at - 1)
            ended = True
        body = in_hunk and not ended
        on_old, on_new = first in ("-", " ") and first != "", first in ("+", " ") and first != ""
        if body:
            olds, news = olds + on_old, news + on_new
            if not (first and first in "-+ ") and line != r"\ No newline at end of file":
                told.append((at, 7, "invalid_hunk_body_line", at, section.path, section.hunks))
            if not over and counts is not None and (on_old or on_new) and (olds > counts[1] or news > counts[3]):
                over = True
                told.append((at, 7, "overflowing_hunk", at, section.path, section.hunks))
            continue
        if marker:
            clean, is_old = parse.clean_path(line[4:]), first == "-"
            sign, prefix = ("--- ", "a/") if is_old else ("+++ ", "b/")
            if not (line.startswith(sign) and (clean == "/dev/null" or (clean.startswith(prefix) and len(clean) > 2))):
                told.append((at, 4, "invalid_file_marker", at, section.path, None))
                continue
            event, named = "old" if is_old else "new", parse.stripped_path(clean)
            nth = 0 if prior in (None, "git", "hunk", event) else nth + 1
            if nth % 2 == 0 and not (nth == 0 and prior in (None, "git")):
                if at > 1:
                    end_section(at - 1)
                section = _Section((None, None))
            before = section.path
            if is_old:
                section.old, section.old_at = named, at
            else:
                section.new, section.new_at = named, at
                if section.old_at is None:
                    told.append((at, 5, "reordered_file_markers", at, before if named is None else named, None))
            own = section.own[0 if is_old else 1]
            if named is not None and own is not None and named != own:
                told.append((at, 6, "conflicting_file_path", at, named, None))
            prior = event
        elif line.startswith("rename from "):
            section.old, section.from_at = parse.stripped_path(parse.clean_path(line[12:])), at
        elif line.startswith("rename to "):
            section.new, section.to_at = parse.stripped_path(parse.clean_path(line[10:])), at
    end_hunk(at)
    if at:
        end_section(at)
    return [x[2:] for x in sorted(told, key=lambda x: x[:2])]


_BEGUN = ("diff --git", "---", "+++", "rename from ", "rename to ", "@@")


def diagnostics_of_texts(diffs: DataFrame, keys: Sequence[str], text: str = "diff", fragment: bool = False) -> DataFrame:
    """``diagnostics`` by a walk over each text: nothing is shuffled or sorted, and a task holds a few diffs."""

    def make(some: str | None) -> Iterator[tuple[object, ...]]:
        if not (some or "").strip():
            yield 1, "empty_input", MESSAGES["empty_input"], None, None, None
        else:
            found = faults(some, fragment)
            if not any(x.startswith(_BEGUN) for x in some.splitlines()):
                found = [*found, ("non_diff_input", 1, None, None)]
            for n, (code, line, path, hunk) in enumerate(found, 1):
                yield n, code, MESSAGES[code], line, path, hunk

    return over_texts(diffs, keys, [text], [("nth", "int"), ("code", "string"), ("message", "string"), ("line_number", "long"), ("file_path", "string"), ("hunk_index", "long")], make)


def shape_issues(diffs: DataFrame, keys: Sequence[str], text: str = "diff") -> DataFrame:
    """(keys, issues): why suggestions of this shape can't be scored, in a fixed order; none for those that can."""

    def make(some: str | None) -> Iterator[tuple[object, ...]]:
        paths, removes, hunks, moved = set(), False, set(), {}
        for r in parse.rows(some):
            if not r.file:
                continue
            moved[r.file] = r.rename_from is not None or r.rename_to is not None
            if r.kind in ("addition", "deletion", "context"):
                hunks.add((r.file, r.hunk))
                if r.kind != "context" and r.line[1:].strip():
                    if r.kind == "deletion":
                        removes = True
                    elif r.new_path is not None:
                        paths.add(r.new_path)
        yield not (some or "").strip(), len(paths), removes, len(hunks), any(moved.values())

    keys = list(keys)
    all_ = over_texts(diffs, keys, [text], [("is_blank", "boolean"), ("n", "long"), ("removes", "boolean"), ("hunks", "long"), ("renames", "boolean")], make)
    why = [(F.col("is_blank"), EMPTY), (F.col("n") == 0, NOTHING_ADDED), (F.col("removes"), REMOVES), (F.col("n") > 1, MANY_FILES), (F.col("hunks") > 1, MANY_HUNKS), (F.col("renames"), RENAMES)]
    return all_.select(*keys, F.array_compact(F.array(*[F.when(test, said) for test, said in why])).alias("issues"))


def support_state(diffs: DataFrame, keys: Sequence[str], text: str = "diff", source: str = "suggested_diff") -> DataFrame:
    """(keys, status, reasons): invalid, valid_but_unsupported (suggestions alone) or valid, and why."""
    keys, suggested = list(keys), source == "suggested_diff"
    said = F.concat(F.lit(f"{source} is invalid ["), F.col("code"), F.lit("]: "), F.col("message"))
    wrong = diagnostics_of_texts(diffs, keys, text, suggested).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", said.alias("said")))), lambda x: x["said"]).alias("wrong"))
    nothing = F.array().cast("array<string>")
    shapes = shape_issues(diffs, keys, text) if suggested else diffs.select(*keys, nothing.alias("issues"))
    both = shapes.join(wrong, keys, "left").withColumn("wrong", F.coalesce("wrong", nothing))
    status = F.when(F.size("wrong") > 0, "invalid").when(F.size("issues") > 0, "valid_but_unsupported").otherwise("valid")
    return both.select(*keys, status.alias("status"), F.concat("wrong", "issues").alias("reasons"))


def landing_paths(paths: DataFrame, files: DataFrame, keys: Sequence[str], path: str = "path") -> DataFrame:
    """(keys, path, landed_path, change): where a suggestion's file went by the first file of the merged diff that names it."""
    keys = list(keys)
    f = files.select(*[F.col(k).alias(f"_{k}") for k in keys], "file_ord", F.col("old_path").alias("_old"), F.col("new_path").alias("_new"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    met = paths.select(*keys, path).distinct().join(f, same & ((F.col("_old") == F.col(path)) | (F.col("_new") == F.col(path))), "left")
    first = met.groupBy(*keys, path).agg(F.min_by(F.struct("_old", "_new", "file_ord"), "file_ord").alias("f"))
    found, old, new = F.col("f").isNotNull() & F.col("f.file_ord").isNotNull(), F.col("f._old"), F.col("f._new")
    change = F.when(found & new.isNull(), "deleted").when(found & (old != new), "renamed").otherwise("same")
    return first.select(*keys, path, F.when(found, new).otherwise(F.col(path)).alias("landed_path"), change.alias("change"))
