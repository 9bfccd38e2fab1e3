"""A unified diff read line by line in Python, for Arrow-batched operators that need no row for each line.

The rules are those of ``operators.diff``: what a line means depends on its hunk, markers and headers
before it. White space and line ends follow Python's ``str`` methods, as ``text`` does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

HUNK = re.compile(r"@@ -([0-9]+)(?:,([0-9]+))? \+([0-9]+)(?:,([0-9]+))? @@")
_QUOTED = r'"(?:\\.|[^"\\])*"'
_GIT = re.compile(rf"diff --git (?:({_QUOTED}) ({_QUOTED}|b/.+)|(a/\S+) (b/\S+)|(a/\S+) ({_QUOTED}))\Z", re.ASCII)
_PART = re.compile(r"\\[0-7]{1,3}|\\.|[^\\]+|\\")
_ESCAPES = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, '"': 34, "\\": 92}
_MOST = 1 << 62
_SIGNS = {"+": "addition", "-": "deletion", " ": "context"}


class Row(NamedTuple):
    """A line of a diff with what it is; file 0 is before any."""

    at: int
    file: int
    kind: str | None
    line: str
    hunk: int
    old_path: str | None
    new_path: str | None
    rename_from: str | None
    rename_to: str | None
    old_number: int | None
    new_number: int | None

    @property
    def path(self) -> str | None:
        """The path of the line's side."""
        return self.old_path if self.kind == "deletion" else self.new_path


def unquoted(path: str) -> str:
    """A path in double quotes with C escapes and octal bytes, decoded; other paths as they are."""
    if len(path) < 2 or path[0] != '"' or path[-1] != '"':
        return path
    out = bytearray()
    for p in _PART.findall(path[1:-1]):
        if p[0] == "\\" and p[1:2] in "01234567" and len(p) > 1:
            n = int(p[1:], 8)
            out += bytes([n]) if n <= 255 else p.encode()
        elif p[0] == "\\" and len(p) > 1:
            out += bytes([_ESCAPES[p[1]]]) if p[1] in _ESCAPES else p[1:].encode("utf-8", "surrogatepass")
        else:
            out += p.encode("utf-8", "surrogatepass")
    return out.decode("utf-8", "replace")


def clean_path(raw: str) -> str:
    path = raw.strip().partition("\t")[0]
    return unquoted(path) if path[:1] == '"' else path


def stripped_path(clean: str) -> str | None:
    """A cleaned path without its a/ or b/; none for /dev/null and for an empty one."""
    if clean == "/dev/null":
        return None
    return clean[2:] if clean[:2] in ("a/", "b/") else clean or None


def is_diff_path(clean: str) -> bool:
    return clean == "/dev/null" or clean[:2] in ("a/", "b/")


def header_sides(line: str) -> tuple[str | None, str | None]:
    """The two raw paths of a ``diff --git`` line; none where the line leaves them open."""
    m = _GIT.match(line)
    return (m[1] or m[3] or m[5], m[2] or m[4] or m[6]) if m else (None, None)


def _header_paths(line: str) -> tuple[str | None, str | None]:
    old, new = header_sides(line)
    if old is None or new is None:
        return None, None
    old, new = clean_path(old), clean_path(new)
    if not (is_diff_path(old) and is_diff_path(new)):
        return None, None
    named = stripped_path(old), stripped_path(new)
    return (None, None) if None in named else named


def hunk_counts(line: str) -> tuple[int, int, int, int] | None:
    """Start and count of the old and of the new side; numbers that no long can hold are the largest one."""
    m = HUNK.match(line)
    if m is None:
        return None
    number = lambda d: int(d) if len(d) < 19 or (len(d.lstrip("0")) <= 19 and int(d) < 1 << 63) else _MOST
    return number(m[1]), 1 if m[2] is None else number(m[2]), number(m[3]), 1 if m[4] is None else number(m[4])


def rows(text: str | None) -> Iterator[Row]:
    """Every line of a diff."""
    file = hunk = olds = news = 0
    seen = in_hunk = marked = False
    counts: tuple[int, int, int, int] | None = None
    closed = False
    prior = old_path = new_path = rename_from = rename_to = None
    for at, line in enumerate((text or "").splitlines()):
        first, kind, old_number, new_number = line[:1], None, None, None
        if first == "d" and line.startswith("diff --git "):
            kind, seen, in_hunk, counts, file, hunk = "git", True, False, None, file + 1, 0
            old_path, new_path = _header_paths(line)
            rename_from = rename_to = None
        elif first == "@" and seen and line.startswith("@@"):
            kind, in_hunk, marked, hunk, olds, news = "hunk", True, False, hunk + 1, 0, 0
            counts = hunk_counts(line)
            closed = counts is not None and counts[1] == counts[3] == 0
        else:
            old_marker = new_marker = False
            if first == "-" and line.startswith("--- "):
                clean = clean_path(line[4:])
                old_marker = is_diff_path(clean)
            elif first == "+" and line.startswith("+++ "):
                clean = clean_path(line[4:])
                new_marker = is_diff_path(clean)
            seen = seen or old_marker or new_marker
            marked = marked or old_marker or new_marker
            inside = in_hunk and (not marked if counts is None else not closed)
            in_counted = inside and counts is not None
            if in_hunk:
                olds += first in ("-", " ") and first != ""
                news += first in ("+", " ") and first != ""
                if counts is not None and olds == counts[1] and news == counts[3]:
                    closed = True
            if old_marker and not in_counted:
                kind = "old_marker"
                if prior != "git":
                    file, old_path, new_path, rename_from, rename_to = file + 1, None, None, None, None
                old_path = stripped_path(clean)
            elif new_marker and not in_counted:
                kind = "new_marker"
                if prior is None:
                    file, old_path, new_path, rename_from, rename_to = file + 1, None, None, None, None
                new_path = stripped_path(clean)
            elif inside:
                kind = _SIGNS.get(first)
                if kind in ("deletion", "context"):
                    old_number = (counts[0] if counts else 0) + olds - 1
                if kind in ("addition", "context"):
                    new_number = (counts[2] if counts else 0) + news - 1
            elif first == "r" and line.startswith("rename from "):
                kind = "rename_from"
                rename_from = old_path = stripped_path(clean_path(line[12:]))
            elif first == "r" and line.startswith("rename to "):
                kind = "rename_to"
                rename_to = new_path = stripped_path(clean_path(line[10:]))
        if kind is not None and kind not in ("hunk", "rename_from", "rename_to"):
            prior = kind
        yield Row(at, file, kind, line, hunk, old_path, new_path, rename_from, rename_to, old_number, new_number)


def collapsed(text: str) -> str:
    """Runs of white space as one space, none at the ends."""
    return " ".join(text.split())
