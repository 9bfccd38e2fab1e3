"""A line-by-line reading of unified diffs, to hold the windows of the parser against."""

import re

HEAD = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def named(raw):
    path = raw.strip().split("\t")[0]
    return None if path in ("/dev/null", "") else path[2:] if path[:2] in ("a/", "b/") else path


def marks(line, sign):
    path = line[4:].strip().split("\t")[0]
    return line.startswith(sign + " ") and (path == "/dev/null" or path[:2] in ("a/", "b/"))


def walk(text):
    """[(file, hunk, line, operation, text, old path, new path, old number, new number)]"""
    out, file, started, fresh = [], 0, False, False
    state = {"old": None, "new": None}
    hunk, open_, left, at = 0, False, None, [0, 0]
    for n, line in enumerate(text.splitlines()):
        if line.startswith("diff --git "):
            file, started, fresh, hunk, open_ = file + 1, True, True, 0, False
            m = re.fullmatch(r"(a/\S+) (b/\S+)", line[11:])
            state = {"old": named(m[1]) if m else None, "new": named(m[2]) if m else None}
            continue
        free = not (open_ and left is not None)
        if marks(line, "---") and free:
            if not (started and fresh):
                file, state = file + 1, {"old": None, "new": None}
            started, fresh, open_, state["old"] = True, False, False, named(line[4:])
            continue
        if marks(line, "+++") and free:
            if not started:
                file += 1
            started, fresh, open_, state["new"] = True, False, False, named(line[4:])
            continue
        if not started:
            continue
        for word, side in (("rename from ", "old"), ("rename to ", "new")):
            if line.startswith(word) and not open_:
                state[side] = named(line[len(word) :])
        if line.startswith("@@"):
            m, hunk, open_ = HEAD.match(line), hunk + 1, True
            at = [int(m[1]), int(m[3])] if m else [0, 0]
            left = [int(m[2] or 1), int(m[4] or 1)] if m else None
            open_ = left != [0, 0]
            continue
        if open_ and line[:1] in ("+", "-", " ") and line:
            old, new = line[0] != "+", line[0] != "-"
            out.append((file, hunk, n, {"+": "addition", "-": "deletion", " ": "context"}[line[0]], line[1:], state["old"], state["new"], at[0] if old else None, at[1] if new else None))
            fresh = False
            at = [at[0] + old, at[1] + new]
            if left is not None:
                left = [left[0] - old, left[1] - new]
        if open_ and left == [0, 0]:
            open_ = False
    return out
