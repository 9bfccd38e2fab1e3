"""Column functions on text: white space, lines, tokens, languages, paths and fingerprints.

All are expressions over built-in functions. White space, line ends and word characters
follow Unicode as Python's ``str`` methods do, which Java's ``\\s`` and ``\\w`` don't.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
TOKEN = r"([A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?|==|!=|<=|>=|->|=>|[^" + WS + "])"
WORD = r"([\p{L}\p{N}_]+)"

# The keywords of Python.
KEYWORDS = ("False", "None", "True", "and", "as", "assert", "async", "await", "break", "class", "continue", "def", "del", "elif", "else", "except", "finally", "for", "from", "global", "if", "import", "in", "is", "lambda", "nonlocal", "not", "or", "pass", "raise", "return", "try", "while", "with", "yield")
# Tokens that say little about which change it is.
COMMON = ("!=", "(", ")", ",", ".", ":", "=", "==", "False", "None", "True", "[", "]", "and", "as", "class", "def", "elif", "else", "except", "finally", "for", "from", "if", "import", "in", "is", "not", "or", "return", "try", "while", "with", "{", "}")
# The language of each file extension.
LANGUAGES = {
    ".py": "python",
    ".c": "c",
    ".cc": "cpp",
    ".cpp": "cpp",
    ".cxx": "cpp",
    ".h": "c",
    ".hpp": "cpp",
    ".hxx": "cpp",
    ".java": "java",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".go": "go",
    ".groovy": "groovy",
    ".hcl": "hcl",
    ".htm": "html",
    ".html": "html",
    ".ipynb": "jupyter_notebook",
    ".rs": "rust",
    ".rb": "ruby",
    ".php": "php",
    ".json": "json",
    ".yaml": "yaml",
    ".yml": "yaml",
    ".md": "markdown",
    ".sh": "shell",
    ".bash": "shell",
    ".zsh": "shell",
    ".tf": "hcl",
    ".toml": "toml",
    ".xml": "xml",
}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+$", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, f"[{WS}]+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def split_lines(c: Column) -> Column:
    """The lines; what ends the last one starts no other."""
    parts = F.split(c, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def code_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(1))


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(1))


def is_identifier(t: Column) -> Column:
    return t.rlike("^[A-Za-z_][A-Za-z0-9_]*$") & ~t.isin(*KEYWORDS)


def is_literal(t: Column) -> Column:
    return t.rlike(r"^(?:\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')$") | t.rlike(r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$") | t.isin("true", "false", "null", "True", "False", "None")


def identifier_form(t: Column) -> Column:
    return F.when(is_identifier(t), "IDENT").otherwise(t)


def literal_form(t: Column) -> Column:
    return F.when(is_literal(t), "LITERAL").otherwise(t)


def combined_form(t: Column) -> Column:
    """Identifiers first, so ``true`` is one and ``True``, a keyword, is a literal."""
    return F.when(is_identifier(t), "IDENT").when(is_literal(t), "LITERAL").otherwise(t)


def is_anchor(t: Column) -> Column:
    """Tokens that point to one change: not common, not short, and an identifier, string or number."""
    digits, quoted = t.rlike("^[0-9]+$"), t.rlike(r"^(?:\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*')$")
    return ~t.isin(*COMMON) & ((F.length(t) > 2) | digits) & (is_identifier(t) | quoted | digits)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def suffix(path: Column) -> Column:
    """The last extension with its full stop, lower-cased; none for names that only start or end with one."""
    return F.lower(F.regexp_extract(file_name(path), r"[^.].*?(\.[^.]+)$", 1))


def language(path: Column) -> Column:
    name = file_name(path)
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.when(F.lower(name).isin("dockerfile", "containerfile"), "dockerfile").when(name == "Jenkinsfile", "groovy").otherwise(F.coalesce(F.try_element_at(known, suffix(path)), F.lit("text")))


def exact_fingerprint(text: Column) -> Column:
    """sha256 of a text whose lines have lost the white space at their ends."""
    return F.sha2(F.array_join(F.transform(split_lines(text), rstrip), "\n"), 256)


def near_form(line: Column) -> Column:
    """A line's tokens with identifiers and numbers as placeholders, joined by spaces."""
    tokens = F.regexp_extract_all(line, F.lit(r"([A-Za-z_][A-Za-z0-9_]*|[0-9]+(?:\.[0-9]+)?|[^" + WS + "])"), F.lit(1))
    return F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^[A-Za-z_]"), "<identifier>").when(t.rlike("^[0-9]"), "<number>").otherwise(t)), " ")


def short_id(*parts: Column, size: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, size)


def hash_split(group: Column) -> Column:
    """train, development or calibration (70, 15, 15 in a hundred) by the group's hash."""
    n = F.conv(F.substring(F.sha2(group, 256), 1, 8), 16, 10).cast("long") % 100
    return F.when(n < 70, "train").when(n < 85, "development").otherwise("calibration")


_ESCAPES = {"a": "07", "b": "08", "t": "09", "n": "0A", "v": "0B", "f": "0C", "r": "0D", '"': "22", "\\": "5C"}


def unquote_path(c: Column) -> Column:
    """A path in double quotes with C escapes and octal bytes, decoded; other paths as they are."""
    parts = F.regexp_extract_all(F.substring(c, F.lit(2), F.length(c) - 2), F.lit(r"(\\[0-7]{1,3}|\\.|[^\\]+|\\)"), F.lit(1))
    escapes = F.create_map(*[F.lit(x) for pair in _ESCAPES.items() for x in pair])

    def as_hex(p: Column) -> Column:
        octal = F.conv(F.substring(p, 2, 3), 8, 10).cast("int")
        text = F.hex(F.encode(p, "UTF-8"))
        return (
            F.when(p.rlike(r"^\\[0-7]{1,3}$"), F.when(octal <= 255, F.lpad(F.hex(octal), 2, "0")).otherwise(text))
            .when(p.rlike(r"^\\.$"), F.coalesce(F.try_element_at(escapes, F.substring(p, 2, 1)), F.hex(F.encode(F.substring(p, 2, 9), "UTF-8"))))
            .otherwise(text)
        )

    quoted = (F.length(c) >= 2) & c.startswith('"') & c.endswith('"')
    return F.when(quoted, F.decode(F.unhex(F.array_join(F.transform(parts, as_hex), "")), "UTF-8")).otherwise(c)


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once: a bound variable, not a copy for each mention."""
    return F.element_at(F.transform(F.array(value), then), 1)


def clean_path(raw: Column) -> Column:
    return let(F.substring_index(strip(raw), "\t", 1), lambda c: F.when(c.startswith('"'), unquote_path(c)).otherwise(c))


def stripped_path(clean: Column) -> Column:
    """A cleaned path without its a/ or b/; null for /dev/null and for none."""
    return F.when(clean == "/dev/null", None).when(clean.rlike("^[ab]/"), F.substring(clean, F.lit(3), F.length(clean))).otherwise(F.nullif(clean, F.lit("")))


def normal_path(raw: Column) -> Column:
    return let(clean_path(raw), stripped_path)


def is_diff_path(clean: Column) -> Column:
    return (clean == "/dev/null") | clean.rlike("^[ab]/")


_QUOTED = r'"(?:\\.|[^"\\])*"'


def header_sides(line: Column) -> tuple[Column, Column]:
    """The two raw paths of a ``diff --git`` line; null where the line leaves them open."""
    either = "|".join(f"({a}) ({b})" for a, b in ((_QUOTED, f"{_QUOTED}|b/.+"), (r"a/\S+", r"b/\S+"), (r"a/\S+", _QUOTED)))
    found = lambda n: F.nullif(F.regexp_extract(line, f"^diff --git (?:{either})$", n), F.lit(""))
    return F.coalesce(found(1), found(3), found(5)), F.coalesce(found(2), found(4), found(6))
