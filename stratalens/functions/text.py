"""Scalar functions as Columns: names, lines, ranges, secrets, markers. All of them stay inside Catalyst."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Secret shapes that a summary must never show. Needed as they are, for equal results.
SECRET_SHAPES = (
    r"sk-ant-[A-Za-z0-9_-]{8,}",
    r"sk-[A-Za-z0-9_-]{16,}",
    r"(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{8,}",
    r"gh[pousr]_[A-Za-z0-9]{16,}",
    r"glpat-[A-Za-z0-9_-]{16,}",
    r"AKIA[0-9A-Z]{12,}|ASIA[0-9A-Z]{12,}",
    r"xox[baprs]-[A-Za-z0-9-]{8,}",
    r"AIza[0-9A-Za-z_-]{20,}",
    r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}",
    r"hooks\.slack\.com/services/[A-Za-z0-9/]+",
    r"discord(?:app)?\.com/api/webhooks/[0-9]+/[A-Za-z0-9_-]+",
    r"eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{6,}(?:\.[A-Za-z0-9_-]+)?",
    r"-----BEGIN[ A-Z]*PRIVATE KEY-----",
    r"[A-Za-z][\w.+-]*://[^\s/:@]+:[^\s/@]+@",
    r"(?i:password|passwd|pwd|passphrase|secret|api[_-]?key|access[_-]?key|account[_-]?key|shared[_-]?access[_-]?key"
    r"|client[_-]?secret|auth[_-]?token|access[_-]?token|refresh[_-]?token|session[_-]?token|private[_-]?key)"
    r"\s*[=:]\s*(?!<[a-z]+>)[^\s;,'\"]{4,}",
    r"(?i:bearer|basic|ssws)\s+[A-Za-z0-9+/=._-]{8,}",
)
OPAQUE = r"[A-Za-z0-9+/=_-]{32,}"
REDACTED = "<redacted>"
TIMESTAMP_PREFIX = "refreshed:"
READ_CAP = 400
#: Where splitlines() breaks a text, as one pattern.
LINE_BREAK = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"


def let(value: Column, f) -> Column:
    """f(value), value being computed once."""
    return F.transform(F.array(value), f)[0]


def split_lines(text: Column) -> Column:
    """The lines as splitlines() gives them: at every kind of break, no empty one after the last."""
    return let(F.split(text, LINE_BREAK, -1), lambda x: F.when(text == "", F.array().cast("array<string>")).when(F.element_at(x, -1) == "", F.slice(x, 1, F.size(x) - 1)).otherwise(x))


def redact(text: Column, opaque: bool = True) -> Column:
    """Secret-shaped parts become <redacted>; opaque=False spares long blobs, for prose. Null stays null."""
    out = F.regexp_replace(text, "(?U)" + "|".join(SECRET_SHAPES), REDACTED)
    return F.regexp_replace(out, OPAQUE, REDACTED) if opaque else out


def leaf(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def head(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def dotted(name: Column) -> Column:
    return name.contains(".")


def code_lines(text: Column) -> Column:
    """Line feeds plus one."""
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def prose_lines(text: Column) -> Column:
    """Lines as splitlines() counts them: a break at the end begins no line."""
    parts = F.split(text, LINE_BREAK, -1)
    n = F.size(parts)
    return F.when(text == "", 0).when(F.element_at(parts, -1) == "", n - 1).otherwise(n).cast("bigint")


def anchor(line: Column, end: Column) -> Column:
    a = line.cast("string")
    return F.when(line.isNull() | (line == 0), "").when(end.isNull() | (end == 0) | (end == line), F.concat(F.lit("  # L"), a)).otherwise(F.concat(F.lit("  # L"), a, F.lit("-"), end.cast("string")))


def strip_timestamp(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda x: ~x.startswith(TIMESTAMP_PREFIX)), "\n")


def read_range(text: Column, start: Column, end: Column, cap: int = READ_CAP) -> Column:
    """Lines start..end (from 1, clamped), at most cap of them, with a notice where the text ends or the cap cuts."""
    lines = F.split(text, "\n", -1)
    n = F.size(lines)
    s = F.greatest(start, F.lit(1)).cast("int")
    e = F.least(end, n).cast("int")
    shown = F.slice(lines, s, F.greatest(F.least(e - s + 1, F.lit(cap)), F.lit(0)))
    body = F.array_join(shown, "\n")
    notice = F.when(s > n, F.concat(F.lit("(EOF: "), n.cast("string"), F.lit(" lines)"))).when(e - s + 1 > cap, F.concat(body, F.lit(f"\n(capped at {cap} lines)")))
    return F.coalesce(notice, body)


def read_full(text: Column, cap: int = READ_CAP) -> Column:
    lines = F.split(text, "\n", -1)
    cut = F.concat(F.array_join(F.slice(lines, 1, cap), "\n"), F.lit("\n(truncated at "), F.lit(str(cap)), F.lit(" of "), F.size(lines).cast("string"), F.lit(" lines)"))
    return F.when(F.size(lines) > cap, cut).otherwise(text)


def replace_unique(text: Column, old: Column, new: Column) -> Column:
    """text with its only occurrence of old replaced; null where old occurs never or more than once."""
    times = (F.length(text) - F.length(F.replace(text, old, F.lit("")))) / F.length(old)
    return F.when((F.length(old) > 0) & (times == 1), F.replace(text, old, new))


def heading_level(signature: Column) -> Column:
    return F.greatest(F.length(F.regexp_extract(signature, "^#+", 0)), F.lit(1))


def heading_label(signature: Column) -> Column:
    return F.trim(F.regexp_replace(signature, "^#+", ""))


def name_tokens(name: Column) -> Column:
    """Parts of a file name of three letters or more, without folder and suffixes."""
    stem = F.substring_index(F.substring_index(F.replace(name, F.lit("\\"), F.lit("/")), "/", -1), ".", 1)
    return F.array_distinct(F.filter(F.split(stem, "[_\\-.]+"), lambda x: F.length(x) >= 3))


def folder_label(path: Column) -> Column:
    """The last folder of a path below a leading src or lib; (root) without one."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    inner = F.when(F.get(folders, F.lit(0)).isin("src", "lib"), F.slice(folders, 2, F.greatest(F.size(folders) - 1, F.lit(0)))).otherwise(folders)
    return F.coalesce(F.get(inner, F.size(inner) - 1), F.lit("(root)"))


def percent_cut(before: Column, after: Column) -> Column:
    return F.when(before == 0, 0.0).otherwise(100.0 * (before - after) / before)


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, one at least; exact and the same in SQL."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def like(text: Column, pattern: str) -> Column:
    """SQL's LIKE as an index database has it: ASCII letters match in either case, and nothing escapes a wildcard."""
    parts = {"%": ".*", "_": "."}
    return text.rlike("(?is)^" + "".join(parts.get(c) or (c if c.isalnum() or ord(c) > 127 else "\\" + c) for c in pattern) + "$")


def approx_tokens(chars: Column) -> Column:
    """A rough count for display: characters / 4, in thousands from a thousand on."""
    t = chars / 4
    whole = lambda x: F.bround(x, 0).cast("bigint").cast("string")
    return F.when(t >= 1000, F.concat(F.lit("≈ "), whole(t / 1000), F.lit("k tokens"))).otherwise(F.concat(F.lit("≈ "), whole(t), F.lit(" tokens")))


def version_tuple(version: Column) -> Column:
    return F.transform(F.split(F.ltrim(version, F.lit("v")), "\\."), lambda x: F.coalesce(F.regexp_extract(x, "^\\d+", 0).try_cast("int"), F.lit(0)))


def excluded(path: Column, patterns) -> Column:
    norm = F.replace(path, F.lit("\\"), F.lit("/"))
    out = F.lit(False)
    for p in patterns:
        out = out | norm.contains(p)
    return out


def normal_path(path: Column) -> Column:
    """An absolute path without empty, . and .. parts, as normpath() has it; links are not followed."""
    def add(acc, x):
        return F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))

    parts = F.aggregate(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1), F.array().cast("array<string>"), add)
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def confined(path: Column, root: str) -> Column:
    """Whether a path stays under a root, .. and all."""
    top = root.rstrip("/")
    return let(normal_path(path), lambda p: (p == (top or "/")) | p.startswith(top + "/"))


def _folds() -> tuple[str, str]:
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def search_tokens(text: Column) -> Column:
    """Lower-case letter and digit runs without diacritics: what full-text search indexes."""
    a, b = _folds()
    return F.regexp_extract_all(F.lower(F.translate(text, a, b)), F.lit("[\\p{L}\\p{N}\\p{Co}]+"), F.lit(0))
