"""Languages by extension and globs on paths, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSIONS = {
    "python": "py pyi", "rust": "rs", "javascript": "cjs js jsx mjs", "typescript": "ts tsx", "java": "java", "c": "c h",
    "cpp": "cc cpp cxx h++ hpp", "go": "go", "json": "json jsonc", "csharp": "cs", "ruby": "rb", "php": "php",
}
BY_EXTENSION = {e: lang for lang, es in EXTENSIONS.items() for e in es.split()}


def detect_language(path: Column) -> Column:
    """Language of a path, null for others and for names that begin with their only dot."""
    ext = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    out = F.when(F.lit(False), F.lit(""))
    for lang, es in EXTENSIONS.items():
        out = out.when(ext.isin(*es.split()), F.lit(lang))
    return out


def language_of(path: str) -> str | None:
    m = re.search(r"[^/]\.([^./]+)$", path)
    return BY_EXTENSION.get(m[1]) if m else None


def glob_regex(pattern: str) -> str:
    """`**` crosses folders, `*` and `?` don't, `{a,b}` and `[a-z]` as usual; any further brace is literal."""
    out, depth, i = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 2
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 1
        elif c in "*?":
            out += "[^/]*" if c == "*" else "[^/]"
        elif c == "{" and "}" in pattern[i:]:
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        elif c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inside = pattern[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]", end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))
