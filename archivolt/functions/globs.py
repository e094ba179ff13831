"""Shell globs as column predicates, translated to regular expressions once."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Folders and endings that hold no documents: of version control, of programs and their building, of caches,
#: of packed and streamed data. What keeps a path out of the census unless a configuration names other globs.
FOLDERS = ("__pycache__", "build", "dist", "node_modules", "site-packages", "target", "vendor", "venv", ".venv", ".cache", ".git", ".hg", ".svn", ".Trash", "*.git", "*.app")
SYSTEM = ("*/Library", "*/Library/*", "*/Caches", "*/Caches/*")
ENDINGS = "7z a avi bin bz2 class dmg flac gguf gz iso jar lock log m4a mkv mov mp3 mp4 o onnx part pkg rar safetensors so sqlite sqlite3 swp tar tmp wasm wav xz zip"
DENY = (*FOLDERS, *SYSTEM, ".DS_Store", *(f"*.{e}" for e in ENDINGS.split()))


def glob_regex(glob: str) -> str:
    """A regular expression, in a syntax that Java, RE2 and Python share, for what the glob matches as a whole; ``*`` crosses slashes."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]"
            i = end
        else:
            out += re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", c)
        i += 1
    return f"^(?s:{out})$"


def matches_glob(column: Column, glob: str) -> Column:
    return column.rlike(glob_regex(glob))


def _matcher(pattern: str):
    return lambda part: part.rlike(pattern)


def denied_by(path: Column, globs: Sequence[str] = DENY) -> Column:
    """The first glob that keeps a file's path out, or null. Case is ignored. A
    glob with a slash is held against the whole path (also without its trailing
    ``/*``), one without against the name and every folder above it."""
    low = F.lower(path)
    parts = F.split(low, "/")
    tests = []
    for glob in globs:
        g = glob.lower()
        if "/" in g:
            short = g.rstrip("/*")
            test = matches_glob(low, g)
            tests.append(F.when(test | matches_glob(low, short) if short != g else test, glob))
        else:
            tests.append(F.when(F.exists(parts, _matcher(glob_regex(g))), glob))
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")


def first_class(path: Column, classes: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The first class one of whose globs matches ``path`` (case counts), or null."""
    tests = [F.when(matches_glob(path, g), name) for name, globs in classes for g in globs]
    return F.coalesce(*tests) if tests else F.lit(None).cast("string")
