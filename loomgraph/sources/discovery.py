"""Source discovery: which files there are, their languages, and which are skipped for what reason."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.exprs import glob_regex, language_of

#: Bytes at the head of a file that are searched for protected text.
HEAD = 4096


def scan(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, content, size_bytes) of every file below a folder, by a distributed scan."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = root.rstrip("/") + "/"
    return files.select(F.regexp_replace("path", "^(?:file:)?" + re.escape(base), "").alias("path"), "content", F.col("length").alias("size_bytes"))


def skip_reason(path: Column, content: Column, size: Column, exclude: Iterable[str] = (), max_kb: int = 2048) -> Column:
    """The first reason, in fixed order, to leave a file out; null if none."""
    language = language_of(path)
    head = F.decode(F.substring(content, 1, HEAD), "ISO-8859-1")
    text = F.decode(content, "ISO-8859-1")
    out = F.when(content.isNull(), "missing").when(language == "unknown", "unsupported")
    for pattern in exclude:
        out = out.when(path.rlike(glob_regex(pattern)), "exclude")
    out = out.when(size > max_kb * 1024, "size").when(head.contains("pragma protect"), "pragma_protect")
    out = out.when((language == "python") & ~text.contains("cocotb"), "not_cocotb")
    return out.when((language == "sln") & head.contains("Microsoft Visual Studio Solution File"), "visual_studio_solution")


def files(rows: DataFrame, exclude: Iterable[str] = (), max_kb: int = 2048) -> DataFrame:
    """(path, language, content_hash, size_bytes, skipped_reason) for rows (path, content, size_bytes)."""
    reason = skip_reason(F.col("path"), F.col("content"), F.col("size_bytes"), tuple(exclude), max_kb)
    return rows.select("path", language_of(F.col("path")).alias("language"), F.when(reason.isNull(), F.sha2("content", 256)).alias("content_hash"), "size_bytes", reason.alias("skipped_reason"))


def source_dirs(rows: DataFrame) -> DataFrame:
    return rows.select(F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1).alias("dir")).distinct()


def explicit(rows: DataFrame) -> DataFrame:
    """An ordered list of files (ordinal, path), each at its first place."""
    w = Window.partitionBy("path").orderBy("ordinal")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def library_of(rows: DataFrame, libraries: dict[str, str], default: str = "work") -> DataFrame:
    """The library whose folder is the longest that holds a path."""
    out = F.lit(default)
    for folder, name in sorted(libraries.items(), key=lambda x: len(x[0])):
        out = F.when(F.col("path").startswith(folder.rstrip("/") + "/"), F.lit(name)).otherwise(out)
    return rows.withColumn("library", out)


# --- file lists: small, ordered texts that include each other; read on the driver, through Spark where remote ---

TOKEN = re.compile(r'"([^"]*)"|(\S+)')


def tokens(text: str) -> list[str]:
    out = []
    for line in text.splitlines():
        line = re.sub(r"(^|\s)(//|#).*$", "", line)
        out += [a or b for a, b in TOKEN.findall(line)]
    return out


def expand_env(text: str, env: dict[str, str]) -> tuple[str, list[str]]:
    missing: list[str] = []

    def one(m: re.Match) -> str:
        name = m[1] or m[2] or m[3]
        if name not in env:
            missing.append(name)
            return m[0]
        return env[name]

    return re.sub(r"\$\{(\w+)\}|\$\((\w+)\)|\$(\w+)", one, text), missing


def parse_filelist(read, path: str, env: dict[str, str] | None = None, _open: tuple[str, ...] = ()) -> list[dict]:
    """Entries in compile order: kind (file, library_file, incdir, libdir, define, warning), value, list.

    ``read(path)`` gives a list's text or None. Nested lists stand where they are named; a list that is open already
    is left out with a warning.
    """
    env = env or {}
    text = read(path)
    if text is None:
        return [{"kind": "warning", "value": f"missing list {path}", "list": path}]
    base, out = os.path.dirname(path), []

    def place(value: str) -> str:
        return os.path.normpath(os.path.join(base, value))

    words = tokens(text)
    i = 0
    while i < len(words):
        word, missing = expand_env(words[i], env)
        out += [{"kind": "warning", "value": f"undefined variable {m}", "list": path} for m in missing]
        i += 1
        if word in ("-f", "-F", "-v", "-y"):
            if i == len(words):
                out.append({"kind": "warning", "value": f"{word} without a value", "list": path})
                break
            value = place(expand_env(words[i], env)[0])
            i += 1
            if word in ("-f", "-F"):
                if value in (*_open, path):
                    out.append({"kind": "warning", "value": f"list {value} includes itself", "list": path})
                else:
                    out.append({"kind": "filelist", "value": value, "list": path})
                    out += parse_filelist(read, value, env, (*_open, path))
            else:
                out.append({"kind": "library_file" if word == "-v" else "libdir", "value": value, "list": path})
        elif word.startswith("+incdir+"):
            out += [{"kind": "incdir", "value": place(v), "list": path} for v in word[8:].split("+") if v]
        elif word.startswith("+define+"):
            out += [{"kind": "define", "value": v, "list": path} for v in word[8:].split("+") if v]
        elif word[0] in "+-":
            out.append({"kind": "warning", "value": f"ignored option {word}", "list": path})
        else:
            out.append({"kind": "file", "value": place(word), "list": path})
    return out


def flattened(entries: list[dict]) -> list[str]:
    """Files in compile order, library files last, each at its first place."""
    own = [e["value"] for e in entries if e["kind"] == "file"]
    return list(dict.fromkeys(own + [e["value"] for e in entries if e["kind"] == "library_file"]))


def glob_sources(paths: Iterable[str], pattern: str) -> list[str]:
    """Paths that a pattern matches segment by segment, ``**`` standing for any number of folders."""

    def match(parts: list[str], wanted: list[str]) -> bool:
        if not wanted:
            return not parts
        if wanted[0] == "**":
            return match(parts, wanted[1:]) or bool(parts) and match(parts[1:], wanted)
        return bool(parts) and fnmatch.fnmatchcase(parts[0], wanted[0]) and match(parts[1:], wanted[1:])

    return sorted(p for p in paths if match(p.split("/"), pattern.split("/")))
