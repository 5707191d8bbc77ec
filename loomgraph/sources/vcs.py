"""Changed paths from the captured output of version control tools."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def git_changes(name_status: str, untracked: str = "") -> list[tuple[str, str]]:
    """(path, change) from ``git diff --name-status -z`` and ``git ls-files --others -z``; a rename is a removal and an addition."""
    out, parts = [], name_status.split("\0")
    i = 0
    while i + 1 < len(parts):
        code = parts[i][:1]
        if code in ("R", "C"):
            if code == "R":
                out.append((parts[i + 1], "removed"))
            out.append((parts[i + 2], "added"))
            i += 3
            continue
        if code:
            out.append((parts[i + 1], {"A": "added", "D": "removed"}.get(code, "changed")))
        i += 2
    return out + [(p, "added") for p in untracked.split("\0") if p]


def svn_changes(status: str) -> list[tuple[str, str]]:
    """(path, change) from ``svn status``; conflicts and property changes count as changes."""
    kinds = {"A": "added", "?": "added", "D": "removed", "!": "removed", "M": "changed", "R": "changed", "C": "changed", "~": "changed"}
    out = []
    for line in status.splitlines():
        m = re.match(r"^([ADMRC?!~ ])([MC ]).{0,6}\s+(\S.*)$", line)
        if m and not line.lstrip().startswith(">"):
            kind = kinds.get(m[1]) or ("changed" if m[2] in "MC" and m[2] != " " else None)
            if kind:
                out.append((m[3].replace("\\", "/"), kind))
    return out


def p4_changes(records: str, root: str) -> list[tuple[str, str]]:
    """(path, change) from ``p4 -ztag opened`` or ``status`` records, for local paths below a root; unknown actions are left out."""
    kinds = {"add": "added", "move/add": "added", "branch": "added", "delete": "removed", "move/delete": "removed", "edit": "changed", "integrate": "changed"}
    out, record = [], {}
    for line in [*records.splitlines(), ""]:
        m = re.match(r"^\.\.\. (\w+) (.*)$", line)
        if m:
            record[m[1]] = m[2]
        elif record:
            path = record.get("localFile") or record.get("path") or record.get("clientFile", "")
            path = path.replace("\\", "/")
            if path.startswith(root.rstrip("/") + "/") and record.get("action") in kinds:
                out.append((path[len(root.rstrip("/")) + 1 :], kinds[record["action"]]))
            record = {}
    return out


def scan_git(base: str, ref: str = "HEAD") -> list[tuple[str, str]]:
    run = lambda *a: subprocess.run(["git", "-C", base, *a], capture_output=True, text=True, check=True).stdout
    return git_changes(run("diff", "--name-status", "-z", ref), run("ls-files", "--others", "--exclude-standard", "-z"))


def change_frame(spark: SparkSession, changes: Iterable[tuple[str, str]], suffixes: tuple[str, ...] = ()) -> DataFrame:
    rows = [(p, c) for p, c in dict.fromkeys(changes) if not suffixes or p.endswith(suffixes)]
    return spark.createDataFrame(rows, "path string, change string")
