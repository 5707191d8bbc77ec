"""Build configuration and waivers from TOML files, and paths relative to a root; all on the driver."""

from __future__ import annotations

import posixpath
import tomllib
from pathlib import Path

#: Keys of the build table and their defaults.
DEFAULTS = {"sources": [], "exclude": [], "filelists": [], "include_dirs": [], "defines": {}, "max_file_size_kb": 2048, "libraries": {}, "top": []}
NAMES = ("loomgraph.toml", ".loomgraph.toml")
WAIVER_KEYS = ("check", "module", "name", "file", "line", "reason")


def find(start: str, names: tuple[str, ...] = NAMES) -> str | None:
    """The nearest configuration file at a folder or above it."""
    folder = Path(start).resolve()
    for at in (folder, *folder.parents):
        for name in names:
            if (at / name).is_file():
                return str(at / name)
    return None


def load(text: str) -> tuple[dict, list[str]]:
    """The build table with defaults, and a warning for each unknown key; values of another type are errors."""
    raw = tomllib.loads(text).get("build", {})
    out, warnings = {k: v.copy() if isinstance(v, (list, dict)) else v for k, v in DEFAULTS.items()}, []
    for key, value in raw.items():
        if key not in DEFAULTS:
            warnings.append(f"unknown key {key!r}")
        elif not isinstance(value, type(DEFAULTS[key])):
            raise ValueError(f"{key} must be a {type(DEFAULTS[key]).__name__}")
        else:
            out[key] = value
    return out, warnings


def waivers(text: str, checks: tuple[str, ...]) -> list[dict]:
    """The waivers of a file in order; one without a known check, with unknown keys or with nothing to match is an error."""
    out = []
    for i, w in enumerate(tomllib.loads(text).get("waiver", [])):
        unknown = sorted(set(w) - set(WAIVER_KEYS))
        if unknown:
            raise ValueError(f"waiver {i}: unknown keys {', '.join(unknown)}")
        if "check" in w and w["check"] not in checks:
            raise ValueError(f"waiver {i}: unknown check {w['check']!r}")
        if not set(w) - {"reason"}:
            raise ValueError(f"waiver {i} matches everything")
        out.append({k: v for k, v in w.items() if k != "reason"})
    return out


def relative(path: str, root: str) -> str:
    """A path below ``root`` relative to it, any other as it is; both in normal form."""
    plain, base = posixpath.normpath(path.replace("\\", "/")), posixpath.normpath(root.replace("\\", "/"))
    return plain[len(base) :].lstrip("/") if plain.startswith(base.rstrip("/") + "/") else plain


def confined(path: str, root: str) -> bool:
    """Whether a path, taken from ``root`` if it is relative, stays below it."""
    full = posixpath.normpath(path if path.startswith("/") else posixpath.join(root, path))
    base = posixpath.normpath(root)
    return full == base or full.startswith(base.rstrip("/") + "/")
