"""Where a project is: given, from an editor's environment, or the working folder."""

from __future__ import annotations

import os
from collections import Counter
from dataclasses import dataclass
from pathlib import Path

from tarnforge.functions.detect import LANGUAGES

_VARIABLES = ("WORKSPACE_FOLDER", "PROJECT_ROOT", "INIT_CWD")
_HIDDEN = {"node_modules", "dist", "build", "__pycache__"}


@dataclass(frozen=True)
class Workspace:
    path: str
    found_by: str
    language: str | None
    extensions: dict[str, int]
    files: int
    complete: bool  # False if the walk ended at its bound, so that counts and language are of a part


def normalised(path: str) -> str:
    """An absolute path without links; fails unless it is a readable folder."""
    p = Path(path).expanduser().resolve()
    if not p.is_dir() or not os.access(p, os.R_OK):
        raise NotADirectoryError(str(p))
    return str(p)


def _described(path: str, found_by: str, most: int) -> Workspace:
    count: Counter[str] = Counter()
    n = 0
    for top, folders, names in os.walk(path):
        folders[:] = [d for d in folders if not d.startswith(".") and d not in _HIDDEN]
        for name in names:
            n += 1
            if ext := Path(name).suffix.lower().lstrip("."):
                count[ext] += 1
        if n >= most:
            break
    language = {e: k for k, v in LANGUAGES.items() for e in v.split()}
    by_language: Counter[str] = Counter()
    for e, k in count.items():
        if e in language:
            by_language[language[e]] += k
    return Workspace(path, found_by, max(by_language, key=lambda k: (by_language[k], k), default=None), dict(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:10]), n, n < most)


def detect(path: str | None = None, most_files: int = 100_000) -> Workspace:
    """The given folder, else the nearest one above the working folder with an editor's or a repository's mark, else a variable's, else the working folder."""
    if path:
        return _described(normalised(path), "given", most_files)
    here = Path.cwd()
    for p in (here, *here.parents):
        if (p / ".vscode").is_dir() or (p / ".git").exists():
            return _described(str(p), "mark", most_files)
    for name in _VARIABLES:
        if (v := os.environ.get(name)) and os.path.isdir(v):
            return _described(normalised(v), name, most_files)
    return _described(str(here), "working folder", most_files)
