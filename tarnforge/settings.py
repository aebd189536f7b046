"""Settings with their bounds."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields
from pathlib import Path

#: Least and greatest value by setting (fixed values).
LIMITS = {
    "chunk_size": (100, 10_000),
    "chunk_overlap": (0, 1_000),
    "search_limit": (1, 50),
    "search_threshold": (0.0, 1.0),
    "least_chars": (0, 10_000),
    "most_bytes": (1, 1 << 30),
    "semantic_weight": (0.0, 1.0),
    "text_weight": (0.0, 1.0),
    "result_chars": (1, 100_000),
}


@dataclass(frozen=True)
class Settings:
    """Defaults of indexing and search (fixed values)."""

    chunk_size: int = 500
    chunk_overlap: int = 100
    search_limit: int = 20
    search_threshold: float = 0.3
    file_glob: str = "*.{js,ts,py,md,txt,json,yaml,yml,html,css,scss}"
    recursive: bool = True
    least_chars: int = 10
    most_bytes: int = 10 << 20
    semantic_weight: float = 0.7
    text_weight: float = 0.3
    dynamic_threshold: bool = False
    result_chars: int = 200
    dimension: int = 64

    @classmethod
    def of(cls, **values) -> Settings:
        """Known values, each brought within its bounds; unknown names fail."""
        known = {f.name for f in fields(cls)}
        if odd := set(values) - known:
            raise TypeError(f"no such setting: {', '.join(sorted(odd))}")
        s = cls(**{k: clamped(k, v) for k, v in values.items() if v is not None})
        if s.chunk_overlap >= s.chunk_size:
            raise ValueError("chunk_overlap must be less than chunk_size")
        return s

    @classmethod
    def read(cls, path: str | None = None, prefix: str = "TARNFORGE_") -> Settings:
        """From a JSON file's known members, then from the environment."""
        values = json.loads(Path(path).read_text()) if path and os.path.exists(path) else {}
        values = {f.name: values[f.name] for f in fields(cls) if f.name in values}
        for f in fields(cls):
            if (v := os.environ.get(prefix + f.name.upper())) is not None:
                values[f.name] = v.lower() in ("1", "true", "yes") if isinstance(f.default, bool) else type(f.default)(v)
        return cls.of(**values)

    def as_dict(self) -> dict:
        return asdict(self)


def valid(name: str, value: float) -> bool:
    low, high = LIMITS.get(name, (value, value))
    return low <= value <= high


def clamped(name: str, value):
    if name not in LIMITS:
        return value
    low, high = LIMITS[name]
    return min(max(value, low), high)
