"""Settings of the engine: defaults merged with an override."""

from __future__ import annotations

import copy
import json
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

# Defaults of the settings.
DEFAULTS: dict[str, Any] = {
    "sources": [],
    "scan": {"auto_index": True, "stale_check_seconds": 300, "max_file_bytes": 8_000_000, "min_body_chars": 30},
    "chunk": {"size": 350, "overlap": 80},
    "embed": {"enabled": True, "dim": 512, "max_tokens": 512, "batch": 32, "query_prefix": "", "doc_prefix": ""},
    "search": {
        "rrf_k": 60, "default_top_k": 8, "max_top_k": 50, "max_per_doc": 2, "fts_candidates": 200,
        "vector_candidates": 200, "snippet_chars": 240, "max_terms": 16,
    },
}
SOURCE_DEFAULTS: dict[str, Any] = {"include": ["**/*.md"], "exclude": ["**/.git/**"], "read_only": True, "clean": True}


def merged(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``; dictionaries are merged key by key, others replaced."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        both = isinstance(value, dict) and isinstance(out.get(key), dict)
        out[key] = merged(out[key], value) if both else value
    return out


@dataclass
class Settings:
    """Settings by section."""

    values: dict[str, Any] = field(default_factory=lambda: merged(DEFAULTS, {}))

    @classmethod
    def load(cls, path: str | None = None) -> Settings:
        """Defaults and, where the file exists, its values; sources get the defaults of a source."""
        over = json.loads(Path(path).read_text("utf-8")) if path and Path(path).exists() else {}
        values = merged(DEFAULTS, over)
        values["sources"] = [merged(SOURCE_DEFAULTS, s) for s in values["sources"]]
        return cls(values)

    def save(self, path: str) -> None:
        """Write all keys but those that begin with an underscore."""
        kept = {k: v for k, v in self.values.items() if not k.startswith("_")}
        Path(path).write_text(json.dumps(kept, ensure_ascii=False, indent=2), "utf-8")

    def __getitem__(self, section: str) -> Any:
        return self.values[section]


# Words that mean yes and no.
YES, NO = ("true", "1", "yes", "on", "y"), ("false", "0", "no", "off", "n", "")


def as_bool(value: Any, default: bool = False) -> bool:
    """A boolean from a boolean, a number (all but 0 are true) or the usual words; what is none of these gives the default."""
    if isinstance(value, (bool, int, float)):
        return value != 0
    word = value.strip().lower() if isinstance(value, str) else None
    return True if word in YES else False if word in NO else default


def as_int(value: Any, default: int, low: int, high: int) -> int:
    """An integer within [low, high]; null and what is no number give the default."""
    try:
        number = int(value) if value is not None and not isinstance(value, bool) else default
    except (TypeError, ValueError, OverflowError):
        number = default
    return max(low, min(high, number))


def as_mode(value: Any) -> tuple[str, str | None]:
    """(search mode, note): unknown modes are hybrid with a note."""
    mode = str(value or "hybrid").strip().lower()
    return (mode, None) if mode in ("hybrid", "fts", "vector") else ("hybrid", f"unknown mode {value!r}; hybrid is used")
