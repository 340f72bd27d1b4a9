"""Engine settings, read from a flat JSON file with documented fallbacks."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class EngineConfig:
    """All tunables. The defaults apply when no file can be read."""

    wal_size: int = 5000
    memtable_size: int = 1000
    memtable_structure: str = "skiplist"
    memtable_number: int = 10
    cache_capacity: int = 100
    level_count: int = 5
    level_num: int = 10
    t: int = 10
    token_bucket_maxsize: int = 15
    token_bucket_interval: str = "1m"
    degree_of_dilution_summary: int = 5
    degree_of_dilution_index: int = 4
    page_size: int = 10
    compression: bool = False
    sized_compaction: bool = True
    one_file: bool = False

    @property
    def refill_seconds(self) -> float:
        return parse_duration(self.token_bucket_interval)

    def level_limit(self, level: int) -> int:
        """Tables that a level holds before leveled compaction pushes one down."""
        return self.level_num * self.t ** (level - 1)


def load_config(path: str | Path) -> EngineConfig:
    """Settings of a JSON file; unknown fields are ignored, an unreadable file gives the defaults."""
    try:
        raw = json.loads(Path(path).read_text())
    except (OSError, ValueError):
        return EngineConfig()
    known = {f.name for f in fields(EngineConfig)}
    return EngineConfig(**{k: v for k, v in raw.items() if k in known})


UNIT_SECONDS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def parse_duration(text: str) -> float:
    """Seconds of a duration such as ``1m``, ``1h30m`` or ``250ms``; days are not a unit."""
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|s|m|h)", text)
    if not parts or "".join(n + u for n, u in parts) != text.lstrip("+-"):
        raise ValueError(f"not a duration: {text!r}")
    total = sum(float(n) * UNIT_SECONDS[u] for n, u in parts)
    return -total if text.startswith("-") else total
