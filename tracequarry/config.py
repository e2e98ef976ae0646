"""Settings of the command line: defaults, then a JSON file, then given values."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    data: str = "/root/testdata/sf0.001"
    master: str = "local[*]"
    shuffle_partitions: int = 8
    checkpoint_dir: str = ""  # a folder that all executors share; needed on a cluster, where stored indexes lie there


def load(path: str | None = None, given: dict | None = None) -> Settings:
    """Names that aren't settings, values of None and files that aren't a JSON object change nothing."""
    told: dict = {}
    if path and Path(path).is_file():
        try:
            told = json.loads(Path(path).read_text())
        except (OSError, ValueError):
            told = {}
    own = {f.name for f in fields(Settings)}
    told = {k: v for k, v in told.items() if k in own} if isinstance(told, dict) else {}
    s = replace(Settings(), **told)
    return replace(s, **{k: v for k, v in (given or {}).items() if v is not None and k in own})
