"""Configuration: paths anchored at the folder of the file that names them, frozen gates."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path


@dataclass(frozen=True)
class Config:
    """Parameters by name; paths are absolute."""

    root: Path
    values: dict = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """Read a JSON file; a value that is no object is an error."""
        where = Path(path).resolve()
        values = json.loads(where.read_text(encoding="utf-8-sig"))
        if not isinstance(values, dict):
            raise ValueError(f"{where} holds no object")
        return cls(where.parent, values)

    def path(self, name: str) -> str:
        """A configured path; relative ones start at the file's folder."""
        value = Path(self.values[name])
        return str(value if value.is_absolute() else (self.root / value).resolve())

    def frozen(self, name: str) -> dict:
        """A group of parameters that must all be set and marked as frozen."""
        group = self.values.get(name)
        if not isinstance(group, dict) or group.get("status") != "frozen":
            raise ValueError(f"{name} is not frozen")
        missing = sorted(k for k, v in group.items() if v is None)
        if missing:
            raise ValueError(f"{name} lacks {', '.join(missing)}")
        return group
