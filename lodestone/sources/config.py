"""Settings from a TOML file."""

from __future__ import annotations

import tomllib
from typing import Any


def normal_key(key: str) -> str:
    return key.lower().replace("-", "_")


class Settings:
    """Flat settings whose keys ignore case and take hyphens for underscores.

    Of keys that then are the same the first in order counts. ``hide-tags`` is an old name for the opposite of ``show-tags``.
    """

    def __init__(self, text: str = ""):
        self.values: dict[str, Any] = {}
        for key, value in sorted(tomllib.loads(text).items()):
            self.values.setdefault(normal_key(key), value)
        old = self.values.pop("hide_tags", None)
        if isinstance(old, bool):
            self.values.setdefault("show_tags", not old)

    @classmethod
    def of_file(cls, path: str) -> Settings:
        """The settings of a file; none if it does not exist."""
        try:
            with open(path, encoding="utf-8") as f:
                return cls(f.read())
        except FileNotFoundError:
            return cls()

    def get(self, key: str, default: Any = None) -> Any:
        return self.values.get(normal_key(key), default)
