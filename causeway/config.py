"""Configuration from a JSON file, with secrets from a file of their own or the environment."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Mapping
from pathlib import Path
from typing import Any

#: Names that a file of secrets may set; anything else in it is left alone.
SECRET_NAMES = ("FRED_API_KEY", "SERIES_API_KEY")


def secrets(lines: Iterable[str], environment: Mapping[str, str], allowed: tuple[str, ...] = SECRET_NAMES) -> dict[str, str]:
    """NAME=value lines of allowed names; the environment wins."""
    found = {}
    for line in lines:
        name, equals, value = line.strip().partition("=")
        if equals and not name.startswith("#") and name.strip() in allowed:
            found[name.strip()] = value.strip().strip("\"'")
    return found | {n: environment[n] for n in allowed if environment.get(n)}


def load(path: str, secret_file: str | None = None) -> dict[str, Any]:
    """The configuration with its secrets under `secrets`; a file of secrets that isn't there is none."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    lines = Path(secret_file).read_text(encoding="utf-8").splitlines() if secret_file and os.path.exists(secret_file) else []
    return config | {"secrets": secrets(lines, os.environ)}
