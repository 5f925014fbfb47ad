"""Settings files: JSON or YAML that may extend others, with variables of the environment; read on the driver."""

from __future__ import annotations

import json
import logging
import os
import re
import sys
from pathlib import Path
from typing import Any, TextIO


class StepweaveError(Exception):
    """What this library raises of its own."""


class SettingsError(StepweaveError, ValueError):
    """A settings file that cannot be used."""


class BackendError(StepweaveError, RuntimeError):
    """A model that gives no usable answer."""


def logger() -> logging.Logger:
    return logging.getLogger("stepweave")


def configure_logging(level: int = logging.INFO, stream: TextIO | None = None) -> logging.Logger:
    """The library's logger with one handler for a stream (stderr unless given); called again for the same stream it only sets the level."""
    own, target = logger(), stream or sys.stderr
    own.setLevel(level)
    own.propagate = False
    handler = next((h for h in own.handlers if getattr(h, "stream", None) is target), None)
    if handler is None:
        handler = logging.StreamHandler(target)
        handler.setFormatter(logging.Formatter("%(asctime)s - %(name)s - %(levelname)s - %(message)s"))
        own.addHandler(handler)
    handler.setLevel(level)
    return own


def _read(path: Path) -> dict[str, Any]:
    kind = path.suffix.lower()
    if kind not in (".json", ".yaml", ".yml"):
        raise SettingsError(f"{path}: neither JSON nor YAML")
    try:
        text = path.read_text(encoding="utf-8-sig")
    except OSError as e:
        raise SettingsError(f"{path}: {e}") from e
    if kind == ".json":
        found = json.loads(text)
    else:
        import yaml

        found = yaml.safe_load(text)
    if not isinstance(found, dict | None):
        raise SettingsError(f"{path}: not a mapping")
    return found or {}


def expanded(value: Any) -> Any:
    """value with ${NAME} and ${NAME:-default} of all its texts replaced; unset without default is empty."""
    if isinstance(value, str):
        return re.sub(r"\$\{([^}:]+)(?::-([^}]*))?\}", lambda m: os.environ.get(m[1], m[2] or ""), value)
    if isinstance(value, list):
        return [expanded(x) for x in value]
    return {k: expanded(x) for k, x in value.items()} if isinstance(value, dict) else value


def merged(base: Any, over: Any) -> Any:
    """Mappings merged key by key at every depth; of anything else over holds."""
    if not (isinstance(base, dict) and isinstance(over, dict)):
        return over
    return base | {k: merged(base[k], x) if k in base else x for k, x in over.items()}


def _chain(path: Path, above: tuple[Path, ...]) -> dict[str, Any]:
    path = path.resolve()
    if path in above:
        raise SettingsError("settings extend each other: " + " -> ".join(map(str, (*above, path))))
    own = _read(path)
    parents = own.pop("extends", None) or []
    parents = [parents] if isinstance(parents, str) else parents
    if not isinstance(parents, list) or not all(isinstance(p, str) for p in parents):
        raise SettingsError(f"{path}: extends must be a text or a list of texts")
    out: dict[str, Any] = {}
    for parent in parents:
        out = merged(out, _chain(path.parent / expanded(parent), (*above, path)))
    return merged(out, own)


def load(path: str | Path) -> dict[str, Any]:
    """A settings file over those that it extends, later ones over earlier, with variables replaced."""
    return expanded(_chain(Path(path), ()))
