"""Run configuration as plain data: layered mappings, later layers win."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

WHOLE = ("stages", "lrs")


def merged(*layers: Mapping[str, Any]) -> dict[str, Any]:
    """Mappings merge key by key; lists, and the keys in WHOLE, are replaced."""
    out: dict[str, Any] = {}
    for layer in layers:
        for k, v in layer.items():
            if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) and k not in WHOLE:
                out[k] = merged(out[k], v)
            else:
                out[k] = merged(v) if isinstance(v, Mapping) else v
    return out
