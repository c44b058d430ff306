"""Settings: defaults, overrides and environment variables, on the driver."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from typing import Any

_VARIABLE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """over on top of base, mappings within mappings too."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def interpolated(value: Any) -> Any:
    """${NAME} and ${NAME:-default} from the environment, in all strings."""
    if isinstance(value, str):
        return _VARIABLE.sub(lambda m: os.environ.get(m[1], m[2] or ""), value)
    if isinstance(value, Mapping):
        return {k: interpolated(v) for k, v in value.items()}
    return [interpolated(v) for v in value] if isinstance(value, list) else value


def get(config: Mapping[str, Any], dotted: str, default: Any = None) -> Any:
    """A value by a dotted name."""
    for part in dotted.split("."):
        if not isinstance(config, Mapping) or part not in config:
            return default
        config = config[part]
    return config
