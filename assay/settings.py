"""Settings of a run: from a YAML file, then from the environment; what neither says has a default.

The environment's names are ASSAY_ and the field in capitals, as ASSAY_LOG_LEVEL; Spark's own settings stand in the file
under ``spark``.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

from assay.plans.model import PlanError
from assay.sources.columns import NULL_TOKENS

PREFIX = "ASSAY_"


@dataclass(frozen=True)
class Settings:
    #: Where controls are looked for by their id: folder/<id>/control.yaml.
    controls: str = "controls"
    out: str = "work"
    master: str = ""
    log_level: str = "INFO"
    log_json: bool = False
    #: module:function that answers requests for plans; none: plans must be there.
    provider: str = ""
    retries: int = 3
    collision_naming: str = "per_name"
    null_tokens: tuple[str, ...] = NULL_TOKENS
    spark: dict = field(default_factory=dict)


def _read(kind: str, value, name: str):
    """A value as the field's type says, whether it comes as such or as text."""
    try:
        if kind == "bool":
            return value if isinstance(value, bool) else {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}[str(value).lower()]
        if kind == "int":
            return int(value)
        if kind.startswith("tuple"):
            return tuple(str(v) for v in (value.split(",") if isinstance(value, str) else value))
        if kind == "dict":
            return {str(k): str(v) for k, v in value.items()}
        return str(value)
    except (KeyError, ValueError, TypeError, AttributeError) as e:
        raise PlanError(f"setting {name}: {value!r} is no {kind}") from e


def load_settings(path: str | Path | None = None, env: Mapping[str, str] | None = None) -> Settings:
    """A missing file that was named, unknown settings and values of the wrong type are errors."""
    env = os.environ if env is None else env
    path = path or env.get(PREFIX + "SETTINGS")
    raw: dict = {}
    if path:
        from assay.sources.store import load

        raw = load(path) or {}
    kinds = {f.name: str(f.type) for f in fields(Settings)}
    if unknown := sorted(set(raw) - set(kinds)):
        raise PlanError(f"unknown settings: {', '.join(unknown)}")
    for name, kind in kinds.items():
        if kind != "dict" and PREFIX + name.upper() in env:
            raw[name] = env[PREFIX + name.upper()]
    return Settings(**{name: _read(kinds[name], value, name) for name, value in raw.items()})
