"""Layered configuration: roles, a hardware profile over them, a footage profile over both. Driver side only."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field, fields
from pathlib import Path

#: Roles that a footage profile may switch off; the others are the core.
GATEABLE = frozenset({"captions", "actions", "transcript", "diarization", "ocr", "verifier"})


@dataclass
class FootageSettings:
    """What holds for a kind of footage as a whole."""

    min_rerank: float | None = None
    min_cosine: float | None = None
    retention_days: float | None = None

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if value is not None and (isinstance(value, bool) or not isinstance(value, (int, float))):
                raise ValueError(f"{f.name} must be a number, not {value!r}")
        if self.retention_days is not None and self.retention_days <= 0:
            raise ValueError("retention_days must be positive")


@dataclass
class Config:
    roles: dict[str, dict] = field(default_factory=dict)
    footage: FootageSettings = field(default_factory=FootageSettings)

    def disabled(self) -> list[str]:
        return sorted(r for r, spec in self.roles.items() if spec.get("enabled") is False)


def merged(base: dict, over: dict) -> dict:
    """over laid upon base, mapping by mapping; a null leaves what is there."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else out.get(key) if value is None else value
    return out


def read_document(stem: Path) -> dict | None:
    """``stem.json``, or ``stem.yaml`` where a parser for it is installed; nothing where neither is there."""
    if (path := stem.with_suffix(".json")).exists():
        found = json.loads(path.read_text())
    elif (path := stem.with_suffix(".yaml")).exists():
        import yaml

        found = yaml.safe_load(path.read_text())
    else:
        return None
    if not isinstance(found or {}, dict):
        raise ValueError(f"{path} holds no mapping")
    return found or {}


def checked_roles(where: str, roles: object, gateable: Iterable[str] = ()) -> dict[str, dict]:
    """Role overrides, each a mapping, whose ``enabled`` is a boolean and switches off only what may be."""
    if not isinstance(roles, dict):
        raise ValueError(f"{where}: roles must be a mapping")
    for role, spec in roles.items():
        if spec is not None and not isinstance(spec, dict):
            raise ValueError(f"{where}: {role} must be a mapping")
        enabled = (spec or {}).get("enabled", True)
        if not isinstance(enabled, bool):
            raise ValueError(f"{where}: enabled of {role} must be a boolean, not {enabled!r}")
        if not enabled and role not in gateable:
            raise ValueError(f"{where}: {role} is a core role and stays on")
    return {r: spec or {} for r, spec in roles.items()}


def load_config(folder: str, footage: str = "generic", hardware: str | None = None) -> Config:
    """SC23: ``roles``, then ``profiles/<hardware>``, then ``profiles/footage/<footage>``. Only the generic footage profile may be absent."""
    root = Path(folder)
    roles = checked_roles("roles", (read_document(root / "roles") or {}).get("roles", {}), GATEABLE)
    if hardware is not None:
        found = read_document(root / "profiles" / hardware)
        if found is None:
            raise FileNotFoundError(f"no hardware profile {hardware!r}")
        roles = merged(roles, checked_roles(hardware, found.get("roles") or {}, GATEABLE))
    found = read_document(root / "profiles" / "footage" / footage)
    if found is None:
        if footage != "generic":
            raise FileNotFoundError(f"no footage profile {footage!r}")
        return Config(roles)
    roles = merged(roles, checked_roles(footage, found.get("roles") or {}, GATEABLE))
    known = {f.name for f in fields(FootageSettings)}
    unknown = sorted(set(found) - known - {"roles"})
    if unknown:
        raise ValueError(f"{footage}: unknown settings {', '.join(unknown)}")
    return Config(roles, FootageSettings(**{k: v for k, v in found.items() if k in known}))
