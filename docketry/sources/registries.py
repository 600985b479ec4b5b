"""Registries and configurations on the driver: sources, policies, experiments; wrong versions and values are refused."""

from __future__ import annotations

import json
import re
import shutil
from dataclasses import dataclass, fields
from pathlib import Path

SCHEMA = "1.0.0"
STATUSES = ("candidate", "approved", "excluded")


class ConfigurationError(ValueError):
    pass


@dataclass(frozen=True)
class Source:
    source_id: str
    sha256: str
    status: str
    uses: tuple[str, ...] = ()
    redistributable: bool = False

    def problems(self) -> list[str]:
        out = []
        if not re.fullmatch("[0-9a-f]{64}", self.sha256):
            out.append(f"{self.source_id}: the hash is not 64 hex digits")
        if self.status not in STATUSES:
            out.append(f"{self.source_id}: unknown status {self.status}")
        if self.status == "approved" and not self.uses:
            out.append(f"{self.source_id}: approved without uses")
        if self.status == "excluded" and self.redistributable:
            out.append(f"{self.source_id}: excluded but redistributable")
        return out


def validate_sources(sources: list[Source]) -> None:
    ids = [s.source_id for s in sources]
    problems = [f"{i}: given twice" for i in sorted({i for i in ids if ids.count(i) > 1})] + [p for s in sources for p in s.problems()]
    if problems:
        raise ConfigurationError("; ".join(problems))


def _payload(path: Path) -> dict:
    try:
        data = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, json.JSONDecodeError) as e:
        raise ConfigurationError(f"{path}: {e}") from e
    if not isinstance(data, dict) or data.get("schema_version") != SCHEMA:
        raise ConfigurationError(f"{path} is not of schema {SCHEMA}")
    return data


def load_sources(path: Path) -> list[Source]:
    known = {f.name for f in fields(Source)}
    sources = [Source(**{k: tuple(v) if isinstance(v, list) else v for k, v in row.items() if k in known}) for row in _payload(path).get("sources", [])]
    validate_sources(sources)
    return sources


def approved_source(path: Path, source_id: str, use: str) -> Source:
    for s in load_sources(path):
        if s.source_id == source_id:
            if s.status != "approved" or use not in s.uses:
                raise ConfigurationError(f"{source_id} is not approved for {use}")
            return s
    raise ConfigurationError(f"{source_id} is not registered")


def policy_differences(policy: dict[str, str], found: dict[str, str]) -> list[str]:
    """Acts whose hash is not the policy's, or that only one side has."""
    return sorted(k for k in policy.keys() | found.keys() if policy.get(k) != found.get(k))


@dataclass(frozen=True)
class BaselineConfig:
    experiment_id: str
    input_view: str
    input_character_limit: int
    vocabulary_size: int = 2000
    alpha: float = 1.0

    def __post_init__(self) -> None:
        if self.input_view not in ("prefix", "body"):
            raise ConfigurationError(f"unknown view {self.input_view}")
        if self.input_character_limit <= 0 or self.vocabulary_size <= 0 or self.alpha <= 0:
            raise ConfigurationError("limits and alpha must be positive")


def load_baseline(path: Path) -> BaselineConfig:
    data = _payload(path)
    try:
        return BaselineConfig(str(data["experiment_id"]), str(data["input_view"]), int(data["input_character_limit"]), int(data.get("vocabulary_size", 2000)), float(data.get("alpha", 1.0)))
    except (KeyError, TypeError, ValueError) as e:
        raise e if isinstance(e, ConfigurationError) else ConfigurationError(f"{path}: {e}") from e


def preflight(paths: list[Path], packages: list[str], free_bytes: int, at: Path, manifests: list[dict]) -> list[str]:
    """What keeps an experiment from starting: missing paths and packages, too little disk, manifests that are not validated."""
    from importlib.util import find_spec

    out = [f"missing path {p}" for p in paths if not Path(p).exists()]
    out += [f"missing package {p}" for p in packages if find_spec(p) is None]
    if shutil.disk_usage(at).free < free_bytes:
        out.append(f"less than {free_bytes} bytes free at {at}")
    return out + [f"manifest {m.get('artifact')} is {m.get('status', 'unknown')}" for m in manifests if m.get("status") != "validated"]
