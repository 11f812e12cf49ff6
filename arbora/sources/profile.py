"""Profiles of derived queries: limits and transforms, read from YAML and checked."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from pathlib import Path

#: Transforms that a profile may name, limits that it must set.
TRANSFORMS = ("split-case", "token-adjacent-pairs", "normalize-case", "plural-singular", "strip-affix")
LIMITS = ("max_arrival_nodes", "min_term_length", "max_file_bytes")


class ProfileError(ValueError):
    """A profile that can't be used."""


@dataclass(frozen=True)
class Transform:
    id: str
    prefixes: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()


@dataclass(frozen=True)
class Profile:
    id: str = "default"
    version: int = 2
    sha256: str = ""
    max_arrival_nodes: int = 50
    min_term_length: int = 3
    max_file_bytes: int = 1_048_576
    include_agent_docs: bool = True
    tracked_files_only: bool = True
    transforms: tuple[Transform, ...] = field(default=(
        Transform("split-case"), Transform("token-adjacent-pairs"), Transform("normalize-case"), Transform("plural-singular"),
        Transform("strip-affix", ("get", "set", "is", "has", "on", "handle", "build", "create"),
                  ("Impl", "Service", "Controller", "Handler", "Manager", "Factory", "ViewModel", "Repository"))))


def _words(entry: dict, name: str) -> tuple[str, ...]:
    """The affixes of an entry; other values than words count by their text."""
    return tuple(map(str, entry.get(name) or ()))


def parse_profile(data: bytes) -> Profile:
    """A profile from the bytes of its file; raises ProfileError."""
    import yaml

    try:
        raw = yaml.safe_load(data.decode("utf-8"))
    except (UnicodeDecodeError, yaml.YAMLError) as e:
        raise ProfileError(f"no YAML: {e}") from e
    if not isinstance(raw, dict):
        raise ProfileError("a profile is a mapping")
    if missing := [k for k in ("id", "version", "limits", "transforms") if k not in raw]:
        raise ProfileError(f"lacks {', '.join(missing)}")
    if type(raw["version"]) is not int:
        raise ProfileError("version must be a whole number")
    limits = raw["limits"]
    if not isinstance(limits, dict):
        raise ProfileError("limits is a mapping")
    for k in LIMITS:
        if type(limits.get(k)) is not int or limits[k] < 1:
            raise ProfileError(f"limits.{k} must be a whole number of 1 or more")
    made: dict[str, Transform] = {}
    for entry in raw["transforms"] if isinstance(raw["transforms"], list) and raw["transforms"] else [None]:
        name = entry.get("id") if isinstance(entry, dict) else None
        if name not in TRANSFORMS or name in made:
            raise ProfileError(f"no, unknown or repeated transform: {name}")
        if name != "strip-affix" and {"prefixes", "suffixes"} & set(entry):
            raise ProfileError(f"{name} takes no affixes")
        made[name] = Transform(name, _words(entry, "prefixes"), _words(entry, "suffixes"))
    if "strip-affix" in made and made["strip-affix"] == Transform("strip-affix"):
        raise ProfileError("strip-affix needs affixes")
    return Profile(str(raw["id"]), raw["version"], hashlib.sha256(data).hexdigest(), *(limits[k] for k in LIMITS), bool(raw.get("include_agent_docs", True)), bool(raw.get("tracked_files_only", True)), tuple(made.values()))


def load_profile(path: str) -> Profile:
    return parse_profile(Path(path).read_bytes())
