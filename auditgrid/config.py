"""Settings of a project: untrusted JSON, coerced."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

FORMATS = ("terminal", "json", "markdown")
#: Directories that command-line scans leave out on top of any configuration: fixed values.
BASELINE_IGNORE = ("reports", "tests", "fixtures", "__tests__", "__fixtures__", ".claude")
CONFIG_NAME = ".audit.json"


@dataclass(frozen=True)
class Config:
    ignore: tuple[str, ...] = ()
    rules: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    format: str = "terminal"
    strict: bool = False
    custom_escapers: tuple[str, ...] = ()
    custom_auth_guards: tuple[str, ...] = ()
    allowed_install_scripts: tuple[str, ...] = ()
    disable_for_paths: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _strings(value: Any) -> tuple[str, ...]:
    return tuple(x for x in value if isinstance(x, str)) if isinstance(value, list) else ()


def normalise(raw: Any) -> Config:
    """A configuration from parsed JSON; entries of wrong types don't count."""
    raw = raw if isinstance(raw, dict) else {}
    paths = raw.get("disableForPaths")
    paths = {k: s for k, v in paths.items() if (s := _strings(v))} if isinstance(paths, dict) else {}
    return Config(
        ignore=_strings(raw.get("ignore")), rules=_strings(raw.get("rules")), exclude=_strings(raw.get("exclude")), format=raw.get("format") if raw.get("format") in FORMATS else "terminal",
        strict=raw.get("strict") is True, custom_escapers=_strings(raw.get("customEscapers")), custom_auth_guards=_strings(raw.get("customAuthGuards")), disable_for_paths=paths,
    )


def parse(text: str | None) -> Config:
    """A configuration from a file's text; anything that isn't JSON gives the defaults."""
    try:
        return normalise(json.loads(text or ""))
    except ValueError:
        return Config()


def merge(given: Config, command_line: Config) -> Config:
    """The command line's rules, exclusions and format win where they are set; ignore lists add up."""
    return Config(
        ignore=given.ignore + command_line.ignore, rules=command_line.rules or given.rules, exclude=command_line.exclude or given.exclude,
        format=command_line.format if command_line.format != "terminal" else given.format, strict=command_line.strict or given.strict, custom_escapers=given.custom_escapers,
        custom_auth_guards=given.custom_auth_guards, allowed_install_scripts=given.allowed_install_scripts, disable_for_paths=given.disable_for_paths,
    )
