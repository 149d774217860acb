"""Settings from files: environment files of KEY=VALUE lines, and the policy file."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from pathlib import Path

from ..operators.policy import Policy, parse

_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_]*").fullmatch


class SettingsError(ValueError):
    """A settings file that cannot be used; exit status 2."""


def _value(text: str, number: int) -> str:
    """Quoted to the last such quote, or up to a comment."""
    if text[:1] in ("'", '"'):
        body, quote, _ = text[1:].rpartition(text[0])
        if not quote:
            raise SettingsError(f"line {number} has an unterminated quote")
        return body
    return text.partition(" #")[0].strip()


def parse_env(text: str) -> dict[str, str]:
    """Blank lines and comments are passed over, ``export`` is allowed, the last of equal keys counts."""
    out: dict[str, str] = {}
    for number, raw in enumerate(text.splitlines(), 1):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        key, equals, value = line.removeprefix("export ").lstrip().partition("=")
        if not equals:
            raise SettingsError(f"line {number} is missing '='")
        if not _KEY(key.strip()):
            raise SettingsError(f"line {number} has an invalid key")
        out[key.strip()] = _value(value.strip(), number)
    return out


def read_env(path: str) -> dict[str, str]:
    """Of a file; none where it is missing."""
    try:
        return parse_env(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        return {}
    except OSError as e:
        raise SettingsError(f"cannot read env file {path}: {e}") from e


def setting(name: str, env_file: Mapping[str, str], environ: Mapping[str, str] = os.environ) -> str | None:
    """The process's environment goes before the file."""
    return environ.get(name, env_file.get(name))


def read_policy(path: str) -> Policy:
    """Of a file; the empty policy where it is missing."""
    try:
        return parse(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        return Policy()
