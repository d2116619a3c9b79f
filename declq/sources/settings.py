"""Settings: a nested mapping from YAML-like text, with ${name} taken from variables, then the environment, then empty."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from typing import Any


def substitute(value: str, variables: Mapping[str, str]) -> str:
    """${USERDIR} is the home folder; an unknown name is empty; an unterminated ${ stays as it is."""

    def one(m: re.Match[str]) -> str:
        if m[1] == "USERDIR":
            return os.path.expanduser("~")
        return str(variables.get(m[1], os.environ.get(m[1], "")))

    return re.sub(r"\$\{([^}]*)\}", one, value)


def _scalar(text: str) -> Any:
    text = text.strip()
    if text[:1] in "'\"" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    return int(text) if re.fullmatch(r"-?\d+", text) else text


def parse(text: str) -> dict[str, Any]:
    """Nested maps by indentation and lists by dashes: the part of YAML that settings use."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]

    def block(at: int, indent: int) -> tuple[Any, int]:
        if at < len(lines) and lines[at][1].startswith("- "):
            items = []
            while at < len(lines) and lines[at][0] == indent and lines[at][1].startswith("- "):
                items.append(_scalar(lines[at][1][2:]))
                at += 1
            return items, at
        out: dict[str, Any] = {}
        while at < len(lines) and lines[at][0] == indent:
            key, _, rest = lines[at][1].partition(":")
            at += 1
            if rest.strip():
                out[key] = _scalar(rest)
            elif at < len(lines) and (lines[at][0] > indent or lines[at][1].startswith("- ")):
                out[key], at = block(at, lines[at][0])
            else:
                out[key] = None
        return out, at

    return block(0, lines[0][0])[0] if lines else {}


def load(text: str) -> dict[str, Any]:
    raw = parse(text)
    variables = {k: str(v) for k, v in (raw.get("variables") or {}).items()}

    def fill(v: Any) -> Any:
        if isinstance(v, str):
            return substitute(v, variables)
        if isinstance(v, dict):
            return {k: fill(x) for k, x in v.items()}
        return [fill(x) for x in v] if isinstance(v, list) else v

    return fill(raw)
