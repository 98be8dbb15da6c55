"""Pure functions that read and edit JSON texts, and their Arrow column forms."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F

from tokenscope.functions.text import SECRETS, SECRET_MARK

_patterns = [re.compile(p, re.A) for _, p in SECRETS]


def dump(value: object) -> str:
    """Compact JSON with sorted keys and with <, > and & escaped."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return text.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")


def compact(text: str | None) -> str | None:
    """A JSON text written anew by dump; None for what is no JSON."""
    try:
        return dump(json.loads(text))
    except (TypeError, ValueError):
        return None


def redact_leftmost(text: str) -> tuple[str, int]:
    out, at, n = [], 0, 0
    while True:
        found = [m for m in (p.search(text, at) for p in _patterns) if m]
        if not found:
            return "".join(out) + text[at:], n
        m = min(found, key=lambda m: m.start())
        out += [text[at : m.start()], SECRET_MARK]
        at, n = m.end(), n + 1


def redact_json(text: str | None) -> str | None:
    """String leaves, not keys, with secrets replaced; what is not JSON passes unchanged."""

    def walk(v: object) -> object:
        if isinstance(v, str):
            return redact_leftmost(v)[0]
        if isinstance(v, list):
            return [walk(x) for x in v]
        if isinstance(v, dict):
            return {k: walk(x) for k, x in v.items()}
        return v

    try:
        return dump(walk(json.loads(text)))
    except (TypeError, ValueError):
        return text


def embed_input(tool: str | None, params: str | None) -> str:
    """``tool:`` and `` key=json`` for the sorted keys; what is no object is added as it is."""
    try:
        found = json.loads(params or "")
    except ValueError:
        found = None
    if not isinstance(found, dict):
        return f"{tool or ''}: {params or ''}" if params else f"{tool or ''}:"
    return f"{tool or ''}:" + "".join(f" {k}={dump(found[k])}" for k in sorted(found))


def inject_breakpoint(text: str | None, strategy: str = "aggressive") -> str | None:
    """cache_control on the last element of system and of tools; balanced marks only the larger block (system if equal). A request with a mark stays."""
    try:
        body = json.loads(text)
    except (TypeError, ValueError):
        return text
    if not isinstance(body, dict):
        return text
    blocks = [k for k in ("system", "tools") if isinstance(body.get(k), list) and body[k] and isinstance(body[k][-1], dict)]
    if not blocks or any(isinstance(x, dict) and "cache_control" in x for k in ("system", "tools") if isinstance(body.get(k), list) for x in body[k]):
        return text
    if strategy == "balanced":
        blocks = [max(blocks, key=lambda k: (len(dump(body[k])), k == "system"))]
    for k in blocks:
        body[k][-1] = body[k][-1] | {"cache_control": {"type": "ephemeral"}}
    return dump(body)


def tool_line(server: str, tool: str, description: str, schema: str | None, most: int = 200) -> str:
    """``server_tool: description [required: type] {optional: type}`` with parameters by name."""
    short = description if len(description.encode()) <= most else description.encode()[: most - 3].decode("utf-8", "ignore") + "..."
    try:
        found = json.loads(schema or "")
        properties, required = found.get("properties") or {}, set(found.get("required") or [])
    except (ValueError, AttributeError):
        properties, required = {}, set()
    named = [(p in required, f"{p}: {(properties[p] or {}).get('type', 'any')}") for p in sorted(properties)]
    parts = [f"{server}_{tool}: {short}"]
    if need := [x for r, x in named if r]:
        parts.append(f"[{', '.join(need)}]")
    if free := [x for r, x in named if not r]:
        parts.append(f"{{{', '.join(free)}}}")
    return " ".join(parts)


def column_of(fn: Callable, *columns):
    """fn over columns, in Arrow batches."""

    @F.arrow_udf("string")
    def run(*arrays: pa.Array) -> pa.Array:
        return pa.array([fn(*row) for row in zip(*(a.to_pylist() for a in arrays))], type=pa.string())

    return run(*columns)
