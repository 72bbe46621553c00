"""JSON-RPC 2.0 over lines: the engine's read-only questions as tools."""

from __future__ import annotations

import json

from catalens.model import ConfigError

PROTOCOL = "2024-11-05"
PARSE, INVALID, UNKNOWN = -32700, -32600, -32601


def _text(args: dict, key: str) -> str:
    value = args.get(key)
    if not isinstance(value, str) or not value.strip():
        raise ConfigError(f"`{key}` must be a text that is not blank")
    return value


def _number(args: dict, key: str, default: int, low: int, high: int) -> int:
    value = args.get(key, default)
    return min(high, max(low, value)) if isinstance(value, int) and not isinstance(value, bool) else default


def _analyze(engine, args: dict) -> dict:
    found = engine.analyze(args.get("scope", "all"))
    most = _number(args, "maxFindings", 50, 1, 200)
    return found | {"findings": found["findings"][:most], "omitted": max(0, len(found["findings"]) - most)}


def _cut(found: dict, keys: tuple[str, ...], args: dict) -> dict:
    most = _number(args, "maxObjects", 50, 1, 500)
    omitted = {k: max(0, len(found[k]) - most) for k in keys}
    out = found | {k: found[k][:most] for k in keys} | {"omitted": omitted, "truncated": any(omitted.values())}
    return out | ({"followUp": "ask for fewer objects, or raise maxObjects"} if out["truncated"] else {})


#: name: (what it does, required arguments, call)
TOOLS = {
    "status": ("What the project has.", (), lambda e, a: e.status()),
    "search": ("Objects by text and filters.", ("query",), lambda e, a: {"results": e.search(_text(a, "query"), a.get("kind"), _number(a, "limit", 20, 1, 50))}),
    "table": ("A table with all that belongs to it.", ("table",), lambda e, a: e.table(_text(a, "table"), _number(a, "maxColumns", _number(a, "maxObjects", 50, 1, 500), 1, 500))),
    "context": ("Ranked context under a token budget.", ("query",), lambda e, a: e.context(_text(a, "query"), _number(a, "tokenBudget", 800, 100, 8000), 24 if a.get("mode") == "full" else 12)),
    "relations": ("Paths from an object.", ("object",), lambda e, a: e.relations(_text(a, "object"), _number(a, "depth", 1, 1, 2), a.get("direction", "both"), 8 if a.get("mode") == "compact" else None)),
    "impact": ("What a change touches.", ("object",), lambda e, a: _cut(e.impact(_text(a, "object"), _number(a, "depth", 2, 1, 2)), ("items",), a)),
    "analyze": ("Findings of the rules.", (), _analyze),
    "diff": ("What changed between the last two snapshots.", (), lambda e, a: _cut(e.diff(), ("changes", "renameCandidates"), a)),
    "validate_sql": ("Whether a statement parses and what it refers to; it is never executed.", ("sql",), lambda e, a: _cut(e.validate_sql(_text(a, "sql"), a.get("dialect", "postgres")), ("references", "unresolved"), a)),
}


def _tool(name: str) -> dict:
    what, required, _ = TOOLS[name]
    return {"name": name, "description": what, "inputSchema": {"type": "object", "properties": {k: {"type": "string"} for k in required}, "required": list(required)}}


def call(engine, name: str, args: dict) -> dict:
    """A tool's answer; errors are answers too, and none is longer than the project allows."""
    most = engine.project.config().max_response_chars
    try:
        text = json.dumps(TOOLS[name][2](engine, args), default=str)
    except ConfigError as e:
        return {"isError": True, "content": [{"type": "text", "text": json.dumps({"kind": "invalid", "message": str(e), "suggestion": "correct the arguments or the configuration"})}]}
    if len(text) > most:
        text = json.dumps({"truncated": True, "chars": len(text), "followUp": "ask for less", "head": text[: max(0, most - 200)]})
    return {"isError": False, "content": [{"type": "text", "text": text}]}


def answer(engine, line: str) -> dict | None:
    try:
        asked = json.loads(line)
    except ValueError:
        return _error(None, PARSE, "not JSON")
    if not isinstance(asked, dict) or asked.get("jsonrpc") != "2.0" or not isinstance(asked.get("method"), str):
        return _error(asked.get("id") if isinstance(asked, dict) else None, INVALID, "not a request")
    if "id" not in asked:
        return None
    method, params = asked["method"], asked.get("params") or {}
    if method == "initialize":
        result = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "catalens", "version": "1"}, "instructions": "Read-only questions over catalog snapshots."}
    elif method == "ping":
        result = {}
    elif method == "tools/list":
        result = {"tools": [_tool(n) for n in TOOLS]}
    elif method == "tools/call":
        if params.get("name") not in TOOLS:
            return _error(asked["id"], INVALID, f"no tool `{params.get('name')}`")
        result = call(engine, params["name"], params.get("arguments") or {})
    else:
        return _error(asked["id"], UNKNOWN, f"no method `{method}`")
    return {"jsonrpc": "2.0", "id": asked["id"], "result": result}


def _error(id_, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": id_, "error": {"code": code, "message": message}}


def serve(engine, lines, out) -> None:
    for line in lines:
        if line.strip() and (said := answer(engine, line)) is not None:
            print(json.dumps(said), file=out, flush=True)
