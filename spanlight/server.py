"""A JSON-RPC server over standard streams, one message a line, with tools that only read."""

from __future__ import annotations

import json
from typing import IO, Any

from spanlight.errors import SpanlightError, UsageError
from spanlight.plans import package
from spanlight.workspace import Workspace

_TEXT = {"type": "string"}


def _tool(name: str, about: str, required: list[str], **more: dict) -> dict[str, Any]:
    return {"name": name, "description": about, "inputSchema": {"type": "object", "properties": {r: _TEXT for r in required} | more, "required": required, "additionalProperties": False}}


TOOLS = [
    _tool("search", "Ranked passages for a question.", ["query"], limit={"type": "integer", "minimum": 1}),
    _tool("context", "A package of passages within a budget, with what was left out.", ["query"], budget=_TEXT),
    _tool("why_not", "What a package for the question leaves out, by rule.", ["query"], budget=_TEXT),
    _tool("trace", "Where a quotation stands in the corpus.", ["quotation"]),
    _tool("verify", "Whether an answer's quotations occur in a package.", ["package", "answer"]),
    _tool("status", "Counts of documents and sections.", []),
]


def call(ws: Workspace, name: str, args: dict[str, Any]) -> Any:
    spec = next((t for t in TOOLS if t["name"] == name), None)
    if spec is None:
        raise UsageError(f"no tool named {name!r}")
    shape = spec["inputSchema"]
    if set(args) - set(shape["properties"]) or set(shape["required"]) - set(args):
        raise UsageError(f"{name} takes {', '.join(shape['properties']) or 'nothing'}")
    if name == "search":
        rows, cut = ws.search(args["query"], args.get("limit"))
        return {"results": rows, "capped": cut}
    if name in ("context", "why_not"):
        made = ws.context(args["query"], args.get("budget"))
        return made if name == "context" else [{"rule": o["rule"], "reason": o["reason"]} for o in made["omissions"]]
    if name == "trace":
        return ws.trace(args["quotation"])
    if name == "verify":
        return ws.verify(package.read_back(args["package"]), args["answer"])
    return ws.doctor()


def handle(ws: Workspace, message: dict[str, Any]) -> dict[str, Any] | None:
    """The reply to a request; None to a notification."""
    if "id" not in message:
        return None
    reply: dict[str, Any] = {"jsonrpc": "2.0", "id": message["id"]}
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "spanlight"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": TOOLS}}
    if method == "tools/call":
        try:
            out = call(ws, params.get("name", ""), params.get("arguments") or {})
            return reply | {"result": {"content": [{"type": "text", "text": json.dumps(out, ensure_ascii=False)}], "isError": False}}
        except SpanlightError as e:
            return reply | {"result": {"content": [{"type": "text", "text": json.dumps({"kind": e.kind, "retryable": e.retryable, "message": str(e)})}], "isError": True}}
    return reply | {"error": {"code": -32601, "message": f"no method {method!r}"}}


def serve(ws: Workspace, source: IO[str], sink: IO[str]) -> None:
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            out = handle(ws, message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "a request is an object"}}
        except json.JSONDecodeError as e:
            out = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if out is not None:
            sink.write(json.dumps(out, ensure_ascii=False) + "\n")
            sink.flush()
