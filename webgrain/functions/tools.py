"""The tools that a model may call: their definitions in three dialects, and the checks of their arguments."""

from __future__ import annotations

import copy

from .plain import trim, units

# Names, limits and defaults.
TOOLS = (
    {
        "name": "web_search",
        "description": "Search the web and return untrusted candidate results.",
        "schema": {
            "type": "object", "additionalProperties": False, "required": ["query"],
            "properties": {"query": {"type": "string", "minLength": 1, "maxLength": 400}, "limit": {"type": "integer", "minimum": 1, "maximum": 20, "default": 5}},
        },
    },
    {
        "name": "fetch_content",
        "description": "Read one page as untrusted text.",
        "schema": {
            "type": "object", "additionalProperties": False, "required": ["url"],
            "properties": {"url": {"type": "string", "minLength": 1, "maxLength": 2048}, "maxCharacters": {"type": "integer", "minimum": 200, "maximum": 20_000, "default": 5_000}},
        },
    },
)


def strict(schema: dict) -> dict:
    """Every property required; those that were optional may be null, and have no default."""
    out = copy.deepcopy(schema)
    for name, kind in out["properties"].items():
        if name not in schema["required"]:
            kind.pop("default", None)
            kind["type"] = [kind["type"], "null"]
    return out | {"required": list(out["properties"]), "additionalProperties": False}


def definitions(dialect: str, search: bool = True) -> list[dict]:
    """dialect: responses, chat or converse. Without a search provider only pages can be read."""
    some = [t for t in TOOLS if search or t["name"] != "web_search"]
    if dialect == "converse":
        return [{"toolSpec": {"name": t["name"], "description": t["description"], "inputSchema": {"json": copy.deepcopy(t["schema"])}}} for t in some]
    flat = [{"name": t["name"], "description": t["description"], "parameters": strict(t["schema"]), "strict": True} for t in some]
    return [{"type": "function", **f} if dialect == "responses" else {"type": "function", "function": f} for f in flat]


def arguments(name: str, given: object) -> tuple[dict | None, str | None]:
    """(arguments with defaults, error): unknown tools and fields, wrong types and values out of range are INVALID_INPUT."""
    tool = next((t for t in TOOLS if t["name"] == name), None)
    if tool is None or not isinstance(given, dict) or set(given) - set(tool["schema"]["properties"]):
        return None, "INVALID_INPUT"
    out = {}
    for field, kind in tool["schema"]["properties"].items():
        value = given.get(field)
        if kind["type"] == "string":
            value = trim(value) if isinstance(value, str) else ""
            if not kind["minLength"] <= units(value) <= kind["maxLength"]:
                return None, "INVALID_INPUT"
        elif value is None:
            value = kind["default"]
        elif isinstance(value, bool) or not isinstance(value, int) or not kind["minimum"] <= value <= kind["maximum"]:
            return None, "INVALID_INPUT"
        out[field] = value
    return out, None
