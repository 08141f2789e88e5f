"""A registry of named tools, and the checks of their arguments."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any


class ToolError(Exception):
    """An error with a code, for callers of a tool."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


def kind_of(value: Any) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "array" if isinstance(value, (list, tuple)) else "object"


def validate(schema: dict, value: Any, path: str = "") -> list[tuple[str, str]]:
    """(path, message) of every way in which value isn't as schema (a subset of JSON Schema) has it."""
    found: list[tuple[str, str]] = []
    here, kind = path or ".", kind_of(value)

    def say(message: str, at: str = here) -> None:
        found.append((at, message))

    wanted = schema.get("type")
    if wanted == "integer":
        if kind != "number" or float(value) != int(value):
            say(f"expected integer, got {kind}")
    elif wanted and wanted != kind:
        say(f"expected {wanted}, got {kind}")
    if schema.get("enum") and value not in schema["enum"]:
        say("must be one of: " + ", ".join(map(str, schema["enum"])))
    if kind == "string":
        if len(value) < schema.get("minLength", 0):
            say(f"must be at least {schema['minLength']} characters")
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            say(f"must be at most {schema['maxLength']} characters")
    if kind == "number":
        if "minimum" in schema and value < schema["minimum"]:
            say(f"must be >= {schema['minimum']}")
        if "maximum" in schema and value > schema["maximum"]:
            say(f"must be <= {schema['maximum']}")
    if kind == "object":
        inner = lambda key: f"{path}.{key}" if path else key
        for key in schema.get("required", ()):
            if key not in value:
                say("required", inner(key))
        for key, part in schema.get("properties", {}).items():
            if key in value:
                found += validate(part, value[key], inner(key))
    if kind == "array" and schema.get("items"):
        for i, one in enumerate(value):
            found += validate(schema["items"], one, f"{here}[{i}]")
    return found


def template_pattern(template: str) -> tuple[re.Pattern, list[str]]:
    """The pattern and the names of a URI template such as "note://{id}"."""
    names = re.findall(r"\{(\w+)\}", template)
    parts = re.split(r"\{\w+\}", template)
    return re.compile("^" + "(.+)".join(map(re.escape, parts)) + "$"), names


class Registry:
    """Tools, resources and templates of resources; a name given again replaces."""

    def __init__(self) -> None:
        self.tools: dict[str, tuple[str, dict, Callable]] = {}
        self.resources: dict[str, Callable] = {}
        self.templates: dict[str, Callable] = {}

    def register(self, name: str, description: str, schema: dict, handler: Callable) -> None:
        self.tools[name] = (description, schema, handler)

    def call(self, name: str, arguments: dict | None = None) -> dict[str, Any]:
        """{result} or {error: {code, message}}; wrong arguments never reach the handler."""
        if name not in self.tools:
            return {"error": {"code": "unknown_tool", "message": name}}
        _, schema, handler = self.tools[name]
        wrong = validate(schema, arguments or {})
        if wrong:
            return {"error": {"code": "invalid_input", "message": "; ".join(f"{p}: {m}" for p, m in wrong)}}
        try:
            return {"result": handler(**(arguments or {}))}
        except ToolError as error:
            return {"error": {"code": error.code, "message": str(error)}}
        except Exception as error:  # noqa: BLE001
            return {"error": {"code": "internal_error", "message": str(error)}}

    def read(self, uri: str) -> Any:
        """The resource of a URI; fixed ones come before templates."""
        if uri in self.resources:
            return self.resources[uri]()
        for template, handler in self.templates.items():
            pattern, names = template_pattern(template)
            found = pattern.match(uri)
            if found:
                return handler(**dict(zip(names, found.groups())))
        raise ToolError("not_found", uri)
