"""JSON arguments: strict parsing, canonical text, and a check against a small schema language."""

from __future__ import annotations

import json
from typing import Any

# JSON Schema's names of the Python types that its parser returns.
TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def _unique(pairs: list[tuple[str, Any]]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key occurs twice")
    return out


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def parsed(text: str) -> Any:
    return json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant)


def ordered(value: Any) -> Any:
    """Keys in the order of their UTF-16 units, whole floats as integers."""
    if isinstance(value, dict):
        return {k: ordered(value[k]) for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))}
    if isinstance(value, list):
        return [ordered(v) for v in value]
    if isinstance(value, float) and value.is_integer() and abs(value) < 2**53:
        return int(value)
    return value


def canonical(value: Any) -> str:
    """The one text of a JSON value: ordered keys, no blanks, no needless escapes."""
    text = json.dumps(ordered(value), ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    return text.encode("utf-8", "backslashreplace").decode()


def _is(kind: str, value: Any) -> bool:
    if kind in ("integer", "number"):
        whole = isinstance(value, int) or (isinstance(value, float) and value.is_integer())
        return not isinstance(value, bool) and isinstance(value, (int, float)) and (whole or kind == "number")
    return isinstance(value, TYPES[kind])


# What faults() checks, and keywords that only describe.
CHECKED = {"type", "enum", "required", "properties", "additionalProperties", "items", "minimum", "maximum", "minLength", "maxLength"}
DESCRIBING = {"title", "description", "default", "examples", "deprecated", "$comment", "$schema", "$id"}


def check_schema(schema: dict, at: str) -> None:
    """Raises a ValueError for a schema with keywords or forms of them that :func:`faults` does not check."""
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: a schema must be an object")
    unknown = sorted(set(schema) - CHECKED - DESCRIBING)
    if unknown or not isinstance(schema.get("additionalProperties", True), bool):
        raise ValueError(f"{at}: schema keywords not understood: {unknown or ['additionalProperties']}")
    kinds = schema.get("type", [])
    if not set([kinds] if isinstance(kinds, str) else kinds) <= {*TYPES, "integer", "number"}:
        raise ValueError(f"{at}: unknown type {kinds}")
    for key, part in schema.get("properties", {}).items():
        check_schema(part, f"{at}.{key}")
    if "items" in schema:
        check_schema(schema["items"], f"{at}[]")


def faults(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What in ``value`` breaks the schema, as sorted "path: rule" strings.

    Understands type, enum, required, properties, additionalProperties (false), items,
    minimum, maximum, minLength and maxLength.
    """
    kinds = schema.get("type")
    if kinds is not None and not any(_is(k, value) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: type"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: required" for k in schema.get("required", ()) if k not in value]
        for k, v in value.items():
            if k in known:
                found += faults(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                found.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            found += faults(v, schema["items"], f"{at}[{i}]")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        found += [f"{at}: minimum"] if value < schema.get("minimum", value) else []
        found += [f"{at}: maximum"] if value > schema.get("maximum", value) else []
    if isinstance(value, str):
        found += [f"{at}: minLength"] if len(value) < schema.get("minLength", 0) else []
        found += [f"{at}: maxLength"] if len(value) > schema.get("maxLength", len(value)) else []
    return sorted(found)
