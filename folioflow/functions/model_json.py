"""What a language model's answer holds, however it is wrapped."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_object(text: str) -> str | None:
    """From the first brace to the one that closes it, strings aside; null if none does."""
    start = text.find("{")
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(text)) if start >= 0 else ():
        c = text[i]
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
    return None


def items_of(parsed) -> list[dict] | None:
    """The entries of ``items`` whose id and text are strings that say something; null if there is no such list."""
    if not isinstance(parsed, dict) or not isinstance(parsed.get("items"), list):
        return None
    entries = [x for x in parsed["items"] if isinstance(x, dict) and isinstance(x.get("id"), str) and isinstance(x.get("t"), str)]
    return [{"id": x["id"].strip(), "t": x["t"].strip()} for x in entries if x["id"].strip() and x["t"].strip()]


def _parsed(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def parse_answer(text: str | None) -> list[dict] | None:
    """Items of an answer that is JSON or has an object in it; null if neither gives a list of items."""
    text = (text or "").strip()
    if not text:
        return None
    parsed = _parsed(text)
    if parsed is None and (found := first_object(text)) is not None:
        parsed = _parsed(found)
    return items_of(parsed)


def native_items(text: Column) -> Column:
    """The same for a text that is one JSON object, without Python: entries of string id and text, stripped."""
    entries = F.variant_get(F.try_parse_json(text), "$.items", "array<variant>")
    kind = lambda v, p: F.schema_of_variant(F.try_variant_get(v, p, "variant"))
    strings = F.filter(entries, lambda v: (kind(v, "$.id") == "STRING") & (kind(v, "$.t") == "STRING"))
    pairs = F.transform(strings, lambda v: F.struct(F.trim(F.try_variant_get(v, "$.id", "string")).alias("id"), F.trim(F.try_variant_get(v, "$.t", "string")).alias("t")))
    return F.filter(pairs, lambda p: (p["id"] != "") & (p["t"] != ""))


def content_text(content) -> str:
    """Message content as a string: itself, or of it or of each object in its list the first non-empty string of text, content and value."""
    if isinstance(content, str):
        return content
    objects = [x for x in (content if isinstance(content, list) else [content]) if isinstance(x, dict)]
    said = ([v for k in ("text", "content", "value") if isinstance(v := x.get(k), str) and v] for x in objects)
    return "".join(v[0] for v in said if v)


def _says(holder: dict, name: str) -> str:
    value = holder.get(name)
    return value if isinstance(value, str) and value.strip() else ""


def choice_text(choice) -> tuple[str, str]:
    """The text of a choice and the name of the field that held it; only a message's content may be a list or an object."""
    if not isinstance(choice, dict):
        return "", "none"
    if isinstance(message := choice.get("message"), dict):
        if (found := content_text(message.get("content"))).strip():
            return found, "message.content"
        for name in ("output_text", "text", "reasoning_content"):
            if found := _says(message, name):
                return found, f"message.{name}"
    for name in ("text", "output_text", "reasoning_content"):
        if found := _says(choice, name):
            return found, f"choice.{name}"
    return "", "none"


def error_detail(body: str | None) -> str:
    """What a server says about an error, in one short line."""
    body = (body or "").strip()
    parsed = _parsed(body)
    if isinstance(parsed, dict):
        if isinstance(error := parsed.get("error"), dict):
            parts = [str(error.get(k) or "").strip() for k in ("message", "code", "type")]
            if any(parts):
                return " | ".join(filter(None, parts))
        for name in ("message", "detail", "error"):
            if found := _says(parsed, name):
                return found.strip()
    return " ".join(body.split())[:300]


def whole_number(value) -> int | None:
    """A count that a server reports, as a whole number of 64 bits; null if it is none."""
    try:
        number = int(value)
    except (TypeError, ValueError, OverflowError):
        return None
    return number if abs(number) < 1 << 63 else None


#: Fixed value: the form that a model is asked to answer in.
ANSWER_FORM = {
    "type": "json_schema",
    "json_schema": {
        "name": "translated_items",
        "strict": True,
        "schema": {
            "type": "object",
            "properties": {"items": {"type": "array", "items": {"type": "object", "properties": {"id": {"type": "string"}, "t": {"type": "string"}},
                                                                "required": ["id", "t"], "additionalProperties": False}}},
            "required": ["items"],
            "additionalProperties": False,
        },
    },
}
