"""Language-model backends: a small protocol, a deterministic offline one, and adapters that import lazily."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

Message = Mapping[str, str]


@dataclass
class Reply:
    """Text of a reply and its token counts."""

    text: str
    usage: dict[str, int] = field(default_factory=dict)


class Backend(Protocol):
    def complete(self, model: str, messages: Sequence[Message], schema: Mapping[str, Any] | None, params: Mapping[str, Any]) -> Reply: ...


def _usage(sent: str, got: str) -> dict[str, int]:
    a, b = len(sent.split()), len(got.split())
    return {"inputTokens": a, "outputTokens": b, "totalTokens": a + b}


class StubBackend:
    """Offline and deterministic: values that fit the schema, chosen by words of the last message, then by hash.

    An enum value whose name or words stand in the message wins; strings echo words of the message; numbers fall
    in their range. For tests and dry runs.
    """

    def complete(self, model: str, messages: Sequence[Message], schema: Mapping[str, Any] | None, params: Mapping[str, Any]) -> Reply:
        said = messages[-1]["content"]
        text = json.dumps(self._value(schema, said, "", schema), ensure_ascii=False) if schema else " ".join(said.split()[-12:])
        return Reply(text, _usage(" ".join(m["content"] for m in messages), text))

    def _value(self, schema: Mapping[str, Any], said: str, path: str, top: Mapping[str, Any]) -> Any:
        pick = int(hashlib.sha256(f"{path}\0{said}".encode()).hexdigest()[:12], 16)
        if "$ref" in schema:
            return self._value(top["$defs"][schema["$ref"].rsplit("/", 1)[-1]], said, path, top)
        if "enum" in schema:
            low = said.lower()
            named = [v for v in schema["enum"] if isinstance(v, str) and v.lower() in low]
            return min(named, key=lambda v: -low.rfind(v.lower())) if named else schema["enum"][pick % len(schema["enum"])]
        kind = schema.get("type", "string")
        if kind == "object":
            return {k: self._value(v, said, f"{path}.{k}", top) for k, v in schema.get("properties", {}).items()}
        if kind == "array":
            n = max(schema.get("minItems", 1), min(1, schema.get("maxItems", 1)))
            return [self._value(schema.get("items", {}), said, f"{path}[{i}]", top) for i in range(n)]
        if kind in ("number", "integer"):
            low, high = schema.get("minimum", 0), schema.get("maximum", 100)
            return low + pick % (int(high - low) + 1)
        if kind == "boolean":
            return bool(pick % 2)
        words = [w for w in said.split() if w.isalnum()] or ["none"]
        at = pick % len(words)
        return " ".join(words[at : at + 3])


class OpenAIBackend:
    """Chat completions with a strict schema, by the vendor's client, which has to be installed."""

    def complete(self, model: str, messages: Sequence[Message], schema: Mapping[str, Any] | None, params: Mapping[str, Any]) -> Reply:
        from openai import OpenAI

        extra = {"response_format": {"type": "json_schema", "json_schema": {"name": "result", "strict": True, "schema": strict_schema(schema)}}} if schema else {}
        got = OpenAI().chat.completions.create(model=model, messages=list(messages), **extra, **params)
        u = got.usage
        return Reply(got.choices[0].message.content or "", {"inputTokens": u.prompt_tokens, "outputTokens": u.completion_tokens, "totalTokens": u.total_tokens})


class GoogleBackend:
    """Generated content with a schema, by the vendor's client; system messages go in front of the first one."""

    def complete(self, model: str, messages: Sequence[Message], schema: Mapping[str, Any] | None, params: Mapping[str, Any]) -> Reply:
        from google import genai

        system = "\n\n".join(m["content"] for m in messages if m["role"] == "system")
        rest = [m for m in messages if m["role"] != "system"] or [{"role": "user", "content": ""}]
        contents = [{"role": "model" if m["role"] == "assistant" else "user", "parts": [{"text": m["content"]}]} for m in rest]
        if system:
            contents[0]["parts"][0]["text"] = f"{system}\n\n{contents[0]['parts'][0]['text']}"
        config = dict(params) | ({"response_mime_type": "application/json", "response_json_schema": schema} if schema else {})
        got = genai.Client(api_key=os.environ.get("GOOGLE_API_KEY")).models.generate_content(model=model, contents=contents, config=config)
        u = got.usage_metadata
        return Reply(got.text or "", {"inputTokens": u.prompt_token_count, "outputTokens": u.candidates_token_count, "totalTokens": u.total_token_count})


BACKENDS: dict[str, Callable[[], Backend]] = {"stub": StubBackend, "openai": OpenAIBackend, "google": GoogleBackend}


def provider_of(model: str) -> str:
    """The backend's name for a model id: stub models are offline, gemini models Google's, others OpenAI's."""
    return "stub" if model.startswith("stub") else "google" if model.startswith("gemini") else "openai"


def strict_schema(schema: Any) -> Any:
    """A JSON schema with closed objects whose properties are all required, without propertyNames."""
    if isinstance(schema, list):
        return [strict_schema(x) for x in schema]
    if not isinstance(schema, Mapping):
        return schema
    out = {k: strict_schema(v) for k, v in schema.items() if k != "propertyNames"}
    if out.get("type") == "object" and "properties" in out:
        out |= {"additionalProperties": False, "required": list(out["properties"])}
    return out
