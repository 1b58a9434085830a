"""How connectors reach a service: over HTTP with retries, or from recorded answers; secrets never reach errors."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

PREVIEW = 500
#: Names, in headers, JSON or query strings, whose values are secret.
SECRET_NAMES = "access_token refresh_token id_token client_secret api_key apikey key code password authorization".split()
#: What tokens look like, as their issuers and RFC 6750 and 7519 describe them.
TOKEN_SHAPES = {
    "http scheme": r"(?i:bearer|basic)[ \t]+[^\s\"',]+",
    "json web token": r"eyJ[\w-]+\.[\w-]+\.[\w-]*",
    "google access token": r"ya29\.[\w.-]+",
    "google refresh token": r"1//[\w.-]+",
    "google api key": r"AIza[\w-]{30,}",
}
_NAMED = re.compile(rf"""(?i)(?<![a-z0-9_])((?:{"|".join(SECRET_NAMES)})["']?[ \t]*[:=][ \t]*["']?)[^\s"'&,;}}]+""")
_SHAPED = re.compile("|".join(rf"(?<![\w-])(?:{p})" for p in TOKEN_SHAPES.values()))
HIDDEN = "[redacted]"


class ServiceError(RuntimeError):
    def __init__(self, status: int, message: str) -> None:
        super().__init__(message)
        self.status = status


@dataclass(frozen=True)
class Request:
    method: str
    url: str
    params: Mapping[str, Any] = field(default_factory=dict)
    headers: Mapping[str, str] = field(default_factory=dict)
    body: Any = None

    @property
    def key(self) -> str:
        """What identifies a recorded answer: method, URL with sorted parameters, body."""
        query = urllib.parse.urlencode(sorted((k, str(v)) for k, v in self.params.items()))
        return f"{self.method} {self.url}{'?' + query if query else ''}" + (f" {json.dumps(self.body, sort_keys=True)}" if self.body is not None else "")


class Transport(Protocol):
    def send(self, request: Request) -> tuple[int, str]: ...


class HttpTransport:
    """urllib; an error status is an answer, not an exception."""

    def __init__(self, timeout: float = 60) -> None:
        self.timeout = timeout

    def send(self, request: Request) -> tuple[int, str]:
        url = request.url + ("?" + urllib.parse.urlencode(request.params, doseq=True) if request.params else "")
        data = None if request.body is None else json.dumps(request.body).encode()
        headers = {"Content-Type": "application/json"} | dict(request.headers)
        try:
            with urllib.request.urlopen(urllib.request.Request(url, data, headers, method=request.method), timeout=self.timeout) as got:
                return got.status, got.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            return e.code, e.read().decode("utf-8", "replace")


class RecordedTransport:
    """Answers by request key (or by a function of the request); what is not recorded is 404."""

    def __init__(self, answers: Mapping[str, Any] | Callable[[Request], Any]) -> None:
        self.answers = answers

    def send(self, request: Request) -> tuple[int, str]:
        got = self.answers(request) if callable(self.answers) else self.answers.get(request.key)
        if got is None:
            return 404, "not recorded"
        status, body = got if isinstance(got, tuple) else (200, got)
        return status, body if isinstance(body, str) else json.dumps(body)


def redact(message: str, secrets: Sequence[str | None] = ()) -> str:
    """message without the given values, token-like strings and values of secret names."""
    known = sorted({s.strip() for s in secrets if s and s.strip()}, key=len, reverse=True)
    if known:
        message = re.sub("|".join(map(re.escape, known)), HIDDEN, message)
    return _NAMED.sub(rf"\g<1>{HIDDEN}", _SHAPED.sub(HIDDEN, message))


def error_message(service: str, status: int, body: str, secrets: Sequence[str | None] = ()) -> str:
    """Service, status and the first 500 characters of the answer, without secrets."""
    said = redact(body, secrets)
    return f"{service} answered {status}: {said[:PREVIEW]}{'...' if len(said) > PREVIEW else ''}"


def send_json(transport: Transport, request: Request, service: str, secrets: Sequence[str | None] = (), retries: int = 3,
              first: float = 1.0, factor: float = 2.0, longest: float = 30.0, linear: bool = False, wait: Callable[[float], None] = time.sleep) -> Any:
    """The answer as JSON; statuses 429 and 5xx and network errors are tried again with growing pauses."""
    for attempt in range(retries + 1):
        try:
            status, body = transport.send(request)
        except OSError as e:
            if attempt == retries:
                raise
            status, body = 503, str(e)
        if 200 <= status < 300:
            return json.loads(body) if body.strip() else None
        if attempt == retries or (status != 429 and status < 500):
            raise ServiceError(status, error_message(service, status, body, secrets))
        wait(min(longest, first * (attempt + 1) if linear else first * factor**attempt))
    raise AssertionError
