"""A model call with attempts: what to do after each answer is decided as in ``operators.inference``.

The call itself is given: it takes a request and returns (status, headers, body), or raises
``CallFailed`` when no whole answer came. It runs in the tasks that interpret pages.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from email.utils import parsedate_to_datetime
from typing import Any

from folio.operators.inference import RETRY_AFTER_CAP, RETRY_CODES, RETRYABLE

Call = Callable[[Any], tuple[int, dict[str, str], bytes]]


class CallFailed(Exception):
    """No whole answer: ``code`` is transport-error, transport-timeout or response-body-truncated."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


@dataclass
class Attempt:
    number: int
    error: str | None
    status: int | None
    elapsed_ms: int
    body: bytes | None  #: kept of failed attempts only


@dataclass
class Answer:
    content: dict[str, Any] | None
    error: str | None
    attempts: list[Attempt] = field(default_factory=list)

    @property
    def elapsed_ms(self) -> int:
        return sum(a.elapsed_ms for a in self.attempts)


def url(base: str, path: str) -> str:
    """A server's address, without slashes at its end, and a path."""
    return base.rstrip("/") + path


def utc_now(now: datetime | None = None) -> str:
    """The time in UTC to the second, with a Z."""
    return (now or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def retry_after(header: str | None, now: float | None = None) -> float | None:
    """Seconds that a server asks to wait, given as a number or as an HTTP date; None if it is neither."""
    if header is None:
        return None
    try:
        return float(header)
    except ValueError:
        pass
    try:
        due = parsedate_to_datetime(header).timestamp()
    except (TypeError, ValueError, OverflowError):
        return None
    return max(0.0, due - (time.time() if now is None else now))


def read_completion(body: bytes) -> tuple[dict[str, Any] | None, str | None]:
    """The JSON object that a completion holds, or what is wrong with it."""
    try:
        envelope = json.loads(body)
    except ValueError:
        return None, "invalid-http-response"
    choices = envelope.get("choices") if isinstance(envelope, dict) else None
    if not isinstance(choices, list):
        return None, "invalid-completion-envelope"
    if not choices:
        return None, "empty-response"
    first = choices[0] if isinstance(choices[0], dict) else {}
    message = first.get("message")
    if not isinstance(message, dict):
        return None, "invalid-completion-envelope"
    if first.get("finish_reason") == "length":
        return None, "output-token-limit"
    if not str(message.get("content") or "").strip():
        return None, "empty-response"
    if str(message.get("reasoning_content") or "").strip():
        return None, "unexpected-reasoning-content"
    try:
        content = json.loads(message["content"])
    except ValueError:
        return None, "invalid-json"
    return (content, None) if isinstance(content, dict) else (None, "invalid-json")


def ask(call: Call, request: Any, *, max_attempts: int = 2, backoff: float = 1.0, cap: float = RETRY_AFTER_CAP, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> Answer:
    """Calls until an answer is good, is not worth another attempt, or attempts run out."""
    answer = Answer(None, None)
    server_errors = 0
    for number in range(1, max_attempts + 1):
        started, status, headers, body, content = clock(), None, {}, None, None
        try:
            status, headers, body = call(request)
        except CallFailed as e:
            error: str | None = e.code
        else:
            if status == 200:
                content, error = read_completion(body)
            else:
                error = "http-retryable" if status in RETRYABLE else "http-server-error" if status >= 500 else "http-client-error"
        answer.attempts.append(Attempt(number, error, status, round(1000 * (clock() - started)), body if error else None))
        answer.content, answer.error = content, error
        again = error in RETRY_CODES or (error == "http-server-error" and server_errors == 0)
        if error is None or not again or number == max_attempts:
            return answer
        server_errors += error == "http-server-error"
        asked = retry_after({k.lower(): v for k, v in headers.items()}.get("retry-after"))
        sleep(backoff * 2 ** (number - 1) if asked is None else min(max(asked, 0.0), cap))
    return answer
