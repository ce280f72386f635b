"""Translation backends: what turns one text into another."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass, field
from typing import Protocol


class FatalBackendError(RuntimeError):
    """No other request can work either; the job has to stop."""


class BackendError(RuntimeError):
    """This request failed; it may work when tried again."""


@dataclass(frozen=True)
class Request:
    text: str
    messages: list[dict]
    source_lang: str
    target_lang: str
    model: str
    max_tokens: int


class Backend(Protocol):
    """Is pickled to the tasks, so it opens its connections when first used."""

    def complete(self, request: Request) -> str: ...


@dataclass(frozen=True)
class StubBackend:
    """Puts the target language before the text; for tests and dry runs."""

    def complete(self, request: Request) -> str:
        return f"[{request.target_lang}] {request.text}"


@dataclass(frozen=True)
class EchoBackend:
    """Gives the text back."""

    def complete(self, request: Request) -> str:
        return request.text


@dataclass
class FaultyBackend:
    """The stub, with faults for chosen texts; for tests.

    ``soft`` texts always fail, ``empty`` ones get no answer, ``fatal`` ones stop
    the job, ``flaky`` ones work from the third try on.
    """

    soft: str | None = None
    empty: str | None = None
    fatal: str | None = None
    flaky: str | None = None
    _tries: dict = field(default_factory=dict)

    def complete(self, request: Request) -> str:
        def hit(mark: str | None) -> bool:
            return mark is not None and mark in request.text

        if hit(self.fatal):
            raise FatalBackendError("400: Failed to load model")
        if hit(self.soft):
            raise BackendError("connection lost")
        if hit(self.empty):
            return "  "
        if hit(self.flaky):
            tries = self._tries.get(request.text, 0) + 1
            self._tries[request.text] = tries
            if tries < 3:
                raise BackendError("time-out")
        return StubBackend().complete(request)


@dataclass(frozen=True)
class ChatBackend:
    """Any server with the common chat-completions protocol over HTTP."""

    base_url: str
    api_key: str = ""
    timeout: float = 600.0

    def complete(self, request: Request) -> str:
        body = {
            "model": request.model,
            "messages": request.messages,
            "temperature": 0.0,
            "max_tokens": request.max_tokens,
            "chat_template_kwargs": {"enable_thinking": False},
        }
        call = urllib.request.Request(
            f"{self.base_url.rstrip('/')}/chat/completions",
            data=json.dumps(body).encode(),
            headers={
                "Content-Type": "application/json",
                "Authorization": f"Bearer {self.api_key}",
            },
        )
        try:
            with urllib.request.urlopen(call, timeout=self.timeout) as reply:
                answer = json.load(reply)
        except urllib.error.HTTPError as e:
            said = e.read().decode("utf-8", "replace")
            fatal = ("Failed to load model", "invalid_request_error")
            if e.code == 400 or any(sign in said for sign in fatal):
                raise FatalBackendError(f"{e.code}: {said}") from e
            raise BackendError(f"{e.code}: {said}") from e
        except (OSError, ValueError) as e:
            raise BackendError(str(e)) from e
        try:
            choice = answer["choices"][0]
            said = choice["message"]["content"] or ""
        except (KeyError, IndexError, TypeError) as e:
            raise BackendError(f"unexpected answer: {answer!r:.200}") from e
        if not said.strip():
            raise BackendError(why_empty(choice, answer.get("usage")))
        return said


def why_empty(choice: dict, usage: dict | None) -> str:
    """What a server tells of an answer without a text, for the one who reads the failures."""
    told = [f"ended by {choice.get('finish_reason')}"]
    details = (usage or {}).get("completion_tokens_details") or {}
    spent, thought = (usage or {}).get("completion_tokens"), details.get("reasoning_tokens")
    if spent is not None:
        told.append(f"{spent} tokens" + (f", {thought} of them for reasoning" if thought else ""))
    hint = "; a larger limit or a model without reasoning may help" if thought else ""
    return f"empty answer ({'; '.join(told)}){hint}"
