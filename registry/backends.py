"""Backends that only queries and tests use."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass

from glossa.backends import Request, StubBackend


@dataclass(frozen=True)
class TellingBackend:
    """Answers with the messages it was sent."""

    def complete(self, request: Request) -> str:
        return json.dumps(request.messages)


@dataclass(frozen=True)
class LastBackend:
    """Answers with the last message it was sent."""

    def complete(self, request: Request) -> str:
        return request.messages[-1]["content"]


@dataclass(frozen=True)
class SlowBackend:
    """The stub, after a while."""

    seconds: float

    def complete(self, request: Request) -> str:
        time.sleep(self.seconds)
        return StubBackend().complete(request)
