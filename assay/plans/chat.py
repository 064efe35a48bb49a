"""A provider of plans that asks a language model behind a chat completions endpoint.

    python -m assay.cli build --control control.yaml --out work --provider assay.plans.chat:provider

Where and what to ask stands in the environment: ASSAY_CHAT_URL (the whole address), ASSAY_CHAT_MODEL and ASSAY_CHAT_KEY,
which is sent as a bearer token if it is there. Calls that fail for a while (no connection, 429, 5xx) are made again.
"""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass, fields

from .model import STEPS, PlanError

SYSTEM = """You write plans that check evidence tables. Answer with one JSON object and nothing else.
Asked for groups, give {"groups": [{"group_id", "execution_order", "datasets", "checks"}]}.
Asked for steps, give {"steps": [...]}; asked for neither, give groups that each have "steps".
A step has "type" and the fields of that type. It reads aliases of earlier steps; NORMALIZE reads a dataset.
Expressions are SQL expressions in DuckDB's dialect, never statements. Use only columns of the schemas given.
Step types and their fields: """


def described() -> str:
    """The step types and their fields."""
    return "; ".join(f"{kind} ({', '.join(f.name for f in fields(made) if f.name != 'id')})" for kind, made in STEPS.items())


@dataclass(frozen=True)
class Chat:
    url: str
    model: str
    key: str = ""
    timeout: float = 60.0
    retries: int = 3
    wait: float = 1.0
    #: Groups are asked for first, then each group's steps.
    two_stages: bool = True

    def __call__(self, asked: dict) -> dict:
        """The model's answer to a request; PlanError if there is none, or none that is a JSON object."""
        messages = [{"role": "system", "content": SYSTEM + described()}, {"role": "user", "content": json.dumps(asked, default=str, ensure_ascii=False)}]
        body = {"model": self.model, "temperature": 0, "response_format": {"type": "json_object"}, "messages": messages}
        said = self._posted(json.dumps(body).encode())
        try:
            answer = json.loads(said["choices"][0]["message"]["content"])
        except (KeyError, IndexError, TypeError, ValueError) as e:
            raise PlanError(f"the answer can't be read: {e}") from e
        if not isinstance(answer, dict):
            raise PlanError("the answer is no JSON object")
        return answer

    def _posted(self, body: bytes) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        last: Exception | None = None
        for attempt in range(self.retries):
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, body, headers), timeout=self.timeout) as answer:
                    return json.loads(answer.read())
            except urllib.error.HTTPError as e:
                last = e
                if e.code != 429 and e.code < 500:
                    break
            except (OSError, ValueError) as e:
                last = e
            if attempt + 1 < self.retries:
                time.sleep(self.wait * 2**attempt)
        raise PlanError(f"no answer from {self.url}: {last}") from last


def from_environment(env: Mapping[str, str]) -> Chat:
    if missing := [n for n in ("ASSAY_CHAT_URL", "ASSAY_CHAT_MODEL") if not env.get(n)]:
        raise PlanError(f"not in the environment: {', '.join(missing)}")
    return Chat(env["ASSAY_CHAT_URL"], env["ASSAY_CHAT_MODEL"], env.get("ASSAY_CHAT_KEY", ""))


def provider(asked: dict) -> dict:
    """The provider that the environment describes."""
    return from_environment(os.environ)(asked)


provider.two_stages = True
