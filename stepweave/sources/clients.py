"""Clients of models over HTTP, in the form of chat completions and embeddings: plain functions that providers.answered() and providers.embed_texts() call in tasks."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from stepweave.settings import BackendError, SettingsError, logger

#: Answers of a server after which another try may succeed.
AGAIN = (429, 500, 502, 503, 504)


def base_url(url: str) -> str:
    """A server's address: without blanks and slashes at its end, http:// where it names no scheme; an empty one fails."""
    url = url.strip().rstrip("/")
    if not url:
        raise SettingsError("a model needs an address")
    return url if "://" in url else f"http://{url}"


def endpoint_url(url: str, kind: str) -> str:
    """The address of one kind of request: /v1 is added to a server's address that has no version of its own."""
    own = base_url(url)
    if own.endswith(f"/{kind}"):
        return own
    last = own.rsplit("/", 1)[-1]
    return f"{own}/{kind}" if last[:1] == "v" and last[1:].isdigit() else f"{own}/v1/{kind}"


@dataclass(frozen=True)
class Endpoint:
    """A model and where it is. tries and wait: of each request, with waits that grow up to most_wait seconds."""

    base_url: str
    model: str
    api_key: str = ""
    timeout_sec: float = 120
    max_tokens: int = 4096
    temperature: float = 0.1
    tries: int = 3
    wait: float = 2.0
    most_wait: float = 10.0

    def __post_init__(self) -> None:
        base_url(self.base_url)
        if not self.model:
            raise SettingsError("a model needs a name")

    def post(self, kind: str, body: dict) -> dict:
        """The JSON answer to a request; BackendError where there is none after all tries."""
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(endpoint_url(self.base_url, kind), json.dumps(body).encode(), headers, method="POST")
        for k in range(1, self.tries + 1):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout_sec) as answer:
                    return json.loads(answer.read().decode())
            except urllib.error.HTTPError as e:
                failure = f"{kind}: HTTP {e.code}: {e.read().decode(errors='replace')[:500]}"
                if e.code not in AGAIN:
                    raise BackendError(failure) from e
            except (OSError, ValueError) as e:
                failure = f"{kind}: {e}"
            if k < self.tries:
                logger().warning("try %d of %d failed: %s", k, self.tries, failure)
                time.sleep(min(self.most_wait, self.wait * k))
        raise BackendError(failure)


def chat(endpoint: Endpoint) -> Callable[[str], str]:
    """A function of prompts that gives the text of answers; one that the server cut short fails at once."""

    def generate(prompt: str) -> str:
        body = {"model": endpoint.model, "messages": [{"role": "user", "content": prompt}], "temperature": endpoint.temperature, "max_tokens": endpoint.max_tokens}
        choices = endpoint.post("chat/completions", body).get("choices") or [{}]
        if choices[0].get("finish_reason") not in (None, "stop"):
            raise BackendError(f"an answer was cut short ({choices[0]['finish_reason']}): ask for less, or allow more tokens")
        content = choices[0].get("message", {}).get("content") or ""
        # Some servers give an answer in parts.
        return "".join(p.get("text", "") if isinstance(p, dict) else str(p) for p in content) if isinstance(content, list) else content

    return generate


def vectors(endpoint: Endpoint, dimensions: int | None = None) -> Callable[[list[str]], list[list[float]]]:
    """A function of texts that gives their vectors, in order; of another number, or of other lengths than dimensions, fails."""

    def embed(texts: list[str]) -> list[list[float]]:
        items = endpoint.post("embeddings", {"model": endpoint.model, "input": texts}).get("data")
        if not isinstance(items, list) or len(items) != len(texts) or not all(isinstance(x, dict) and isinstance(x.get("embedding"), list) for x in items):
            raise BackendError("the server's answer holds no vector for each text")
        items = sorted(items, key=lambda x: x.get("index", 0)) if all("index" in x for x in items) else items
        made = [x["embedding"] for x in items]
        if dimensions and any(len(v) != dimensions for v in made):
            raise BackendError(f"vectors of {len(made[0])} numbers, not {dimensions}")
        return made

    return embed
