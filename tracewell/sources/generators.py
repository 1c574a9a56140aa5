"""Connectors to chat-completion services, as functions of two prompts; `answer.provider` runs them over a table."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from ..config import Settings

RETRIED = (429, 500, 502, 503, 504)


class GeneratorError(RuntimeError):
    """A service that failed, with what it said; never a key."""


def post_json(url: str, payload: dict, headers: dict[str, str] | None = None, timeout: float = 60.0, retries: int = 2, pause: float = 0.5, opener: Callable = urllib.request.urlopen) -> dict:
    """The JSON reply to a POST.  Lost connections and transient states are tried again, after longer and longer pauses."""
    body = json.dumps(payload).encode()
    for attempt in range(retries + 1):
        last = attempt == retries
        try:
            request = urllib.request.Request(url, body, {"Content-Type": "application/json", **(headers or {})})
            with opener(request, timeout=timeout) as reply:
                text = reply.read().decode("utf-8", "replace")
            try:
                return json.loads(text)
            except ValueError:
                raise GeneratorError("the reply is no JSON") from None
        except urllib.error.HTTPError as e:
            if last or e.code not in RETRIED:
                raise GeneratorError(f"HTTP {e.code}: {e.read()[:300].decode('utf-8', 'replace')}") from None
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            if last:
                raise GeneratorError(f"no connection after {attempt + 1} attempts: {e}") from None
        time.sleep(pause * (attempt + 1))
    raise GeneratorError("no attempt was made")


def chat_text(payload: dict) -> str:
    """The text of the first choice (or of the one message) of a chat reply."""
    message = (payload.get("choices") or [{}])[0].get("message") or payload.get("message") or {}
    if message.get("content") is None:
        raise GeneratorError("the reply has no message")
    return str(message["content"])


def usage(payload: dict) -> tuple[int, int, int]:
    """Prompt, completion and all tokens; 0 where not told."""
    u = payload.get("usage") or {}
    return tuple(int(u.get(k) or 0) for k in ("prompt_tokens", "completion_tokens", "total_tokens"))


def chat(url: str, model: str, key: str = "", timeout: float = 60.0, retries: int = 2, **request) -> Callable[[str, str], str]:
    """generate(system, user) of a chat-completions service."""

    def generate(system: str, user: str) -> str:
        payload = {"model": model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}], "temperature": 0, "stream": False}
        return chat_text(post_json(url, payload, {"Authorization": f"Bearer {key}"} if key else None, timeout, retries, **request))

    return generate


def by_settings(settings: Settings, key: str = "") -> Callable[[str, str], str] | None:
    """The generator that settings name; none for the extractive one, which needs no service."""
    if settings.llm_provider == "extractive":
        return None
    if settings.llm_provider == "chat":
        if not settings.llm_url or not settings.llm_model:
            raise ValueError("the chat provider needs a URL and a model")
        return chat(settings.llm_url, settings.llm_model, key, settings.llm_timeout, settings.llm_retries)
    raise ValueError(f"unknown provider {settings.llm_provider!r}")
