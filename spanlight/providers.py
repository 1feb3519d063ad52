"""Models behind HTTP on the local machine. Called from the driver alone."""

from __future__ import annotations

import json
import urllib.request
from urllib.parse import urlparse

from spanlight.errors import ProviderError, SettingsError

LOCAL = {"localhost", "127.0.0.1", "::1"}


def local_only(url: str) -> str:
    """url, if it is of this machine: prompts hold the corpus, which doesn't leave it."""
    if urlparse(url).hostname not in LOCAL:
        raise SettingsError(f"not a local address: {url}")
    return url.rstrip("/")


def _post(url: str, body: dict, timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.load(reply)
    except (OSError, ValueError) as e:
        raise ProviderError(f"{url}: {e}") from e


class GenerateProvider:
    """Servers with POST /api/generate."""

    def __init__(self, model: str, url: str = "http://localhost:11434", timeout: float = 120) -> None:
        self.model, self.url, self.timeout = model, local_only(url), timeout

    def generate(self, prompt: str) -> str:
        return _post(f"{self.url}/api/generate", {"model": self.model, "prompt": prompt, "stream": False, "options": {"temperature": 0}}, self.timeout)["response"]


class ChatProvider:
    """Servers with POST /v1/chat/completions."""

    def __init__(self, model: str, url: str = "http://localhost:8000", timeout: float = 120) -> None:
        self.model, self.url, self.timeout = model, local_only(url), timeout

    def generate(self, prompt: str) -> str:
        out = _post(f"{self.url}/v1/chat/completions", {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0}, self.timeout)
        return out["choices"][0]["message"]["content"]


class RegexRedactor:
    """Replaces matches by numbered tags within one session, and puts them back."""

    name, reversible = "regex", True

    def __init__(self, pattern: str, scope: str = "session") -> None:
        import re

        self._pattern, self.scope, self._held = re.compile(pattern), scope, {}

    def protect(self, text: str) -> str:
        def tag(m) -> str:
            known = next((t for t, v in self._held.items() if v == m[0]), None)
            return known or self._held.setdefault(f"[[{len(self._held) + 1}]]", m[0]) and f"[[{len(self._held)}]]"

        return self._pattern.sub(tag, text)

    def restore(self, text: str) -> str:
        for t, v in self._held.items():
            text = text.replace(t, v)
        return text
