"""Text of PDF pages to Markdown by a chat service that speaks the OpenAI protocol."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from email.utils import parsedate_to_datetime

from lodestone.operators.ingest import retry_delays

# The services' addresses and the variables that hold their keys, in the order in which they are tried.
BACKENDS = {
    "deepseek": ("https://api.deepseek.com", "DEEPSEEK_API_KEY"),
    "openrouter": ("https://openrouter.ai/api/v1", "OPENROUTER_API_KEY"),
    "openai": ("https://api.openai.com/v1", "OPENAI_API_KEY"),
    "gemini": ("https://generativelanguage.googleapis.com/v1beta/openai/", "GEMINI_API_KEY"),
    "ollama": ("http://localhost:11434/v1", "OLLAMA_API_KEY"),
}
LEAST_WINDOW = 12288
TIMEOUT = 90
TASK = "Turn this text, extracted from the pages of a PDF, into Markdown: restore headings, paragraphs, lists, tables and code; leave out page numbers and running heads; add and change nothing else. Answer with the Markdown alone."


class NoKey(LookupError):
    """No service is set up."""


@dataclass(frozen=True)
class Converter:
    """Sends a text and returns the answer; can be sent to tasks."""

    name: str
    url: str
    key: str
    model: str

    def __call__(self, text: str) -> str:
        body = {"model": self.model, "temperature": 0.1, "messages": [{"role": "system", "content": TASK}, {"role": "user", "content": text}]}
        request = urllib.request.Request(self.url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        answer = json.loads(with_retries(lambda: urllib.request.urlopen(request, timeout=TIMEOUT).read()))
        if answer.get("error"):
            raise RuntimeError(answer["error"].get("message", "the service reports an error"))
        return answer["choices"][0]["message"]["content"].strip()


def with_retries(call: Callable[[], bytes], sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The call's result, tried again after faults of the network and statuses 429 and 5xx."""
    tried = 0
    while True:
        try:
            return call()
        except urllib.error.HTTPError as e:
            delays = retry_delays(e.code, asked_delay(e.headers.get("Retry-After")))
        except urllib.error.URLError:
            delays = retry_delays(None, None)
            if tried >= len(delays):
                raise
            sleep(delays[tried])
            tried += 1
            continue
        if tried >= len(delays):
            raise RuntimeError("the service refused the request")
        sleep(delays[tried])
        tried += 1


def asked_delay(header: str | None) -> float | None:
    """Seconds named by a Retry-After header, a number or a date."""
    if not header:
        return None
    if header.strip().isdigit():
        return float(header)
    try:
        return max(0.0, parsedate_to_datetime(header).timestamp() - time.time())
    except ValueError:
        return None


def converter(model: str, window: int, env: Mapping[str, str]) -> Converter:
    """The service named by the model (``name/model`` or ``name-...``) if it has a key, else the first that has one."""
    if window < LEAST_WINDOW:
        raise ValueError(f"the context window must hold {LEAST_WINDOW} tokens")
    named = [b for b in BACKENDS if model.startswith((b + "/", b + "-"))]
    for name in [*named, *BACKENDS]:
        url, variable = BACKENDS[name]
        key = env.get(variable, "").strip(" \"'\t\n").replace(" ", "")
        host = env.get("OLLAMA_HOST", "").strip() if name == "ollama" else ""
        if not key and not host:
            continue
        if host:
            url = host.rstrip("/") if host.rstrip("/").endswith("/v1") else host.rstrip("/") + "/v1"
        return Converter(name, url, key or "none", model.removeprefix(name + "/"))
    raise NoKey(f"none of {', '.join(v for _, v in BACKENDS.values())} is set")
