"""Models behind HTTP: the request forms that public vision and language services share. The address, the model's name and the key are the caller's; a key may be a text, a file's name, or the name of an environment variable of the workers. Connections are opened only when a request runs."""

from __future__ import annotations

import base64
import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path

from parcelflow.functions.text import mime_of
from parcelflow.models.base import Backend, ModelOutput, resolve_text, with_retry

JSON_HINT = "Answer with one JSON object and nothing else."


def resolve_key(value: str | None) -> str | None:
    """A key from its text, file or environment variable."""
    if value is None:
        return None
    return os.environ[value] if value in os.environ else resolve_text(value)


def encoded(image: str) -> tuple[str, str]:
    """(MIME type, base64) of an image: a file, or a data address as it is."""
    if image.startswith("data:"):
        head, _, body = image.partition(",")
        return head[5:].split(";")[0], body
    return mime_of(image), base64.b64encode(Path(image).read_bytes()).decode()


def _remote(image: str) -> bool:
    return image.startswith(("http://", "https://"))


def chat_request(model: str, images: list[str], prompt: str, json_mode: bool, most_tokens: int) -> dict:
    """Messages with parts; an image is an address, of data if it is a file."""
    address = lambda i: i if _remote(i) or i.startswith("data:") else "data:{};base64,{}".format(*encoded(i))
    parts = [{"type": "text", "text": prompt}, *({"type": "image_url", "image_url": {"url": address(i)}} for i in images)]
    return {"model": model, "max_tokens": most_tokens, "messages": [{"role": "user", "content": parts}], **({"response_format": {"type": "json_object"}} if json_mode else {})}


def chat_answer(body: dict) -> str | None:
    """None if the service withheld its answer."""
    c = body["choices"][0]
    return None if c.get("finish_reason") == "content_filter" else c["message"]["content"]


def blocks_request(model: str, images: list[str], prompt: str, json_mode: bool, most_tokens: int) -> dict:
    """Content blocks with sources; JSON is asked for in the system text."""
    source = lambda i: {"type": "url", "url": i} if _remote(i) else dict(zip(("type", "media_type", "data"), ("base64", *encoded(i))))
    parts = [*({"type": "image", "source": source(i)} for i in images), {"type": "text", "text": prompt}]
    return {"model": model, "max_tokens": most_tokens, "messages": [{"role": "user", "content": parts}], **({"system": JSON_HINT} if json_mode else {})}


def blocks_answer(body: dict) -> str | None:
    return "".join(b["text"] for b in body["content"] if b.get("type") == "text") or None


def parts_request(model: str, images: list[str], prompt: str, json_mode: bool, most_tokens: int) -> dict:
    """Contents with inline data; needs an image."""
    if not images:
        raise ValueError("this form needs at least one image")
    inline = lambda i: dict(zip(("mime_type", "data"), encoded(i)))
    return {"contents": [{"parts": [{"text": prompt}, *({"inline_data": inline(i)} for i in images)]}], "generationConfig": {"maxOutputTokens": most_tokens, **({"response_mime_type": "application/json"} if json_mode else {})}}


def parts_answer(body: dict) -> str | None:
    found = body.get("candidates") or []
    if not found or found[0].get("finishReason") in ("SAFETY", "PROHIBITED_CONTENT", "BLOCKLIST"):
        return None
    return "".join(p.get("text", "") for p in found[0]["content"]["parts"])


#: form: (request, answer, the header of the key and what stands before it)
FORMS: dict[str, tuple[Callable, Callable, str, str]] = {"chat": (chat_request, chat_answer, "Authorization", "Bearer "), "blocks": (blocks_request, blocks_answer, "x-api-key", ""), "parts": (parts_request, parts_answer, "x-goog-api-key", "")}


class HttpBackend(Backend):
    """A model at an address. Statuses 429 and 5xx and lost connections are tried again, with growing waits; other errors fail the request."""

    def __init__(self, url: str, model: str, form: str = "chat", key: str | None = None, json_mode: bool = False, most_tokens: int = 1024, timeout: float = 60.0, headers: dict[str, str] | None = None, tries: int = 5, wait: float = 0.5):
        self.request, self.answer, name, before = FORMS[form]
        self.url, self.name, self.json_mode, self.most_tokens, self.timeout, self.tries, self.wait = url, model, json_mode, most_tokens, timeout, tries, wait
        key = resolve_key(key)
        self.headers = {"Content-Type": "application/json", **({name: before + key} if key else {}), **(headers or {})}

    def run(self, images: list[str], prompt: str, **options) -> ModelOutput | None:
        body = json.dumps(self.request(self.name, images, prompt, options.get("json_mode", self.json_mode), self.most_tokens)).encode()
        status, got = with_retry(lambda: self._send(body), self.tries, self.wait)
        if status >= 400:
            raise RuntimeError(f"status {status}: {got[:200].decode('utf-8', 'replace')}")
        raw = json.loads(got)
        text = self.answer(raw)
        return None if text is None else ModelOutput(text, raw=raw)

    def _send(self, body: bytes) -> tuple[int, bytes]:
        try:
            with urllib.request.urlopen(urllib.request.Request(self.url, body, self.headers), timeout=self.timeout) as r:
                return r.status, r.read()
        except urllib.error.HTTPError as e:
            if e.code == 429 or e.code >= 500:
                raise
            return e.code, e.read()
