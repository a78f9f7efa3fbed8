"""Translators: anything with ``complete`` (a prompt) or ``translate`` (a text). They run on the executors."""

from __future__ import annotations

import json
import socket
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

from folioflow.functions.config import LlmOptions
from folioflow.functions.model_json import ANSWER_FORM, choice_text, error_detail, whole_number


class TranslatorError(RuntimeError):
    """An answer with an HTTP status that means failure."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


def is_timeout(error: BaseException) -> bool:
    """Whether an error means that time ran out, by its status, its type or its words."""
    if getattr(error, "status", getattr(error, "code", None)) in (408, 504, 524):
        return True
    reason = getattr(error, "reason", None)
    if isinstance(error, TimeoutError | socket.timeout) or isinstance(reason, TimeoutError | socket.timeout):
        return True
    words = f"{error} {reason or ''}".lower()
    return "timed out" in words or "timeout" in words


@dataclass
class Script:
    """A translator that answers from a list, for tests: strings, errors to raise, or functions of the prompt; the last one stays."""

    answers: list
    calls: list = field(default_factory=list)

    def complete(self, prompt: str, **options) -> str:
        answer = self.answers[min(len(self.calls), len(self.answers) - 1)]
        self.calls.append(prompt)
        if isinstance(answer, BaseException):
            raise answer
        return answer(prompt) if callable(answer) else answer

    translate = complete


@dataclass
class Mapped:
    """A translator that applies a function to each text."""

    change: Callable[[str], str]

    def translate(self, text: str, **options) -> str:
        return self.change(text)

    def complete(self, prompt: str, **options) -> str:
        """Prompts end with the payload; its texts are changed."""
        at = prompt.find('{"items":')
        if at < 0:
            return self.change(prompt)
        items = json.loads(prompt[at:])["items"]
        return json.dumps({"items": [{"id": i["id"], "t": self.change(i["t"])} for i in items]}, ensure_ascii=False)


@dataclass
class LlmClient:
    """A server with the chat-completions interface; ``log`` gets a dict for each counted call."""

    options: LlmOptions
    source: str = "en"
    target: str = "ja"
    log: list = field(default_factory=list)

    def body(self, prompt: str, temperature: float | None, form: dict | None) -> dict:
        o = self.options
        out = {"model": o.model, "messages": [{"role": "user", "content": prompt}], "temperature": o.temperature if temperature is None else temperature,
               "max_tokens": o.max_tokens, "source_lang_code": self.source, "target_lang_code": self.target}
        if o.repetition_penalty is not None:
            out["repetition_penalty"] = o.repetition_penalty
        if o.disable_thinking:
            out |= {"enable_thinking": False, "chat_template_kwargs": {"enable_thinking": False}}
        return out | ({"response_format": form} if form else {})

    def post(self, body: dict) -> dict:
        request = urllib.request.Request(self.options.base_url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.options.timeout or None) as answer:
                data = answer.read().decode("utf-8")
        except urllib.error.HTTPError as e:
            raise TranslatorError(f"HTTP {e.code}: {error_detail(e.read().decode('utf-8', 'replace'))}", e.code) from e
        return json.loads(data)

    def complete(self, prompt: str, temperature: float | None = None, structured: bool = False, **meta) -> str:
        began, form = time.monotonic(), ANSWER_FORM if structured else None
        try:
            try:
                answer = self.post(self.body(prompt, temperature, form))
            except TranslatorError as e:
                if not form or e.status not in (400, 404, 422):
                    raise
                answer = self.post(self.body(prompt, temperature, None))  # a server that knows no answer forms
        except Exception:
            self.log.append({"ok": False, "elapsed": time.monotonic() - began, "prompt_chars": len(prompt), "completion_chars": 0, **meta})
            raise
        choices = answer.get("choices") or []
        text, _ = choice_text(choices[0]) if choices else ("", None)
        usage = answer.get("usage") if isinstance(answer.get("usage"), dict) else {}
        self.log.append({"ok": True, "elapsed": time.monotonic() - began, "prompt_chars": len(prompt), "completion_chars": len(text),
                         **{k: whole_number(usage.get(k)) for k in ("prompt_tokens", "completion_tokens", "total_tokens")}, **meta})
        return text


@dataclass
class GoogleClient:
    """The public web endpoint that translates a text by GET."""

    timeout: float = 30.0
    target: str = "ja"
    url: str = "https://translate.googleapis.com/translate_a/single"

    def translate(self, text: str, **options) -> str | None:
        query = urllib.parse.urlencode({"client": "gtx", "sl": "auto", "tl": self.target, "dt": "t", "q": text})
        with urllib.request.urlopen(f"{self.url}?{query}", timeout=self.timeout) as answer:
            parsed = json.loads(answer.read().decode("utf-8"))
        return "".join(part[0] for part in parsed[0] if part and part[0]).strip() or None


def tries(call: Callable[[], str | None], times: int = 3, pause: float = 0.5) -> tuple[str | None, int]:
    """The first answer that says something, and how many calls it took; errors are waited out, empty answers aren't."""
    for n in range(1, times + 1):
        try:
            answer = call()
        except Exception:  # noqa: BLE001
            if n < times:
                time.sleep(pause)
            continue
        if answer and answer.strip():
            return answer.strip(), n
    return None, times
