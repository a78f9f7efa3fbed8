"""Options of a run, and where they come from: arguments, environment, files of settings."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from pathlib import Path

#: What switches an option off.
OFF = ("0", "false", "no", "off", "")


@dataclass(frozen=True)
class LlmOptions:
    base_url: str = "http://localhost:1234/v1"
    model: str = "translategemma-4b-it"
    timeout: float | None = None
    max_tokens: int = 4096
    temperature: float = 0.2
    repetition_penalty: float | None = 1.0
    disable_thinking: bool = True
    max_workers: int = 8
    translate_mode: str = "page"
    page_max_chars: int = 70000
    page_retries: int = 1
    target_pages: str = ""
    page_stats_only: bool = False


@dataclass(frozen=True)
class Options:
    engine: str = "google"
    google_max_workers: int = 8
    google_timeout: float = 30.0
    keep_debug: bool = False
    #: A font file for the text that is set; without one, or where it isn't there, the PDF library's own font for ideographs.
    font_file: str | None = None
    #: What becomes of a document with a page that can't be translated: ``keep`` its text, ``raise``, or translate it by ``segment``.
    on_page_failure: str = "keep"
    #: Noise segments reach the model in segment mode.
    send_noise: bool = True
    #: Equal requests are sent once.
    deduplicate: bool = False
    #: Keep what came back of a page and ask again for the rest only.
    keep_partial: bool = False
    llm: LlmOptions = field(default_factory=LlmOptions)

    def __post_init__(self):
        if self.engine not in ("google", "llm"):
            raise ValueError(f"unknown engine {self.engine!r}")
        if self.on_page_failure not in ("keep", "raise", "segment"):
            raise ValueError(f"unknown choice {self.on_page_failure!r} for pages that fail")

    @property
    def workers(self) -> int:
        return max(1, self.llm.max_workers if self.engine == "llm" else self.google_max_workers)


def parse_pages(value) -> list[int] | None:
    """Sorted page numbers of a list like ``0,2-4``; null if none is named. Ends may be in either order; the rest is passed over."""
    pages: set[int] = set()
    for part in str(value or "").split(","):
        ends = [_number(x) for x in (part.split("-", 1) if "-" in part else [part])]
        if None in ends:
            continue
        pages |= {p for p in range(min(ends), max(ends) + 1) if p >= 0}
    return sorted(pages) or None


def _number(text: str) -> int | None:
    try:
        return int(text.strip())
    except ValueError:
        return None


def read_settings(path) -> dict[str, str]:
    """``KEY=value`` lines; comments, ``export`` and one pair of equal quotes round a value are taken off."""
    out: dict[str, str] = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        line = line.strip()
        if not line or line.startswith("#") or "=" not in line:
            continue
        key, value = line.removeprefix("export ").split("=", 1)
        value = value.strip()
        if len(value) >= 2 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        if key.strip():
            out[key.strip()] = value
    return out


def load_settings(path, environ=os.environ) -> int:
    """Sets them over the environment's; how many changed."""
    if not Path(path).is_file():
        return 0
    found = read_settings(path)
    changed = sum(environ.get(k) != v for k, v in found.items())
    environ.update(found)
    return changed


def load_all_settings(source: str | None, explicit: str | None = None, environ=os.environ) -> int:
    """The named file, then ``.env`` of the working folder, of this program and of the source; the last one wins."""
    folders = [Path.cwd(), Path(__file__).resolve().parent] + [Path(source).resolve().parent] * bool(source)
    files = [Path(explicit)] * bool(explicit) + [f / ".env" for f in folders]
    return sum(load_settings(f, environ) for f in dict.fromkeys(files))


def setting(name: str, old_name: str | None = None, default=None, environ=os.environ):
    """The value of a name, of its older name, or the default."""
    return environ.get(name, environ.get(old_name, default) if old_name else default)


def switch(name: str, old_name: str | None = None, default: bool = False, environ=os.environ) -> bool:
    value = setting(name, old_name, None, environ)
    return default if value is None else value.strip().lower() not in OFF


def output_path(source: str, engine: str) -> str:
    """The source's name with the engine's suffix."""
    path = Path(source)
    return str(path.with_name(path.stem + ("_LLM" if engine == "llm" else "_G") + path.suffix))


def elapsed_text(seconds: float) -> str:
    """``12.3s`` or ``2m03.2s``; nothing below 0."""
    seconds = max(0.0, float(seconds))
    minutes = int(seconds // 60)
    return f"{seconds:.1f}s" if seconds < 60 else f"{minutes}m{seconds - 60 * minutes:04.1f}s"


#: Fixed value: order of the parts of a request's label.
LABEL_ORDER = ("mode", "strategy", "kind", "items", "chars", "markers", "page", "block_idx")


def request_label(meta: dict | None) -> str:
    """What a request is about, for logs: known parts first, then the others."""
    meta = {k: v for k, v in (meta or {}).items() if v is not None}
    names = [k for k in LABEL_ORDER if k in meta] + [k for k in meta if k not in LABEL_ORDER]
    return " ".join(["req", *(f"{k}={meta[k]}" for k in names)]) if names else ""


def failure_text(reason: str, page: int | None = None, chars: int | None = None, limit: int | None = None) -> str:
    """Why page mode failed, and what helps."""
    where = f"page {page}" if page is not None else "a page"
    if reason == "page_too_large":
        return f"{where} has {chars} characters, over the limit of {limit}: raise the limit, leave the page out, or translate by segments"
    if reason == "page_batch_failed":
        return f"{where} could not be translated: lower the number of workers, raise the timeout, or allow more retries"
    if reason == "no_items":
        return "there is nothing to translate on the chosen pages"
    return f"{where} failed: {reason}"
