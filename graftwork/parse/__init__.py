"""Sources to trees, by language, under limits."""

from __future__ import annotations

import signal
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from graftwork.parse.brace import parse_brace
from graftwork.parse.html_tree import parse_html
from graftwork.parse.json_tree import parse_json
from graftwork.parse.node import Limits, Node, ParseLimit, finish
from graftwork.parse.python_tree import parse_python

LANGUAGES = frozenset("c cpp csharp go html java javascript json php python ruby rust typescript".split())


@contextmanager
def _deadline(ms: int) -> Iterator[None]:
    """Stops what runs longer by a timer, in a main thread (as kernels have it); elsewhere it is told afterwards."""
    began = time.monotonic()
    timed = threading.current_thread() is threading.main_thread() and ms < 1 << 31

    def stop(*_: object) -> None:
        raise ParseLimit(f"longer than {ms} ms")

    if timed:
        before = signal.signal(signal.SIGALRM, stop)
        signal.setitimer(signal.ITIMER_REAL, max(ms, 1) / 1000)
    try:
        yield
    finally:
        if timed:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)
    if (time.monotonic() - began) * 1000 > ms:
        raise ParseLimit(f"longer than {ms} ms")


def parse(source: str, lang: str, logic_only: bool = False, limits: Limits | None = None) -> Node:
    """The hashed tree of a source; without comments if logic_only. Raises ParseLimit beyond the limits, ValueError for other languages."""
    limits = limits or Limits()
    if len(source.encode()) > limits.max_bytes:
        raise ParseLimit(f"larger than {limits.max_bytes} bytes")
    if lang not in LANGUAGES:
        raise ValueError(f"no parser for {lang}")
    with _deadline(limits.timeout_ms):
        root = {"json": parse_json, "python": parse_python, "html": parse_html}[lang](source) if lang in ("json", "python", "html") else parse_brace(source, lang)
    return finish(root, source, logic_only, limits)


def parse_bytes(content: bytes, lang: str, logic_only: bool = False, limits: Limits | None = None) -> Node:
    return parse(content.decode("utf-8"), lang, logic_only, limits)
