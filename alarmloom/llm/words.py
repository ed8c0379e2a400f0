"""Parts of long texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

WHITE = re.compile(rb"[ \t-\r]")


def parts_of(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes, each ending behind a white space; no word is cut, however long."""
    at = 0
    while at < len(text):
        found = WHITE.search(text, min(at + size, len(text)))
        end = found.end() if found else len(text)
        yield text[at:end]
        at = end
