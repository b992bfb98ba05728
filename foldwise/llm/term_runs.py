"""Matches of a pattern in whole texts, in lists of bounded length."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

PIECE = 1 << 16


def pieces(pattern: re.Pattern, text) -> Iterator[list]:
    """All matches of ``pattern`` in order; a long text gives several lists, so that they never fill memory."""
    if len(text) <= 1 << 20:
        yield pattern.findall(text)
        return
    found = (m.group() for m in pattern.finditer(text))
    while some := list(islice(found, PIECE)):
        yield some
