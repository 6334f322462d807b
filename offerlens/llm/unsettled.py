"""Code points whose category and case hang on the Unicode version.

Python's tables, those of the ``regex`` module and those of a tokenizer library are of
different versions. They agree on what was assigned in the oldest of them; a text with a
code point that Python's own tables don't know is left to the library's rules.
"""

from __future__ import annotations

import re
import unicodedata

# From the first code point on that Python's tables don't have. One range is searched
# fast; texts of Latin letters have nothing in it.
_FIRST = next(x for x in range(0x110000) if unicodedata.category(chr(x)) == "Cn")
_LATER = re.compile(f"[{chr(_FIRST)}-\U0010ffff]")
_SETTLED: set[str] = set()


def unsettled(text: str) -> bool:
    """Whether Python's tables have any of the text's code points as unassigned."""
    if text.isascii() or not _LATER.search(text):
        return False
    new = set(text) - _SETTLED
    known = {c for c in new if unicodedata.category(c) != "Cn"}
    _SETTLED.update(known)
    return len(known) < len(new)
