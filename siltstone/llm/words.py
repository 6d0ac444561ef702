"""Words as the operators here count them: lower-cased runs of letters and digits."""

from __future__ import annotations

import re

#: Characters that are invisible inside a word.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ￹-￻"
_PLAIN = re.compile(r"[^\W_]+")
_RICH = re.compile(rf"[^\W_](?:[{INVISIBLE}]*[^\W_])*")
_DROP = re.compile(rf"[{INVISIBLE}]+")


def words(text: str | None) -> list[str]:
    """The words of a text; null gives none.  Invisible characters inside a word do not count."""
    if not text:
        return []
    if text.isascii():
        return _PLAIN.findall(text.lower())
    return [_DROP.sub("", w).lower() for w in _RICH.findall(text)]


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where each of ``words(text)`` stands, as (start, end) in code points."""
    return [m.span() for m in _RICH.finditer(text)]
