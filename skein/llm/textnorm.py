"""Words of a text without case, punctuation, markup and layout."""

from __future__ import annotations

import html
import re
import unicodedata

#: Characters that are not seen: soft hyphen, zero-width and directional marks, variation selectors, byte order mark.
INVISIBLE = "­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ"
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_INLINE = re.compile(r"</?(?:a|abbr|b|code|del|em|font|i|ins|kbd|mark|q|s|small|span|strong|sub|sup|u)(?:\s[^<>]*)?/?>", re.I)
_TAG = re.compile(r"<[/!]?[a-z][^<>]*>", re.I)
_BROKEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\r?\n[ \t>]*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def visible(text: str) -> str:
    """Compatibility-composed text without invisible characters."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return text


def unmarked(text: str) -> str:
    """Visible text without HTML tags and entities."""
    text = visible(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = html.unescape(text)
    return text


def mended(text: str) -> str:
    """Text with the words joined that were broken at a line end."""
    if "-\n" in text or "-\r" in text or "- \n" in text:
        text = _BROKEN.sub("", text)
    return text


def words(text: str | None) -> list[str]:
    """Lower-case words; markup and words broken at a line end are mended."""
    if not text:
        return []
    text = mended(unmarked(text))
    return _WORD.findall(text.lower())
