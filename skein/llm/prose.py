"""The sentences of markdown, transcripts, chats and mails: what is neither title, heading, code, table, path nor tag."""

from __future__ import annotations

import re

from skein.llm import textnorm

_FRONT = re.compile(r"\A---[ \t]*\n.*?\n---[ \t]*(?:\n|\Z)", re.S)
#: A fence without an end ends at a blank line.
_FENCE = re.compile(r"```.*?```|~~~.*?~~~|(?:```|~~~).*?(?:\n[ \t]*(?=\n)|\Z)", re.S)
#: Headings, table rows, indented code and lines with the signs of code, mail headers and lines that are only a reference to a path.
_DROPPED = re.compile(r"^(?:#{1,6}[ \t].*|[ \t]*\|.*|(?: {4}|\t)[ \t]*[^\s].*|(?:Subject|From|To|Cc|Date|Re|Fwd):.*|(?:see|siehe|voir|ver|см\.?|див\.?)?[ \t]*/\S+|.*(?:[{}]|&&|\w=\w|\w\([\w, ]*\)[:;.]|(?<!\S)--\w).*)$", re.M | re.I)
_PREFIX = re.compile(r"^(?:[ \t>]|[*+-][ \t])*(?:\[\d\d:\d\d(?::\d\d)?\][ \t]*)?(?:\*\*[^*\n]{1,40}\*\*[ \t]*:?[ \t]*|[^\W\d_][\w.-]{0,24}:[ \t]+)?", re.M)
_ASIDE = re.compile(r"`[^`\n]*`|\[\[[^\]\n]*\]\]|\]\([^)\n]*\)|https?://\S+|(?<!\S)/\S+|(?<!\w)[#@][\w:/-]+|[\"“«„](?:\.\.\.|…)[^\"”»“\n]*(?:\.\.\.|…)[\"”»“]")
_END = re.compile(r"(?<=[.!?…])[\"”»“')\]]*\s+|\n+|[\"”»“')]*\s+(?=[\"“«„])")
_SOFT = re.compile(r"(?<![.!?…:\n])\n(?=[^\W\d_A-ZÀ-ÖØ-ÞА-ЯЁІЇЄҐ])")


def sentences(text: str, titled: bool = False, whole: bool = False) -> list[str]:
    """Sentences of a text; titled: the first paragraph is a heading or title that was put in front; whole: nothing is dropped."""
    text = textnorm.unmarked(text)
    if titled:
        text = text.partition("\n\n")[2]
    if not whole:
        if text.startswith("---"):
            text = _FRONT.sub("", text)
        if "```" in text or "~~~" in text:
            text = _FENCE.sub("\n", text)
        text = _PREFIX.sub("", text)
        text = _DROPPED.sub("", text)
        text = _ASIDE.sub(" ", text)  # references, inline code, handles and quoted fragments are left out
    if "\n" in text:
        text = _SOFT.sub(" ", text)
    return [s for s in _END.split(text) if s]
