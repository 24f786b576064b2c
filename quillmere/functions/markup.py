"""Visible text of HTML, read as its tokens: comments, tags with quoted
attributes, and elements whose content is raw text.  One Arrow batch at a time;
the character references are all those of HTML 5."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, functions as F

from quillmere.functions.text import BLOCK_TAGS

# A quote opens a value only behind "=", so a ">" inside it does not end the tag.
_INSIDE = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+"""
_TOKEN = re.compile(
    rf"""
      <!--(?:-?>|.*?(?:--!?>|\Z))                                     # a comment; an unclosed one ends with the page
    | <(?P<raw>script|style)(?=[\s/>]){_INSIDE}>.*?(?:</(?P=raw)(?=[\s/>]){_INSIDE}>|\Z)
    | <(?:[!?]|(?P<name>/?[A-Za-z][^\s/>]*+)){_INSIDE}(?P<end>>|\Z)    # a tag or a declaration; any other "<" is text
    """,
    re.IGNORECASE | re.DOTALL | re.VERBOSE,
)
_BLOCK = re.compile(rf"/?(?:{BLOCK_TAGS})", re.IGNORECASE)
_HEAD_END = re.compile(r"</head(?=[\s/>])", re.IGNORECASE)


def _shown(page: str, head_until: int) -> str | None:
    """The text between the tokens; what lies in a head that begins before
    ``head_until`` is hidden.  None if that head did not end after all."""
    out, at, hidden = [], 0, False
    for token in _TOKEN.finditer(page):
        if not hidden:
            out.append(page[at : token.start()])
        name = (token["name"] or "").lower()
        at = token.end()
        if hidden:
            hidden = name != "/head"
        elif name and not token["end"]:  # a tag that never ends is text
            out.append(token[0])
        elif name == "head" and token.start() < head_until:
            hidden = True
        elif name and _BLOCK.fullmatch(name):
            out.append("\n")
    return None if hidden else "".join([*out, page[at:]])


def visible(page: str) -> str:
    """The page without its tags, a line break for each bound of a block."""
    ends = [m.start() for m in _HEAD_END.finditer(page)]
    text = _shown(page, ends[-1]) if ends else None
    return unescape(_shown(page, 0) if text is None else text)


def visible_text(html: Column) -> Column:
    @F.arrow_udf("string")
    def convert(pages: pa.Array) -> pa.Array:
        return pa.array([None if p is None else visible(p) for p in pages.to_pylist()], pa.string())

    return convert(html)
