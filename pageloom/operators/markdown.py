"""HTML to Markdown: # headings, fenced code, - lists, * and **.

div, span, p, section and article give their bare content, as the reference
does; with ``paragraphs`` a p ends in a blank line instead.
"""

from __future__ import annotations

import re

from pageloom.functions.text import ATTRIBUTES, NON_ARTICLE
from pageloom.operators.cleaning import without
from pageloom.operators.dom import Node, parse

DROPPED = frozenset("aside button footer form header iframe input nav noscript script select style textarea".split())
_SPACE = re.compile(r"[ \t\r\n]+")
_HEADING = re.compile(r"#{1,6}\s")
_ITEM = re.compile(r"[-*+]\s")


def _render(node: Node, paragraphs: bool, pre: bool, depth: int) -> str:
    parts = []
    number = 0
    for c in node.children:
        if isinstance(c, str):
            odd = not pre and ("  " in c or "\n" in c or "\t" in c or "\r" in c)
            parts.append(_SPACE.sub(" ", c) if odd else c)
            continue
        if c.tag in DROPPED:
            continue
        if depth > 200:
            parts.append(_SPACE.sub(" ", c.text()))
            continue
        inner = _render(c, paragraphs, pre or c.tag == "pre", depth + 1)
        tag, bare = c.tag, inner.strip()
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            parts.append(f"\n\n{'#' * int(tag[1])} {bare}\n\n" if bare else "")
        elif tag == "p" and paragraphs:
            parts.append(f"\n\n{bare}\n\n")
        elif tag in ("strong", "b"):
            parts.append(f"**{bare}**" if bare else inner)
        elif tag in ("em", "i"):
            parts.append(f"*{bare}*" if bare else inner)
        elif tag == "code" and not pre:
            parts.append(f"`{inner}`" if bare else "")
        elif tag == "pre":
            parts.append(f"\n\n```\n{c.text().strip(chr(10))}\n```\n\n")
        elif tag == "a" and c.get("href"):
            parts.append(f"[{bare}]({c.get('href')})")
        elif tag == "img":
            parts.append(f"![{c.get('alt')}]({c.get('src')})" if c.get("src") else "")
        elif tag == "br":
            parts.append("  \n")
        elif tag == "hr":
            parts.append("\n\n* * *\n\n")
        elif tag == "li":
            number += 1
            mark = f"{number}.  " if node.tag == "ol" else "-   "
            parts.append(mark + bare.replace("\n", "\n    ") + "\n")
        elif tag in ("ul", "ol"):
            parts.append(f"\n\n{inner.strip()}\n\n" if node.tag != "li" else f"\n{inner.strip()}")
        elif tag == "blockquote":
            parts.append("\n\n" + "\n".join(f"> {line}" for line in bare.split("\n")) + "\n\n")
        elif tag in ("table", "tr", "dl", "dt", "dd", "figure", "figcaption", "main", "address", "fieldset"):
            parts.append(f"\n\n{bare}\n\n" if bare else "")
        else:
            parts.append(inner)
    return "".join(parts)


def space_sections(markdown: str) -> str:
    """A blank line after headings, before headings and after lists."""
    lines = markdown.split("\n")
    out: list[str] = []
    for before, line, after in zip(["", *lines], lines, [*lines[1:], ""]):
        out.append(line)
        heading, next_heading = _HEADING.match(line), _HEADING.match(after)
        if heading and after and not next_heading:
            out.append("")
        if next_heading and line and not heading and before:
            out.append("")
        if _ITEM.match(line) and after and not _ITEM.match(after):
            out.append("")
    return "\n".join(out)


def tidy(markdown: str) -> str:
    return "\n".join(line.strip() for line in re.sub(r"\n{3,}", "\n\n", markdown).split("\n")).strip()


def to_markdown(html: str, paragraphs: bool = False) -> str:
    if not html:
        return ""
    raw = re.sub(r"\n{3,}", "\n\n", _render(parse(html), paragraphs, False, 0)).strip()
    return tidy(space_sections(raw))


_MARKS = ("<nav", "<header", "<footer", "<aside", "<form", "<div", "<div", 'class="', 'id="', "data-")
_STRIP = tuple(zip(_MARKS, map(re.compile, (*NON_ARTICLE, *ATTRIBUTES)), strict=True))


def convert(html: str, clean: bool = True, paragraphs: bool = False) -> str:
    """Markdown of an article, without one-line navigation and clutter if ``clean``."""
    return to_markdown(without(html, _STRIP) if clean else html, paragraphs)
