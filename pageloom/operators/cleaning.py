"""The text functions that extraction needs inside Python, with the results of ``functions.text``."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pageloom.functions.text import ENTITIES

#: White space of a pattern, which ends at U+3000, and U+FEFF.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace()) + "\ufeff"
#: Characters beyond ASCII that a pattern without regard to case takes for "i", "k" or "s".
_FOLDED = re.compile("[\u0130\u0131\u017f\u212a]")


def without(html: str, patterns: Iterable[tuple[str, re.Pattern]]) -> str:
    """Without what patterns match, each of which is looked for only where its mark, in lower case, is."""
    low = None if _FOLDED.search(html) else html.lower()
    for mark, pattern in patterns:
        if low is None or mark in low:
            html = pattern.sub("", html)
    return html


_TAGS = tuple((mark, re.compile(p)) for mark, p in (("<script", r"(?is)<script\b.*?</script>"), ("<style", r"(?is)<style\b.*?</style>"), ("<", r"<[^>]+>")))


def strip_html(html: str) -> str:
    return " ".join(without(html, _TAGS).replace("\ufeff", " ").split())


def decode_entities(text: str) -> str:
    for name, char in ENTITIES:
        text = text.replace(f"&{name};", char)
    if "&#" not in text:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    text = re.sub(r"&#(\d{1,7});", lambda m: chr(int(m[1]) & 0xFFFF), text)
    text = re.sub(r"&#[xX]([0-9a-fA-F]{1,6});", lambda m: chr(int(m[1], 16) & 0xFFFF), text)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def clean_text(text: str) -> str:
    text = decode_entities(text).replace("\t", " ")
    text = re.sub(" {2,}", " ", text) if "  " in text else text
    lines = [x for x in (line.strip(_SPACES) for line in text.split("\n")) if x]
    out = []
    for line, after in zip(lines, [*lines[1:], ""]):
        out.append(line)
        if re.search(r"[.!?]$", line) and re.match("[A-Z0-9]", after) and len(line) > 40 and len(after) > 20:
            out.append("")
    return "\n".join(out).strip(_SPACES)
