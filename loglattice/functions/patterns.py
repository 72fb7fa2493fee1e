"""Search words and parse patterns as Java regular expressions."""

from __future__ import annotations

import re

FLAGS = "(?iuUd)"
#: stands between captures while they are one string; a private character
MARK = "\ue000"


def escape(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_\ue001" or ord(c) > 127 else r"\s" if c == " " else "\\" + c if c.isprintable() else f"\\x{{{ord(c):X}}}" for c in text)


def wildcard(text: str) -> tuple[str, int]:
    """(regex, number of captures): stars are as short as possible; one at the end reaches to the end."""
    parts = text.replace('\\"', '"').split("*")
    regex = "(.*?)".join(escape(p) for p in parts)
    return FLAGS + regex + (r"\z" if text.endswith("*") else ""), len(parts) - 1


def literal(text: str) -> str | None:
    """The text itself in lower case if a plain substring test will do."""
    text = text.replace('\\"', '"')
    return text.lower() if text.isascii() and "*" not in text and " " not in text else None


def keyword(text: str) -> str:
    return FLAGS + escape(text.replace('\\"', '"'))


def numbered(regex: str) -> tuple[str, list[str], bool, int]:
    """(regex with numbered groups, their names, whether one may take no part, unnamed groups)."""
    names = re.findall(r"(?<!\\)\(\?P?<([A-Za-z_][A-Za-z0-9_]*)>", regex)
    out = re.sub(r"(?<!\\)\(\?P?<[A-Za-z_][A-Za-z0-9_]*>", "(", regex)
    bare = re.sub(r"\[(?:\\.|[^\]\\])*\]", "", re.sub(r"\\.", "", regex))
    unnamed = len(re.findall(r"\((?!\?)", bare))
    optional = "|" in bare or bool(re.search(r"\)(?:[?*]|\{0)", bare))
    out = re.sub(r"(?<!\\)\$", r"\\z", re.sub(r"\[(?:\\.|[^\]\\])*\]", lambda m: m.group().replace("$", r"\$"), out))
    return "(?uUd)" + out, names, optional, unnamed
