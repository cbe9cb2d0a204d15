"""The prose of a Markdown text, in blocks."""

from __future__ import annotations

import re

_LINE = re.compile(r"\r\n|\r|\n")
_FENCE = re.compile(r"(`{3,}|~{3,})")
_ITEM = re.compile(r"(?:[-*+]|\d{1,9}[.)])\s+(?:\[[ xX/-]\]\s+)?")
_QUOTE = re.compile(r"(?:>\s?)+")
_CALLOUT = re.compile(r"\[![^\]]*\][+-]?.*")
_RULE = re.compile(r"(?:[-*_=]\s*){3,}$|\|?[\s:|-]*--[\s:|-]*$")
_EMBED = re.compile(r"!\[\[[^\]]*\]\]|!\[[^\]]*\]\([^)]*\)")
_INLINE = re.compile(
    r"`+[^`]*`+|\$\$.*?\$\$|<!--.*?-->|<[a-zA-Z/][^>]*>"  # code, mathematics, tags
    r"|(?:https?|ftp|file|obsidian)://\S+|www\.\S+|\S+@\S+\.\S+"
    r"|(?<!\w)#[\w/-]+|\[\^[^\]]*\]"  # hashtags, footnote marks
)
_LINK = re.compile(r"\[\[(?:[^\]|]*\|)?([^\]]*)\]\]|\[([^\]]*)\]\([^)]*\)")
_MARKED = re.compile(r"[!`$<#@\[]|://|www\.")
_ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{30,}")  # base64, hashes, identifiers
LETTERS = re.compile(r"[^\W\d_]+")


def blocks(text: str) -> list[str]:
    """Paragraphs, lists, quotes and callouts as plain text, one line for each of theirs, without markup.

    Front matter, headings, code, tables, embeds and URLs are left out. A fence that never ends reaches to the end.
    """
    lines = _LINE.split(text)
    out: list[str] = []
    held: list[str] = []
    fence = ""
    first = 0
    if lines and lines[0].lstrip("﻿").rstrip() == "---":
        for k in range(1, len(lines)):
            if lines[k].rstrip() in ("---", "..."):
                first = k + 1
                break
    listed = False
    for k in range(first, len(lines)):
        raw = lines[k]
        line = raw.strip()
        if not line:
            if held and not fence:
                out.append("\n".join(held))
                held = []
            continue
        if line[0] == ">":
            line = _QUOTE.sub("", line, count=1).strip()
            line = _CALLOUT.sub("", line, count=1) if line.startswith("[!") else line
        c = line[:1]
        if c and c in "`~" and (m := _FENCE.match(line)):
            if not fence:
                fence = m[1]
            elif m[1][0] == fence[0] and len(m[1]) >= len(fence) and len(line) == len(m[1]):
                fence = ""
            continue
        if fence or not c:
            continue
        if c == "#" and re.match(r"#{1,6}(?:\s|$)", line):
            continue
        if c in "|+" and line.count("|") >= 2:
            continue
        if c in "-*_=|:" and _RULE.match(line):
            if c in "=-" and held and not held[-1].endswith((".", "!", "?")) and len(held) == 1:
                held = []  # the line before was a heading
            continue
        item = _ITEM.match(line)
        if raw[:4] == "    " or raw[:1] == "\t":
            if not held and not listed and not item:
                continue  # indented code
        listed = bool(item) or (listed and raw[:1] in " \t")
        line = line[item.end() :] if item else line
        if _MARKED.search(line):
            line = _INLINE.sub(" ", _LINK.sub(lambda m: m[1] or m[2] or "", _EMBED.sub(" ", line)))
        if len(line) >= 30:
            line = _ENCODED.sub(" ", line)
        if line.strip():
            held.append(("\x00" if item else "") + line.strip())
    if held:
        out.append("\n".join(held))
    return out


def sentences(block: str) -> list[str]:
    """A list item is a sentence at least; other lines run on."""
    joined = block.replace("\n\x00", ".\n").replace("\x00", "").replace("\n", " ")
    return [s for s in re.split(r"(?<=[.!?…])[\"'”’)\]]*\s+|[。！？]", joined) if s.strip()]
