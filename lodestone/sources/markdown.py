"""Markdown notes cut into chunks along their headings.

A note becomes front matter and blocks: headings (underlined ones too), paragraphs, lists, tables, quotes, code. Sections are
the blocks from one heading to the next, chunks are sections, or pieces of those that are longer than the limit. Each has the Markdown
itself (``rich``), the words without markup (``plain``), and ``embed``, the plain text with the overlap from the piece before.

Inline marks (emphasis, links, code spans and so on) are kept in a list and stand in the text as tokens until it is cut, so that
no cut parts one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from lodestone.functions.scalars import IMAGES, OTHER_FILES

try:
    import yaml
except ImportError:  # front matter is then read line by line
    yaml = None

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^\s`]*)[^`]*$|( {0,3})(~{3,})[ \t]*(\S*).*$")
_ITEM = re.compile(r"( {0,3})([-*+]|\d{1,9}[.)])([ \t]+|$)")
_TASK = re.compile(r"\[([ xX])\][ \t]+")
_DELIMITER = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_QUOTE = re.compile(r" {0,3}> ?")
_NOTE = re.compile(r" {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)$")
_NAMED = re.compile(r" {0,3}\[((?!\^)[^\[\]]+)\]:[ \t]*<?([^\s>]+)>?(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?[ \t]*$")
_HTML_END = (
    (re.compile(r" {0,3}<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r" {0,3}<!--"), re.compile("-->")),
    (re.compile(r" {0,3}<[?!]"), re.compile(r"[?\]]*>")),
)
# The elements that begin a block of HTML.
_ELEMENTS = "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param section summary table tbody td tfoot th thead title tr track ul"
_HTML = re.compile(rf" {{0,3}}</?(?:{'|'.join(_ELEMENTS.split())})(?:\s|/?>|$)", re.I)
_LONE_TAG = re.compile(r" {0,3}</?[a-zA-Z][\w-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?>[ \t]*$")

_CODE = re.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_ATOM = re.compile(
    r"(?P<escape>\\[!-/:-@\[-`{-~]|(?<=\]\()[^\s()<>]+(?:\([^\s()]*\)[^\s()]*)*)"  # or the address of a link
    r"|(?P<code>(?P<ticks>`+)(?!`)(?P<inner>.+?)(?<!`)(?P=ticks)(?!`))"
    r"|(?P<wiki>!?\[\[(?P<target>[^\[\]|\n]+)(?:\|(?P<label>[^\[\]\n]*))?\]\])"
    r"|(?P<auto><(?P<uri>[a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>)"
    r"|(?P<html><!--.*?-->|</?[a-zA-Z][^<>]*>)"
    r"|(?P<math>\$\$.+?\$\$|(?<![\w$])\$(?!\s)[^$\n]+?(?<!\s)\$(?![\w$]))"
    r"|(?P<foot>\[\^(?P<mark>[^\]\s]+)\])"
    r"|(?P<url>(?<![\w/])(?:(?:https?|ftp)://|www\.)[^\s<>\[\]`]*[^\s<>\[\]`.,:;!?\"'*_~)])"
    r"|(?P<tag>(?<![\w/#&])#(?P<name>[\w/-]*[^\W\d][\w/-]*))",
    re.S,
)
_LINK = re.compile(r"(!?)\[((?:[^\[\]]|\[[^\[\]]*\])*)\]\([ \t\n]*<?([^\s<>()]*(?:\([^\s()]*\)[^\s<>()]*)*)>?(?:[ \t\n]+(?:\"[^\"]*\"|'[^']*'))?[ \t\n]*\)")
_REFERENCE = re.compile(r"(!?)\[((?:[^\[\]]|\[[^\[\]]*\])+)\](?:\[([^\[\]]*)\])?")
_EMPHASIS = re.compile(r"(?P<star>\*{1,3})(?=[^\s*])(?P<a>(?:(?!\*).|\*(?!\*)(?=\S)(?:(?!\*).)+\*|\*\*(?=\S)(?:(?!\*).)+\*\*)+?)(?<=\S)(?P=star)(?!\*)|(?<!\w)(?P<bar>_{1,3})(?=[^\s_])(?P<b>.+?)(?<=[^\s_])(?P=bar)(?!\w)|(?P<wave>~{1,2})(?=[^\s~])(?P<c>[^~]+?)(?<=\S)(?P=wave)(?!~)", re.S)
_HELD = re.compile("\x02(\\d+)\x03")
# The tokens of code blocks and inline marks; their lengths decide where a long section is cut.
_TOKEN = re.compile("\x00(?:CODE:(\\d+):[^\x00]*|INLINE:(\\d+))\x00")
_END = re.compile(r"[.!?](?= )|\n")


@dataclass
class Chunk:
    heading_path: str
    heading_level: int
    plain: str
    rich: str
    embed: str
    has_task: bool
    has_code: bool


@dataclass
class Note:
    chunks: list[Chunk] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    links: list[str] = field(default_factory=list)
    front: dict[str, Any] = field(default_factory=dict)


@dataclass
class Block:
    """``kind``: heading, paragraph, code, list, quote or table. ``text`` is source text, code or a heading; ``rows`` the cells of a table;
    ``parts`` the blocks of a quote, or of each item of a list."""

    kind: str
    text: str = ""
    level: int = 0  # of a heading; the first number of a list, -1 for bullets
    lang: str = ""
    parts: list[Any] = field(default_factory=list)
    rows: list[list[str]] = field(default_factory=list)


def is_attachment(target: str) -> bool:
    bare = re.split(r"[|#]", target, maxsplit=1)[0].strip()
    return "." in bare and bare.rsplit(".", 1)[1].lower() in {*IMAGES, *OTHER_FILES}


def front_matter(text: str) -> tuple[dict[str, Any], str]:
    """The values of a leading ``---`` block, and the rest of the text. A block that is no mapping in YAML gives none."""
    m = re.match(r"\A﻿?---[ \t]*\n(?:(.*?)\n)?---[ \t]*(?:\n|\Z)", text, re.S)
    if not m:
        return {}, text
    found: Any = {}
    if yaml is None:
        found = _lines_of(m[1] or "")
    else:
        try:
            found = yaml.safe_load(m[1] or "")
        except (yaml.YAMLError, ValueError):
            found = {}
    return (found if isinstance(found, dict) else {}), text[m.end() :]


def _lines_of(block: str) -> dict[str, Any]:
    """Scalars and lists only, for want of a YAML parser."""
    front: dict[str, Any] = {}
    key = ""
    bare = lambda v: v[1:-1] if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'" else v
    for line in block.split("\n"):
        entry = re.match(r"([\w-]+)[ \t]*:[ \t]*(.*?)[ \t]*$", line)
        item = re.match(r"[ \t]*-[ \t]+(.*?)[ \t]*$", line)
        if entry:
            key, value = entry[1], entry[2]
            listed = value.startswith("[") and value.endswith("]")
            front[key] = [bare(v.strip()) for v in value[1:-1].split(",") if v.strip()] if listed else bare(value)
        elif item and key:
            front[key] = [*(front[key] if isinstance(front[key], list) else []), bare(item[1])]
    return front


def front_tags(front: dict[str, Any]) -> list[str]:
    """Tags under ``tags``, else ``tag``: a list, whose texts count, or one text with commas or else blanks between them."""
    value = front["tags"] if "tags" in front else front.get("tag")
    if isinstance(value, str):
        value = value.split(",") if "," in value else value.split()
    parts = [p.strip().removeprefix("#") for p in value if isinstance(p, str)] if isinstance(value, list) else []
    return [p for p in parts if p]


# Blocks


def _begins(line: str, inside: bool) -> bool:
    """Whether a line begins a block of its own, within a paragraph (``inside``) or elsewhere."""
    item = _ITEM.match(line)
    if item and inside:  # an empty item, or a number other than 1, does not interrupt a paragraph
        item = None if not line[item.end() :].strip() or (item[2][0].isdigit() and int(item[2][:-1]) != 1) else item
    return bool(item or _FENCE.match(line) or _HEADING.match(line) or _RULE.match(line) or _QUOTE.match(line) or _HTML.match(line) or any(a.match(line) for a, _ in _HTML_END))


def _cells(line: str) -> list[str]:
    bare = line.strip()
    bare = bare[1:] if bare.startswith("|") else bare
    bare = bare[:-1] if bare.endswith("|") and not bare.endswith("\\|") else bare
    return [c.strip() for c in re.split(r"(?<!\\)\|", bare)]


def blocks_of(lines: list[str], notes: dict[str, list[Block]], names: dict[str, str]) -> list[Block]:
    """The blocks of some lines. Footnotes go into ``notes``, addresses of named links into ``names``."""
    out: list[Block] = []
    k = 0
    while k < len(lines):
        line = lines[k]
        if not line.strip():
            k += 1
            continue
        if line.startswith(("    ", "\t")):  # indented code makes no block
            while k < len(lines) and (not lines[k].strip() or lines[k].startswith(("    ", "\t"))):
                k += 1
            continue
        if fence := _FENCE.match(line):
            indent, mark, lang = (fence[1], fence[2], fence[3]) if fence[2] else (fence[4], fence[5], fence[6])
            end = re.compile(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$")
            body = []
            k += 1
            while k < len(lines) and not end.match(lines[k]):
                body.append(re.sub(rf"^ {{0,{len(indent)}}}", "", lines[k]))
                k += 1
            k += 1
            out.append(Block("code", "\n".join(body), lang=lang))
        elif heading := _HEADING.match(line):
            out.append(Block("heading", heading[2] or "", len(heading[1])))
            k += 1
        elif _RULE.match(line):
            k += 1
        elif _QUOTE.match(line):
            inner, last = [], ""
            while k < len(lines) and (_QUOTE.match(lines[k]) or (last.strip() and lines[k].strip() and not _begins(lines[k], True) and not _begins(last, False))):
                last = _QUOTE.sub("", lines[k], count=1)
                inner.append(last)
                k += 1
            out.append(Block("quote", parts=blocks_of(inner, notes, names)))
        elif _ITEM.match(line):
            block, k = _list_at(lines, k, notes, names)
            out.append(block)
        elif (how := next((b for a, b in _HTML_END if a.match(line)), None)) is not None:
            while k < len(lines) and not how.search(lines[k]):
                k += 1
            k += 1
        elif _HTML.match(line) or _LONE_TAG.match(line):  # raw HTML makes no block
            while k < len(lines) and lines[k].strip():
                k += 1
        elif note := _NOTE.match(line):
            inner = [note[2]]
            k += 1
            while k < len(lines) and (lines[k].startswith(("    ", "\t")) or (lines[k].strip() and inner[-1].strip() and not _begins(lines[k], True) and not _NOTE.match(lines[k])) or (not lines[k].strip() and k + 1 < len(lines) and lines[k + 1].startswith(("    ", "\t")))):
                inner.append(re.sub(r"^(?: {1,4}|\t)", "", lines[k]))
                k += 1
            notes.setdefault(note[1].lower(), blocks_of(inner, notes, names))
        elif name := _NAMED.match(line):
            names.setdefault(" ".join(name[1].split()).lower(), name[2])
            k += 1
        else:
            k = _paragraph_at(lines, k, out)
    return out


def _paragraph_at(lines: list[str], k: int, out: list[Block]) -> int:
    """A paragraph, which an underline makes a heading and a delimiter row the head of a table."""
    held: list[str] = []
    while k < len(lines) and lines[k].strip() and not (held and _begins(lines[k], True) and not _UNDERLINE.match(lines[k])):
        line = lines[k]
        if held and (under := _UNDERLINE.match(line)):
            out.append(Block("heading", "\n".join(held), 1 if under[1][0] == "=" else 2))
            return k + 1
        if held and "|" in held[-1] + line and "-" in line and _DELIMITER.match(line) and len(_cells(line)) == len(_cells(held[-1])):
            head = _cells(held.pop())
            if held:
                out.append(Block("paragraph", "\n".join(held)))
            rows = [head]
            k += 1
            while k < len(lines) and lines[k].strip() and not _begins(lines[k], False):
                cells = _cells(lines[k])
                rows.append((cells + [""] * len(head))[: len(head)])
                k += 1
            out.append(Block("table", rows=rows))
            return k
        held.append(re.sub(r"\\$", "", line.strip()) if k + 1 < len(lines) else line.strip())
        k += 1
    out.append(Block("paragraph", "\n".join(held)))
    return k


def _list_at(lines: list[str], k: int, notes: dict, names: dict) -> tuple[Block, int]:
    first = _ITEM.match(lines[k])
    kind = first[2][-1]
    block = Block("list", level=int(first[2][:-1]) if first[2][0].isdigit() else -1)
    while k < len(lines):
        m = _ITEM.match(lines[k])
        if not m or m[2][-1] != kind or _RULE.match(lines[k]):
            break
        gap = len(m[3].expandtabs(4))
        rest = lines[k][m.end() :]
        wide = len(m[1]) + len(m[2]) + (gap if 0 < gap < 5 and rest.strip() else 1)
        inner = [(" " * (gap - 1) if gap >= 5 else "") + rest]
        k += 1
        while k < len(lines):
            line = lines[k].expandtabs(4) if lines[k].startswith(("\t", " ")) else lines[k]
            if not line.strip():
                ahead = next((x for x in lines[k:] if x.strip()), "")
                if not ahead.expandtabs(4).startswith(" " * wide):
                    break
                inner.append("")
            elif line.startswith(" " * wide):
                inner.append(line[wide:])
            elif inner[-1].strip() and not _ITEM.match(line) and not _begins(line, True) and not _FENCE.match(inner[-1]):
                inner.append(line.strip())  # a paragraph's line without its indent
            else:
                break
            k += 1
        block.parts.append(blocks_of(inner, notes, names))
        after = k
        while after < len(lines) and not lines[after].strip():
            after += 1
        if after < len(lines) and (m := _ITEM.match(lines[after])) and m[2][-1] == kind and not _RULE.match(lines[after]):
            k = after
    return block, k


# Inline marks


class _Inline:
    """The inline marks of a note: those met in a text are held aside, and what is left of them later is tokens."""

    def __init__(self, notes: dict[str, list[Block]], names: dict[str, str], skip_attachments: bool):
        self.notes, self.names, self.skip = notes, names, skip_attachments
        self.held: list[tuple[str, str, str]] = []
        self.known: list[tuple[str, str]] = []
        self.tags: set[str] = set()
        self.links: set[str] = set()

    def _hold(self, kind: str, inner: str, extra: str = "") -> str:
        self.held.append((kind, inner, extra))
        return f"\x02{len(self.held) - 1}\x03"

    def _atom(self, m: re.Match[str]) -> str:
        kind = m.lastgroup if m.lastgroup in ("escape", "html", "math", "url") else next(g for g in ("escape", "code", "wiki", "auto", "html", "math", "foot", "url", "tag") if m[g] is not None)
        if kind == "code":
            inner = m["inner"]
            return self._hold("code", inner[1:-1] if len(inner) > 2 and inner[0] == inner[-1] == " " and inner.strip() else inner)
        if kind == "wiki":
            target = m["target"].split("#", 1)[0].strip()
            attached, embed = is_attachment(target), m["wiki"].startswith("!")
            if target and not (attached and (embed or self.skip)):
                self.links.add(target)
            return self._hold("embed" if embed else "wiki", m["target"].strip(), (m["label"] or "").strip())
        if kind == "tag":
            self.tags.add(m["name"])
            return self._hold("tag", m["name"])
        if kind == "foot":
            if m["mark"].lower() not in self.notes:
                return self._hold("escape", m["foot"])
            return ""
        return "" if kind == "html" else self._hold({"auto": "url"}.get(kind, kind), m["uri"] if kind == "auto" else m[kind])

    def _link(self, m: re.Match[str]) -> str:
        return self._marked(m[2]) if m[1] else self._hold("link", self._marked(m[2]), self.shown(m[3], "rich"))

    def _reference(self, m: re.Match[str]) -> str:
        address = self.names.get(" ".join((m[3] or m[2]).split()).lower())
        if address is None:
            return m[0]
        return self._marked(m[2]) if m[1] else self._hold("link", self._marked(m[2]), address)

    def _strong(self, m: re.Match[str]) -> str:
        if m["wave"]:
            return self._hold("struck", self._marked(m["c"]))
        inner, n = self._marked(m["a"] or m["b"]), len(m["star"] or m["bar"])
        if n == 3:
            return self._hold("strong", self._hold("strong", inner, "**"), "*")
        return self._hold("strong", inner, "*" * n)

    def _marked(self, s: str) -> str:
        if "*" in s or "_" in s or "~" in s:
            s = _EMPHASIS.sub(self._strong, s)
        return s

    def taken(self, s: str) -> str:
        """The text with its marks held aside."""
        s = _ATOM.sub(self._atom, s)
        if "](" in s:
            s = _LINK.sub(self._link, s)
        if self.names and "[" in s:
            s = _REFERENCE.sub(self._reference, s)
        return self._marked(s)

    def shown(self, s: str, how: str) -> str:
        """A text with its marks written out: ``plain``, ``rich``, or as in a ``heading``, where only words count."""
        return _HELD.sub(lambda m: self._one(*self.held[int(m[1])], how), s)

    def _one(self, kind: str, inner: str, extra: str, how: str) -> str:
        rich, body = how == "rich", self.shown(inner, how)
        if kind == "escape":
            return inner
        if kind == "code":
            return f"`{inner}`" if rich else inner
        if kind in ("url", "math"):
            return "" if how == "heading" else inner
        if kind == "tag":
            return f"#{inner}" if rich else inner
        if kind == "link":
            return f"[{body}]({extra})" if rich else body
        if kind in ("strong", "struck"):
            mark = "~~" if kind == "struck" else extra
            return mark + body + mark if rich else body
        named = extra if extra and extra != inner else ""
        if rich:
            return ("!" if kind == "embed" else "") + f"[[{inner}{'|' + named if named else ''}]]"
        if kind == "embed" and how == "plain" and is_attachment(inner):
            what = "image" if inner.split("#")[0].strip().rsplit(".", 1)[-1].lower() in IMAGES else "attachment"
            return f"[{what}: {named}]" if named and not re.fullmatch(r"[0-9xX]*[0-9][0-9xX]*", named) else f"[{what}]"
        return extra or inner

    def text(self, source: str, line_break: str = " ") -> str:
        """A text in which each mark is a token."""

        def known(m: re.Match[str]) -> str:
            kind, inner, _ = self.held[int(m[1])]
            if kind == "escape":
                return inner
            self.known.append((self.shown(m[0], "plain"), self.shown(m[0], "rich")))
            return f"\x00INLINE:{len(self.known) - 1}\x00"

        return _HELD.sub(known, self.taken(source).replace("\n", line_break)).strip()

    def heading(self, source: str) -> str:
        return self.shown(self.taken(source).replace("\n", " "), "heading").strip()

    def only_tags(self, source: str) -> bool:
        """Whether a paragraph holds hashtags alone."""
        return bool(re.fullmatch(r"(?:#[\w/-]*[^\W\d][\w/-]*\s*)+", source.strip()))


def _flat(blocks: list[Block], inline: _Inline, line_break: str) -> str:
    """All texts below some blocks one after the other."""
    out = []
    for b in blocks:
        if b.kind in ("paragraph", "heading"):
            out.append(inline.text(b.text, line_break))
        elif b.kind == "quote":
            out.append(_flat(b.parts, inline, line_break))
        elif b.kind == "list":
            out += [_flat(item, inline, line_break) for item in b.parts]
        elif b.kind == "table":
            out += [inline.text(c, line_break) for row in b.rows for c in row]
    return "".join(out)


def _list_text(block: Block, inline: _Inline, depth: int = 0) -> tuple[str, bool]:
    """The items line by line, those within two spaces further in, and whether there is a task among them."""
    out, task = [], False
    for n, item in enumerate(block.parts):
        mark = "  " * depth + ("- " if block.level < 0 else f"{(block.level or 1) + n}. ")
        lines: list[str] = []
        for b in item:
            if b.kind == "list":
                text, inner = _list_text(b, inline, depth + 1)
                task = task or inner
                lines += [text] if text else []
                continue
            box = _TASK.match(b.text) if b.kind == "paragraph" and b is item[0] else None
            task = task or box is not None
            shown = _flat([Block("paragraph", b.text[box.end() :]) if box else b], inline, " ")
            shown = f"[{' ' if box[1] == ' ' else 'x'}] {shown}".strip() if box else shown
            if shown:
                lines.append(("  " * (depth + 1) if lines else mark) + shown)
        out.append("\n".join(lines) if lines else mark)
    return "\n".join(out), task


def _table_text(block: Block, inline: _Inline) -> str:
    rows = ["| " + " | ".join(inline.text(c) for c in row) + " |" for row in block.rows]
    return "\n".join([rows[0], "| " + " | ".join("---" for _ in block.rows[0]) + " |", *rows[1:]])


def _quote_text(block: Block, inline: _Inline) -> str:
    lines: list[str] = []
    for b in block.parts:
        if b.kind == "code":
            text = f"```{b.lang}\n{b.text.strip()}\n```"
        else:
            text = _text_of(b, inline, "\n")[0]
        lines += [f"> {x}" for x in text.split("\n")] if text.strip() else []
    return "\n".join(lines)


def _text_of(block: Block, inline: _Inline, line_break: str = " ") -> tuple[str, bool]:
    if block.kind == "list":
        return _list_text(block, inline)
    if block.kind == "table":
        return _table_text(block, inline), False
    if block.kind == "quote":
        return _quote_text(block, inline), False
    return inline.text(block.text, line_break), False


# Sections and chunks


def _sections(blocks: list[Block], inline: _Inline) -> Iterator[tuple[str, int, list[Block]]]:
    """``(heading path, level, blocks)``: the path of a heading without the headings below it."""
    stack: dict[int, str] = {}
    held: list[Block] = []
    level = 0
    for b in blocks:
        if b.kind != "heading":
            held.append(b)
            continue
        yield " > ".join(stack[n] for n in sorted(stack) if stack[n]), level, held
        level, held = b.level, []
        stack = {n: t for n, t in stack.items() if n < level} | {level: inline.heading(b.text)}
    yield " > ".join(stack[n] for n in sorted(stack) if stack[n]), level, held


def _cut(raw: str, limit: int, overlap: int) -> Iterator[tuple[str, str]]:
    """``(shown, embedded)``: pieces of at most ``limit`` characters, tokens counted as they stand, each embedded with the overlap before it.

    A piece ends behind a sentence, or before a line break, in the second half of its range if there is one, else at
    its end, and never within a token.
    """
    tokens = [m.span() for m in _TOKEN.finditer(raw)]
    inside = lambda at: next((t for t in tokens if t[0] < at < t[1]), None)
    start = fresh = 0
    while len(raw) - start > limit:
        cut = end = start + limit
        for m in _END.finditer(raw, start + limit // 2 + 1, min(end + 2, len(raw))):
            if m.start() <= end:
                cut = m.start() + (m[0] != "\n")
        if token := inside(cut):
            cut = token[1]
        yield raw[fresh:cut].strip(), raw[start:cut].strip()
        start, fresh = (cut - overlap if cut - overlap > start else cut), cut
        if token := inside(start):
            start = token[0]
    yield raw[fresh:].strip(), raw[start:].strip()


def parse(text: str, limit: int = 800, overlap: int = 100, skip_attachments: bool = True) -> Note:
    """The chunks, tags, links and front matter of a Markdown text.

    Only wikilinks are links; embedded files never are, linked ones unless skipped. Tags are those of the text and of the front
    matter, lower-cased, sorted. A paragraph of hashtags only makes no block, a section without blocks no chunk; footnotes that
    are referred to stand at the end. The overlap must be less than half the limit.
    """
    if overlap * 2 >= limit:
        raise ValueError("the overlap must be less than half the limit")
    note = Note()
    note.front, body = front_matter(re.sub("[\x00\x02\x03]", "�", re.sub(r"\r\n?", "\n", text)))
    notes: dict[str, list[Block]] = {}
    names: dict[str, str] = {}
    blocks = blocks_of(body.split("\n"), notes, names)
    inline = _Inline(notes, names, skip_attachments)
    # Footnotes are the end of the last section, in the order of their marks.
    marks = dict.fromkeys(m.lower() for m in re.findall(r"\[\^([^\]\s]+)\](?!:)", body) if m.lower() in notes)
    for path, level, held in _sections([*blocks, *(b for m in marks for b in notes[m])], inline):
        _section(note, inline, path, level, held, limit, overlap)
    note.tags = sorted({t.lower() for t in inline.tags} | {t.lower() for t in front_tags(note.front)})
    note.links = sorted(inline.links)
    return note


def _section(note: Note, inline: _Inline, path: str, level: int, blocks: list[Block], limit: int, overlap: int) -> None:
    raw, before, task = "", "", False
    codes: list[tuple[str, str]] = []
    for b in blocks:
        if b.kind == "code":
            codes.append((b.lang, b.text))
            text = f"\x00CODE:{len(codes) - 1}:{b.lang}\x00"
        elif b.kind == "paragraph" and inline.only_tags(b.text):
            inline.taken(b.text)
            continue
        else:
            text, tasks = _text_of(b, inline)
            task = task or tasks
        if text:
            raw += (" " if before == b.kind == "paragraph" else "\n\n" if raw else "") + text
            before = b.kind
    if not raw.strip():
        return
    show = lambda s, rich: _resolved(s, codes, inline.known, rich)
    plain = show(raw, False)
    parts = [(raw, raw)] if len(plain) <= limit else _cut(raw.strip(), limit, overlap)
    for shown, embedded in parts:
        if shown.strip():
            note.chunks.append(Chunk(path, level, show(shown, False), show(shown, True), show(embedded, False), task, "\x00CODE:" in shown))


def _resolved(s: str, codes: list[tuple[str, str]], known: list[tuple[str, str]], rich: bool) -> str:
    def one(m: re.Match[str]) -> str:
        if m[2]:
            return known[int(m[2])][rich]
        lang, code = codes[int(m[1])]
        return f"```{lang}\n{code.strip()}\n```" if rich else f"[code:{lang}]" if lang else "[code]"

    return _TOKEN.sub(one, s).strip()




