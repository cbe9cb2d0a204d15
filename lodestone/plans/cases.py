"""Operators on fixed inputs, for what SQL cannot compute: the SQL states the results, written by hand."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.engine import distinct_queries
from lodestone.operators import ingest, output
from lodestone.sources import convert, markdown
from lodestone.sources.config import Settings


@dataclass(frozen=True)
class Cases:
    """``rows`` of a name, an input and the text that ``run`` gives for it."""

    run: Callable[[Any], str]
    rows: tuple[tuple[str, Any, str], ...]

    def query(self, spark: SparkSession, d: str) -> DataFrame:
        run = self.run

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [run(json.loads(x)) for x in batch["given"].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch["name"], pa.array(made, pa.string())], ["name", "value"])

        given = spark.createDataFrame([(name, json.dumps(x)) for name, x, _ in self.rows], "name string, given string")
        return given.mapInArrow(each, "name string, value string")

    def sql(self) -> str:
        quoted = lambda s: "'" + s.replace("'", "''") + "'"
        return "SELECT name, value FROM (VALUES " + ", ".join(f"({quoted(n)}, {quoted(v)})" for n, _, v in self.rows) + ") AS t(name, value)"


def _chunks(given: dict) -> str:
    """Every chunk with path, level, flags, and one of its texts."""
    note = markdown.parse(given["body"], given.get("limit", 1000), given.get("overlap", 0), given.get("skip", False))
    how = given.get("form", "plain")
    flags = lambda c: ("T" if c.has_task else "") + ("C" if c.has_code else "")
    return " || ".join(f"{c.heading_path}/{c.heading_level}/{flags(c)}: {getattr(c, how)}" for c in note.chunks)


def _found(given: dict) -> str:
    """Tags, links and title."""
    note = markdown.parse(given["body"], 1000, 0, given.get("skip", False))
    return f"{','.join(note.tags)} | {','.join(note.links)} | {str(note.front.get('title') or '').strip()}"


_MIXED = "See **b** *i* ~~s~~ `c` [t](http://u.v/w) [[A#h|x]] [[B]] #tag $a^2$ <http://y.z> and ![alt](p.png)."
MARKDOWN = Cases(_chunks, (
    ("heading paths", {"body": "pre\n# A\none\n## B\ntwo\n# C\n### D *e*\nthree"}, "/0/: pre || A/1/: one || A > B/2/: two || C > D e/3/: three"),
    ("underlined headings", {"body": "A\n===\none\n\nB\n---\ntwo"}, "A/1/: one || A > B/2/: two"),
    ("section without blocks", {"body": "# A\n\n# B\n\ntext"}, "B/1/: text"),
    ("paragraphs joined by a blank", {"body": "a\nb\n\nc"}, "/0/: a b c"),
    ("plain marks", {"body": _MIXED}, "/0/: See b i s c t x B tag $a^2$ http://y.z and alt."),
    ("rich marks", {"body": _MIXED, "form": "rich"}, "/0/: See **b** *i* ~~s~~ `c` [t](http://u.v/w) [[A#h|x]] [[B]] #tag $a^2$ http://y.z and alt."),
    ("marks in marks", {"body": "[**b** and `c`](u) ***x*** **a [l](v)**", "form": "rich"}, "/0/: [**b** and `c`](u) ***x*** **a [l](v)**"),
    ("embedded image", {"body": "![[p.png]] ![[p.png|30x20]] ![[p.png|A view]] ![[z.zip]] [[z.zip]] ![[n/m]]"}, "/0/: [image] [image] [image: A view] [attachment] z.zip n/m"),
    ("code as a placeholder", {"body": "a\n\n```go x\nf()\n```\n\n~~~\ng\n~~~"}, "/0/C: a\n\n[code:go]\n\n[code]"),
    ("code as it is", {"body": "a\n\n```go x\nf()\n```", "form": "rich"}, "/0/C: a\n\n```go\nf()\n```"),
    ("diagram", {"body": "```mermaid\ngraph TD;\n```"}, "/0/C: [code:mermaid]"),
    ("list", {"body": "3. a\n4. b\n   - c\n   - d\n     more"}, "/0/: 3. a\n4. b\n  - c\n  - d more"),
    ("tasks", {"body": "- [ ] a\n- [X] b\n- c"}, "/0/T: - [ ] a\n- [x] b\n- c"),
    ("two paragraphs of an item", {"body": "- a\n\n  b\n- c"}, "/0/: - a\n  b\n- c"),
    ("table", {"body": "|a|b|\n|:-|-|\n|1|\n|2|3|4|"}, "/0/: | a | b |\n| --- | --- |\n| 1 |  |\n| 2 | 3 |"),
    ("table below text", {"body": "text\na|b\n-|-\n1|2"}, "/0/: text\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"),
    ("quote", {"body": "> [!note] T\n> one\n> two [l](u)\n> > in\n> - x"}, "/0/: > [!note] T\n> one\n> two l\n> > in\n> - x"),
    ("code in a quote", {"body": "> a\n>\n> ```py\n> x = 1\n> ```"}, "/0/: > a\n> ```py\n> x = 1\n> ```"),
    ("footnotes", {"body": "a[^x] b[^y]\n\n[^y]: second\n[^x]: first\n[^z]: unused\n\nc"}, "/0/: a b c first second"),
    ("no blocks", {"body": "a\n\n    indented\n\n<div>\nhtml\n</div>\n\n***\n\n<!-- x\n\ny -->\nb"}, "/0/: a b"),
    ("named links", {"body": "[x][r] and [r]\n\n[r]: http://u.v", "form": "rich"}, "/0/: [x](http://u.v) and [r](http://u.v)"),
    ("tags only", {"body": "a #b\n\n#c #d/e\n\nf"}, "/0/: a b f"),
    ("cut at sentences", {"body": "One two three four. Five six seven eight. Nine ten eleven.", "limit": 30}, "/0/: One two three four. || /0/: Five six seven eight. || /0/: Nine ten eleven."),
    ("overlap is embedded only", {"body": "One two three four. Five six seven eight.", "limit": 30, "overlap": 6, "form": "embed"}, "/0/: One two three four. || /0/: four. Five six seven eight."),
    ("overlap is not shown", {"body": "One two three four. Five six seven eight.", "limit": 30, "overlap": 6}, "/0/: One two three four. || /0/: Five six seven eight."),
    ("no cut within a mark", {"body": "abcdefghijkl [a long link text](http://u.v) and words that follow", "limit": 20, "form": "rich"}, "/0/: abcdefghijkl [a long link text](http://u.v) || /0/: and words that foll || /0/: ow"),
))
COLLECTED = Cases(_found, (
    ("tags and links", {"body": "---\ntitle: \"T t\"\ntags: [B, c]\n---\n# H #Head\n#a [[L|x]] [[M#n]] `#no` [[L]]"}, "a,b,c,head | L,M | T t"),
    ("tags as text", {"body": "---\ntags: x y\n---\nz"}, "x,y |  | "),
    ("tags with commas", {"body": "---\ntags: \"x, #y z\"\n---\nz"}, "x,y z |  | "),
    ("tag", {"body": "---\ntag:\n  - p\n  - 7\n---\nz"}, "p |  | "),
    ("folded title", {"body": "---\ntitle: >\n  One\n  two\nmeta:\n  tags: [no]\n---\nz"}, " |  | One two"),
    ("attachments are links", {"body": "![[a.png]] [[b.png]] [[c.epub]] [[d.json]] [[e.7z]] ![[n]]"}, " | b.png,c.epub,d.json,e.7z,n | "),
    ("attachments are none", {"body": "![[a.png]] [[b.png]] [[c.epub]] [[d.json]] [[e.7z]] ![[n]]", "skip": True}, " | d.json,n | "),
    ("no tags", {"body": "a#b #1 \\#c http://u.v/#d [x](#e)\n\n```\n#f [[g]]\n```"}, " |  | "),
))


def _packed(given: dict) -> str:
    return ",".join(str(len(p)) for p in ingest.pack_pages(["x" * n for n in given["pages"]], given["tokens"]))


PACKING = Cases(_packed, (
    ("joined while they fit", {"pages": [10, 10, 10], "tokens": 10}, "27,10"),
    ("an oversized page stays alone", {"pages": [45, 10], "tokens": 10}, "40,5,10"),
    ("what was open is closed before it", {"pages": [5, 90, 3, 4], "tokens": 10}, "5,40,40,10,14"),
    ("just the budget", {"pages": [40, 40], "tokens": 10}, "40,40"),
    ("nothing", {"pages": [], "tokens": 10}, ""),
    ("blank pages", {"pages": [0, 3, 0], "tokens": 10}, "10"),
))

_RESULTS = {"command": "search", "query": "q", "total": 2, "results": [{"note_slug": "a", "score": 0.5, "tags": ["x", "y"]}, {"note_slug": "b", "score": 0.25}]}


def _path(path: str) -> str:
    return "\n".join(output.printed(_RESULTS, path))


PATHS = Cases(_path, (
    ("whole path", "$.results[*].note_slug", "a\nb"),
    ("in braces", "{.results[0].note_slug}", "a"),
    ("with a point", ".query", "q"),
    ("bare", "total", "2"),
    ("a list", "$.results[0].tags", "x\ny"),
    ("an object", "results[1]", '{"note_slug": "b", "score": 0.25}'),
    ("from the end", "$.results[-1].note_slug", "b"),
    ("a slice", "$.results[0:1].score", "0.5"),
    ("anywhere", "$..tags[1]", "y"),
    ("a condition", "$.results[?(@.score > 0.3)].note_slug", "a"),
    ("nothing", "$.none", ""),
))


def _lines(given: dict) -> str:
    kind = given["kind"]
    if kind == "results":
        return "\n".join(output.text_lines(given["rows"], given.get("width", 0), given.get("queries", 1), given.get("deep", False)))
    if kind == "tags":
        return "\n".join(output.tag_lines(given["rows"], given["style"]))
    if kind == "note":
        return "\n".join(output.note_lines(given["row"], given["style"], "q"))
    return "\n".join(output.stats_lines(given["row"], given["style"]))


_NOTE = {"note_slug": "n", "title": "N", "file_path": "N.md", "tags": ["x", "y"], "text": "one\ttwo", "chunks": 3}
_STATS = {"notes": 1, "chunks": 20, "links": 300}
SHOWN = Cases(_lines, (
    ("a result", {"kind": "results", "rows": [{"note_slug": "a", "title": "Alpha", "score": 0.5, "heading_path": "Part > Sub", "extra": "2 hop(s)", "is_phantom": True, "tags": ["x"]}]}, f"1. {'Alpha (§ Part > Sub)':<42}  score=0.5000  [2 hop(s)]  [phantom]  [#x]"),
    ("chunks of one note", {"kind": "results", "queries": 2, "rows": [{"note_slug": "a", "title": "A", "score": 0.5, "chunk_index": 4, "matched_queries": ["p", "q"]}, {"note_slug": "a", "title": "A", "score": 0.25, "file_type": "pdf"}]}, f"1. {'A (chunk #5)':<42}  score=0.5000  [hits: \"p\", \"q\"]\n2. {'[PDF] A (chunk #1)':<42}  score=0.2500"),
    ("heading that repeats the title", {"kind": "results", "rows": [{"note_slug": "a", "title": "A rather long title", "score": 1, "heading_path": "A Rather Long: Title > Rest"}, {"note_slug": "b", "title": "Go", "score": 1, "heading_path": "Google > Rest"}]}, f"1. {'A rather long title (§ Rest)':<42}  score=1.0000\n2. {'Go (§ Google > Rest)':<42}  score=1.0000"),
    ("narrow", {"kind": "results", "width": 50, "rows": [{"note_slug": "a", "title": "A title of more than twenty letters", "score": 0.75, "extra": "some more words here"}]}, "1. A title of more tha…  score=0.7500  [some more…"),
    ("deep", {"kind": "results", "deep": True, "rows": [{"note_slug": "a", "title": "A", "score": 0.5, "matched_queries": ["1", "2", "3", "4"], "tags": ["x"]}]}, f"1. {'A':<42}  score=0.5000\n   ├─ Matched target sections (4): \"1\", \"2\", \"3\", \"… (+1 more)\"\n   └─ Tags: #x"),
    ("tags", {"kind": "tags", "style": "text", "rows": [{"tag": "x", "count": 1}, {"tag": "y", "count": 2}]}, "#x\t(1 note)\n#y\t(2 notes)"),
    ("tags in columns", {"kind": "tags", "style": "tsv", "rows": [{"tag": "a\tb", "count": 1}]}, "tag\tcount\na\\tb\t1"),
    ("note", {"kind": "note", "style": "text", "row": _NOTE}, "N\nPath:   N.md\nTags:   #x #y\nChunks: 3\n\none\ttwo\n"),
    ("note in columns", {"kind": "note", "style": "tsv", "row": _NOTE}, "note_slug\ttitle\tfile_path\ttags\tchunks\ttext\nn\tN\tN.md\tx,y\t3\tone\ttwo"),
    ("stats", {"kind": "stats", "style": "text", "row": _STATS}, "Notes   1\nChunks  20\nLinks   300"),
    ("stats in columns", {"kind": "stats", "style": "tsv", "row": _STATS}, "notes\tchunks\tlinks\n1\t20\t300"),
))


def _setting(given: dict) -> str:
    return json.dumps(Settings(given["text"]).get(given["key"]))


SETTINGS = Cases(_setting, (
    ("hyphens and case", {"text": "Chunk-Size = 5", "key": "chunk_size"}, "5"),
    ("first in order", {"text": "chunk_size = 7\nChunk-Size = 5", "key": "chunk-size"}, "5"),
    ("old name", {"text": "hide-tags = true", "key": "show-tags"}, "false"),
    ("new name wins", {"text": "hide-tags = true\nshow-tags = true", "key": "show_tags"}, "true"),
    ("none", {"text": "", "key": "x"}, "null"),
))


def _service(given: dict) -> str:
    if "status" in given:
        return ",".join(f"{x:g}" for x in ingest.retry_delays(given["status"], given.get("after")))
    try:
        made = convert.converter(given["model"], given.get("window", 128000), given["env"])
    except (ValueError, LookupError) as e:
        return type(e).__name__
    return f"{made.name} {made.url} {made.model} {made.key}"


SERVICES = Cases(_service, (
    ("named by the model", {"model": "openrouter/a/b", "env": {"OPENAI_API_KEY": "k", "OPENROUTER_API_KEY": "r"}}, "openrouter https://openrouter.ai/api/v1 a/b r"),
    ("first with a key", {"model": "m", "env": {"GEMINI_API_KEY": "g", "OPENAI_API_KEY": "\"k\"\n"}}, "openai https://api.openai.com/v1 m k"),
    ("by its prefix", {"model": "deepseek-chat", "env": {"DEEPSEEK_API_KEY": "d"}}, "deepseek https://api.deepseek.com deepseek-chat d"),
    ("local host", {"model": "ollama/x", "env": {"OLLAMA_HOST": "http://h:1/"}}, "ollama http://h:1/v1 x none"),
    ("no key", {"model": "m", "env": {}}, "NoKey"),
    ("window too small", {"model": "m", "window": 12287, "env": {"OPENAI_API_KEY": "k"}}, "ValueError"),
    ("tried again", {"status": 503}, "2,4,8"),
    ("asked to wait", {"status": 429, "after": 5}, "5,5,5"),
    ("asked to wait long", {"status": 429, "after": 500}, "60,60,60"),
    ("not tried again", {"status": 404}, ""),
))


QUERY_INPUTS = Cases(lambda given: "|".join(distinct_queries(given)), (
    ("trimmed, once, in order", ["b ", " a", "b", ""], "b|a"),
    ("case counts", ["A", "a"], "A|a"),
    ("none", ["", " \n"], ""),
))


def _broken(content: bytes) -> list[str]:
    if content == b"broken":
        raise RuntimeError("no text")
    return content.decode().split("\f")


def ingest_files(spark: SparkSession, d: str) -> DataFrame:
    """Four files through hashing, reading, conversion and parsing; one cannot be read, one not converted."""
    files = [("A b.md", b"---\ntitle: T\n---\n# H\nwords of a note", None), ("p.pdf", b"page one\fpage two", None), ("q.pdf", b"broken", None), ("r.md", None, "gone")]
    df = spark.createDataFrame([(p, bytearray(c) if c else None, e) for p, c, e in files], "file_path string, content binary, error string")
    rows = ingest.parsed(ingest.hashed(df, ingest.Settings(), "m"), ingest.Settings(), _broken, lambda text: "# Paper\n\n" + text.replace("one", "1"), 20000)
    return rows.select("file_path", "note_slug", "title", "file_type", "heading_path", "text", "error")


# The line between two pages is a rule, so their paragraphs follow one another.
_FILES_SQL = """SELECT * FROM (VALUES ('A b.md', 'a-b', 'T', 'md', 'H', 'words of a note', NULL), ('p.pdf', 'p-pdf', 'p', 'pdf', 'Paper', 'page 1 page two', NULL),
('q.pdf', 'q-pdf', 'q', 'pdf', NULL, NULL, 'RuntimeError: no text'), ('r.md', 'r', 'r', 'md', NULL, NULL, 'ValueError: gone')) AS t(file_path, note_slug, title, file_type, heading_path, text, error)"""
_ALL = {"query_inputs": QUERY_INPUTS, "markdown_chunks": MARKDOWN, "markdown_links_tags": COLLECTED, "page_packing": PACKING, "json_paths": PATHS, "text_output": SHOWN, "settings_values": SETTINGS, "converter_choice": SERVICES}
QUERIES = {name: cases.query for name, cases in _ALL.items()} | {"ingest_files": ingest_files}
SQL = {name: cases.sql() for name, cases in _ALL.items()} | {"ingest_files": _FILES_SQL}
