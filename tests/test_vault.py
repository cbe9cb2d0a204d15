from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.operators import ingest, output
from lodestone.sources import markdown, vault
from lodestone.sources.config import Settings
from lodestone.sources.store import Store
from lodestone.streaming.vault import watch

BODY = "Some words that are long enough to be kept as a chunk of their own, with [[Beta]] and #go."


def put(root, path, text):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(text)


@pytest.fixture
def root(tmp_path):
    at = tmp_path / "vault"
    put(at, "Alpha.md", f"---\ntitle: First\ntags: [x]\n---\n\n# One\n\n{BODY}\n\n# Two\n\n{BODY} ![[pic.png]]\n")
    put(at, "sub/Beta.md", f"{BODY.replace('Beta', 'Nowhere')}\n")
    put(at, "_odd.md", "too short\n")
    put(at, "notes.txt", "no")
    put(at, ".hidden/x.md", BODY)
    return at


def listed(spark, root, *args, **options):
    return sorted(r[0] for r in vault.list_files(spark, str(root), *args, **options).collect())


def test_listing(spark, root):
    assert listed(spark, root) == ["Alpha.md", "_odd.md", "sub/Beta.md"]
    assert listed(spark, root, "sub/**") == ["sub/Beta.md"] == listed(spark, root, "**/B*.md")
    assert listed(spark, root, "*.md") == ["Alpha.md", "_odd.md"] == listed(spark, f"file://{root}", "*.md")
    put(root, "sub/.in/x.md", BODY)
    put(root, "sub/deep/er/Y.MD", BODY)
    put(root, "sub/z.pdf", "")
    assert listed(spark, root, "sub/**", True) == ["sub/Beta.md", "sub/deep/er/Y.MD", "sub/z.pdf"]
    with pytest.raises(ValueError):
        listed(spark, root, "a[")


def test_excludes(spark, root):
    put(root, ".obsidian/app.json", json.dumps({"userIgnoreFilters": ["sub/", "**/_*"], "attachmentFolderPath": "./files"}))
    filters = vault.load_excludes(str(root))
    assert filters == ["sub/", "**/_*", "files/"]
    assert listed(spark, root, excludes=filters) == ["Alpha.md"]
    assert vault.load_excludes("/nowhere") == []


@pytest.mark.parametrize(("body", "plain", "rich"), [
    ("![[d.png]]", "[image]", "![[d.png]]"), ("![[d.png|200x150]]", "[image]", "![[d.png|200x150]]"), ("![[d.png|A view]]", "[image: A view]", "![[d.png|A view]]"), ("![[a.zip]]", "[attachment]", "![[a.zip]]"),
    ("[[a.zip]]", "a.zip", "[[a.zip]]"), ("![[n/other note]]", "n/other note", "![[n/other note]]"), ("![alt](d.png)", "alt", "alt"), ("**b** *i* `c` ~~s~~ [t](http://u)", "b i c s t", "**b** *i* `c` ~~s~~ [t](http://u)"),
    ("1. a\n   - b\n2. c", "1. a\n  - b\n2. c", "1. a\n  - b\n2. c"), ("> [!note]\n> see [t](u)", "> [!note]\n> see t", "> [!note]\n> see [t](u)"), ("| a | b |\n|--|:-:|\n| 1 | 2 |", "| a | b |\n| --- | --- |\n| 1 | 2 |", "| a | b |\n| --- | --- |\n| 1 | 2 |"),
])
def test_blocks(body, plain, rich):
    chunk = markdown.parse(body, 1000, 0, False).chunks[0]
    assert (chunk.plain, chunk.rich) == (plain, rich)


def test_note_parts():
    note = markdown.parse('---\ntitle: "T"\ntags: "a, #b"\n---\n# H\ntext #C [[X|y]] ![[p.png]] `#no`\n\n#only #tags\n\n## Sub\n- [ ] task\n```\n# not a heading [[no]]\n```\n', 500, 0)
    assert (note.tags, note.links, note.front["title"]) == (["a", "b", "c", "only", "tags"], ["X"], "T")
    assert [(c.heading_path, c.heading_level, c.has_task, c.has_code) for c in note.chunks] == [("H", 1, False, False), ("H > Sub", 2, True, True)]
    assert markdown.parse("", 100, 0).chunks == [] and markdown.parse("# only a heading", 100, 0).chunks == []
    with pytest.raises(ValueError):
        markdown.parse("x", 100, 50)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n![]|#`*é日", max_size=600), st.integers(20, 90))
def test_parser_takes_anything(text, size):
    for c in markdown.parse(text, size, size // 4).chunks:
        assert c.rich


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc. \n", min_size=1, max_size=500), st.integers(10, 60), st.integers(0, 4))
def test_cuts_are_lossless(text, limit, overlap):
    pieces = list(markdown._cut(text, limit, overlap))
    assert "".join("".join(p for p, _ in pieces).split()) == "".join(text.split())
    assert all(len(p) <= limit + 1 and e.endswith(p) for p, e in pieces)  # a full stop at the very end is taken along


def test_headings_notes_and_what_makes_no_block():
    note = markdown.parse("Title\n=====\n\nbody\n\nSub *x*\n---\ntwo http://a.b/c. and $E=mc^2$ foot[^n], [^none].\n\n[^n]: Note with **bold**.\n\n```mermaid\ngraph;\n```\n", 800, 0)
    assert [(c.heading_path, c.heading_level, c.plain) for c in note.chunks] == [("Title", 1, "body"), ("Title > Sub x", 2, "two http://a.b/c. and $E=mc^2$ foot, [^none].\n\n[code:mermaid]\n\nNote with bold.")]
    assert note.chunks[1].rich.endswith("```mermaid\ngraph;\n```\n\nNote with **bold**.") and note.chunks[1].has_code
    note = markdown.parse("one\n\n    indented\n\n<div>\nx\n</div>\n\n<!-- a\n\nb -->\n***\n[r]: http://u\n\nsee [r] and <b>bold</b>", 800, 0)
    assert [(c.plain, c.rich) for c in note.chunks] == [("one see r and bold", "one see [r](http://u) and bold")]
    assert markdown.parse("[[A#b|c]] [[#here]] ![[d.epub]] [[e.7z]] [[f.json]]", 800, 0).links == ["A", "f.json"]
    assert markdown.parse("# a #x\n\n[l](#not) `#no` \\#no #1 #y/z", 800, 0).tags == ["x", "y/z"]


def test_front_matter():
    front, rest = markdown.front_matter("---\ntitle: >\n  Folded\n  title\nmeta:\n  tags: [x]\ntag: p q\n---\nbody")
    assert front["title"] == "Folded title\n" and rest == "body" and markdown.front_tags(front) == ["p", "q"]
    assert markdown.front_tags({"tags": ["#a", 3, "", "b"]}) == ["a", "b"] and markdown.front_tags({"tags": None, "tag": "x"}) == []
    assert markdown.front_matter("---\n- a\n---\nx") == ({}, "x") and markdown.front_matter("---\na: [\n---\nx") == ({}, "x")
    assert markdown.front_matter("text\n---\n") == ({}, "text\n---\n")
    assert markdown._lines_of('title: "T"\ntags:\n - a\n - b\nx: [c, d]') == {"title": "T", "tags": ["a", "b"], "x": ["c", "d"]}


def test_long_sections_are_not_cut_within_a_mark():
    text = "Some words before it [a long link text with words](http://example.com/address) and then more words after it, on and on and on."
    note = markdown.parse(text, 60, 20)
    assert len(note.chunks) > 1 and any("[a long link text with words](http://example.com/address)" in c.rich for c in note.chunks)
    assert note.chunks[1].embed != note.chunks[1].plain and note.chunks[1].embed.endswith(note.chunks[1].plain)
    code = markdown.parse("word " * 30 + "\n\n```py\n" + "x = 1\n" * 40 + "```\n\n" + "tail " * 30, 100, 0)
    assert sum(c.has_code for c in code.chunks) == 1 and [c.rich.count("x = 1") for c in code.chunks if c.has_code] == [40]


def test_pages():
    pages = ["a" * 20, "b" * 15, "c" * 10, "d" * 45]
    packed = ingest.pack_pages(pages, 10)
    assert packed == ["a" * 20, "b" * 15 + ingest.PAGE_BREAK + "c" * 10, "d" * 40, "d" * 5]
    assert [len(p) for p in ingest.pack_pages(["x" * 45, "y" * 10], 10)] == [40, 5, 10]  # the rest of a page stays alone
    assert [len(p) for p in ingest.pack_pages(["x" * 10, "", "y" * 10], 10)] == [34]
    assert ingest.pack_pages([], 10) == []
    assert ingest.retry_delays(404, None) == [] and ingest.retry_delays(429, 5) == [5] * 3 and ingest.retry_delays(None, None) == [2, 4, 8]


def test_ingest_follows_the_vault(spark, root, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    run = ingest.Ingest(spark, store, ingest.HashingEmbedder(16), ingest.Settings(400, 50, 5))
    report = run.run(str(root))
    assert (report.scanned, report.written, report.deleted, report.failed) == (3, 2, 0, [])
    first = {r["id"]: r for r in store.chunks.collect()}
    assert set(first) == {"alpha:0", "alpha:1", "subbeta:0"} and first["alpha:0"]["title"] == "First" and first["alpha:0"]["tags"] == ["go", "x"]
    assert len(first["alpha:0"]["embedding"]) == 16
    assert {(r["source_slug"], r["target_slug"]) for r in store.links.collect()} == {("alpha", "subbeta"), ("subbeta", "nowhere")}
    assert run.run(str(root)).written == 0  # nothing changed

    put(root, "Nowhere.md", BODY)  # the phantom becomes real
    (root / "sub/Beta.md").unlink()
    report = run.run(str(root))
    assert (report.written, report.deleted) == (1, 1)
    assert {(r["source_slug"], r["target_slug"]) for r in store.links.collect()} == {("alpha", "beta"), ("nowhere", "beta")}
    put(root, "Alpha.md", "short")  # keeps its old rows
    run.run(str(root))
    assert store.chunks.where("note_slug = 'alpha'").count() == 2
    assert set(store.check().values()) == {0}
    store.reset()
    assert store.chunks.count() == 0 and store.links.count() == 0


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=8)
    run = ingest.Ingest(spark, store, ingest.HashingEmbedder(8), ingest.Settings(400, 50, 3))
    put(tmp_path, "v/x.md", "# X\n\nlinks to [[Later]] and [[b0]] here")
    for k in range(12):
        put(tmp_path, f"v/b{k}.md", f"note number {k} with [[x]]")
    run.run(str(tmp_path / "v"))
    before = store.manifest()["folders"]
    put(tmp_path, "v/Later.md", "now it is there")
    assert run.run(str(tmp_path / "v")).written == 1
    after = store.manifest()["folders"]
    changed = {t: [b for b in {*before[t], *after[t]} if before[t].get(b) != after[t].get(b)] for t in after}
    assert len(changed["chunks"]) == 1 and len(changed["raw"]) <= 1 and 1 <= len(changed["links"]) <= 2
    assert ("x", "later") in {(r["source_slug"], r["target_slug"]) for r in store.links.collect()} and store.links.count() == 14
    assert store.chunks.count() == 14 and set(store.check().values()) == {0}
    for _ in range(2):  # folders of older states go
        put(tmp_path, "v/Later.md", f"now it is there {_}")
        run.run(str(tmp_path / "v"))
    used = {f for m in (store.manifest(), json.loads(store._load(store.manifest()["before"]))) for f in m["folders"]["chunks"].values()}
    assert {p.name for p in (tmp_path / "s/chunks").iterdir() if not p.name.startswith(".")} == used
    assert len(list((tmp_path / "s").glob("manifest-*.json"))) == 2


def test_faulty_files_are_reported(spark, root, tmp_path):
    put(root, "bad.pdf", "x")

    def pages(content):
        raise RuntimeError("no text")

    run = ingest.Ingest(spark, Store(spark, str(tmp_path / "s")), ingest.HashingEmbedder(8), ingest.Settings(400, 50, 5), pages)
    report = run.run(str(root))
    assert report.n_failed == 1 and report.failed[0][0] == "bad.pdf" and "no text" in report.failed[0][1]
    assert [r["file_path"] for r in report.failures.collect()] == ["bad.pdf"]


def test_stream_of_files(spark, root, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    run = ingest.Ingest(spark, store, ingest.HashingEmbedder(8), ingest.Settings(400, 50, 5))
    watch(run, str(root), str(tmp_path / "progress")).awaitTermination(120)
    assert {r[0] for r in store.chunks.select("note_slug").distinct().collect()} == {"alpha", "subbeta"}


def test_settings(tmp_path):
    s = Settings('Chunk-Size = 5\nchunk_size = 7\nhide-tags = true\n')
    assert s.get("chunk-size") == 5 and s.get("show_tags") is False and s.get("other", 1) == 1
    assert Settings.of_file(str(tmp_path / "none")).values == {}


def test_output(spark):
    rows = spark.createDataFrame([("a", "T\tx", 0.5, 0, "", [], False), ("b", "U", 0.25, 3, "H", ["x"], True)], "note_slug string, title string, score double, chunk_index int, heading_path string, tags array<string>, lexical boolean")
    assert [r[0] for r in output.tsv_rows(rows).collect()] == ["a\tT\\tx\t\t0.500000\t\t\t\t", "b\tU\t\t0.250000\tx\t\tH\t"]
    made = output.envelope(rows, "search", "q")
    assert made["results"] == [{"note_slug": "a", "title": "T\tx", "score": 0.5}, {"note_slug": "b", "title": "U", "score": 0.25, "chunk_index": 3, "heading_path": "H", "tags": ["x"], "lexical": True}]
    assert output.printed(made, "{.results[*].note_slug}") == ["a", "b"]
    assert output.printed(made, "$.results[?(@.score > 0.3)].title") == ["T\tx"]
    assert output.printed(made, "..tags[0]") == ["x"] and output.printed(made, "total") == ["2"]
    assert output.text_lines([r.asDict() for r in rows.collect()]) == [f"1. {'T' + chr(9) + 'x':<42}  score=0.5000", f"2. {'U (§ H)':<42}  score=0.2500  [#x]"]
    with pytest.raises(ValueError):
        output.json_path({}, "a[")


def test_what_is_remembered(spark, tmp_path):
    from lodestone import scratch

    spark.range(5).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    made = []

    def make():
        made.append(scratch.materialise(table))
        return made[-1]

    state = scratch.state_of(table)
    assert scratch.remembered(state, "x", make) is scratch.remembered(scratch.state_of(spark.read.parquet(f"{tmp_path}/t")), "x", make) and len(made) == 1
    scratch.discard(made[0])
    assert scratch.remembered(state, "x", make).count() == 5 and len(made) == 2  # its files were gone
    assert scratch.state_of(spark.range(3).toDF("id")) is None and scratch.remembered(None, "x", make) is made[-1] and len(made) == 3
